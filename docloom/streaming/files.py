"""Stateless file streaming: new text files through the same plans, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_texts(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """(doc_id, text) of the files that arrive in a folder; the id is a hash of the file's path."""
    rows = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_at_once).load(path)
    return rows.select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("text"))


def run_batches(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply a batch plan to each micro-batch and write it under its number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
