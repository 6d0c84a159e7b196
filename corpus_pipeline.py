"""Documents to token ids in five stages: language ID, exact dedup, near dedup, source mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``. Decisions are taken by row: ids may be null or
repeat, and rows that are alike in all columns are told apart by their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm._base import materialise, scratch, sized, table
from docloom.llm.exact_dedup import distinct_texts
from docloom.llm.language import identify
from docloom.llm.mixing import mix
from docloom.llm.pieces import encode_column
from docloom.llm.simhash import near_duplicates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _digest() -> Column:
    """A digest of all columns of a document: equal rows have equal ones."""
    return F.sha2(F.to_json(F.struct(*COLUMNS)), 256)


def _without(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """Rows of docs whose digest is not in ``digests``; these are broadcast when a count shows that they are few."""
    return docs.select(*COLUMNS, _digest().alias("__key")).join(sized(digests.select(F.col("digest").alias("__key")).distinct()), "__key", "left_anti").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told. Null and empty texts go, and texts without letters; each row has its own verdict."""
    found = identify(docs.select(*COLUMNS, _digest().alias("digest")), table(spark, sf_dir, "pages"), keep=("digest",))
    return _without(docs, materialise(found.where("not accepted").select("digest"), "rejected"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the smallest id; null and empty texts are one group. Null ids come after all others."""
    return distinct_texts(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-equal fingerprints: that with the smallest id, of several the one with the least digest.

    Null and empty texts have one fingerprint, so that one of them stays. Of rows alike in all columns one stays.
    """
    found = near_duplicates(docs.select(*COLUMNS, _digest().alias("digest")), keep=("digest",))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    found = materialise(found.select("digest", "root", order.alias("o")).groupBy("root", "digest").agg(F.count("*").alias("rows"), F.min("o").alias("o")), "near")
    best = found.groupBy("root").agg(F.min("o").alias("best"))
    ranked = found.join(best, "root").select("digest", "rows", (F.col("o") == F.col("best")).alias("stays"))
    ranked = materialise(ranked.where("not stays or rows > 1"), "near-out")
    out = _without(docs, ranked)
    again = ranked.where("stays")
    if again.isEmpty():
        return out
    # Rows that repeat in full: all left above, one of them comes back.
    rows = docs.select(*COLUMNS, _digest().alias("__key")).join(again.select(F.col("digest").alias("__key")), "__key", "left_semi")
    return out.unionByName(rows.dropDuplicates(["__key"]).select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row once or more: small sources are repeated, up to 1.5 passes, so that large ones weigh less.

    Rows come in the order of the mixture, along the shares of their sources' budgets: each block is a permutation of its
    source, and a run of the result has its sources at their weights. Empty texts are in each whole block; nulls are kept.
    """
    mixed = mix(docs, entropy_share=None, max_passes=1.5, budget=None, keep=COLUMNS)
    # Progress is even in tokens, so that like shares of it are like shares of the mixture: no sample has to find them.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.least(F.floor(F.col("progress") * parts), F.lit(parts - 1)).cast("int")
    return mixed.withColumn("__place", place).repartitionById(parts, "__place").sortWithinPartitions("progress", "source", "block", "position").select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row; null and empty texts have none, and repeated rows are encoded each."""
    return encode_column(docs, keep=("doc_id", "lang", "source"))


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("source mixing", source_mix), ("encoding", encoding)]

#: Fingerprints, trained language models and token ids can't be told in SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The last result is lazy; those before it are written to the shared folder, where the last stays until this process ends."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        at = scratch(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
