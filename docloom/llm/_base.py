"""Shared helpers of the training-data operators: tables, shared storage, Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python hold at most this many bytes, so that long texts do not pile up.
BATCH_BYTES = 4 << 20
#: Work inside a batch goes on in slices of about this many text bytes.
SLICE_BYTES = 1 << 20
#: Tables of short rows are broadcast up to this count.
BROADCAST_ROWS = 200_000
_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
#: Intermediate results of this process that still exist, with their session.
_WRITTEN: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(value: str) -> int:
    """A size setting such as 4m or 8388608b as bytes; 0 for what is none."""
    v = value.strip().lower().removesuffix("b")
    digits = v.rstrip("kmgt")
    unit = v[len(digits) :]
    return int(digits) * _UNITS[unit] if digits.isdigit() and unit in _UNITS else 0


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch in this session, for results are lazy and run later; a smaller setting of the user stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < bytes_of(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a local master gets a temporary folder; on a cluster that is an error, since each executor
    would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="docloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return str(found).rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder. It is deleted by :func:`clean`, at the latest when this process ends."""
    path = f"{shared_dir(spark)}/docloom/{tag}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(clean)
    _WRITTEN[path] = spark
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it: cuts lineage, survives lost executors, is read many times."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a materialised result that nothing will read again."""
    path = df.__dict__.pop("_scratch", None)
    if path in _WRITTEN:
        _delete(path, _WRITTEN.pop(path))


def clean() -> None:
    """Delete all intermediate results of this process. Lazy results that still read them can't run afterwards."""
    while _WRITTEN:
        try:
            _delete(*_WRITTEN.popitem())
        except Exception:  # noqa: BLE001, S112 -- at the end of the process the gateway may be gone
            continue


def _delete(path: str, spark: SparkSession) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` to be broadcast when a count shows at most ``most`` short rows; else as it is, for a join that shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text each; a single longer text is a slice of its own."""
    if not batch.num_rows:
        return
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for row, n in enumerate(size.tolist()):
        if row > start and total + n > limit:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += n
    yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
