"""Exact dedup by content sort.

Rows are ordered by (normalised bytes, id). Sampled splitters cut that order into ranges, an external sort inside each
range places equal texts next to each other, and neighbours are compared in full. A splitter is the start of a text;
only where one start fills more than a range is it made longer, up to the whole text and then the id, so that a text
with very many copies spreads over several ranges. Runs that cross a border are tied by a full comparison of the two
texts there.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import bound_batches, materialise, table, text_slices, utf8

NULL_ID, LEAST_ID = (1 << 63) - 1, -(1 << 63)
#: Bytes of a splitter at first, and how much longer it gets at a time where it doesn't part a range.
HEAD, LONGER = 64, 16
#: Sampled rows for each range, and the bytes of them that the driver holds at once.
SAMPLED, DRIVER_BYTES = 40, 32 << 20
#: Where a run lies in its range.
INNER, FIRST, LAST = 0, 1, 2
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def normalise(text: bytes) -> bytes:
    """Each run of white space as one space."""
    text = text.translate(_SPACES)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def _sample(rows: DataFrame, share: float, size: int, within: list[bytes] | None) -> list[tuple[bytes, list[int], bool]]:
    """(start of ``size`` bytes, sampled ids, whether the start is the whole text) of a share of the rows that begin with one of ``within``."""
    wanted = None if within is None else frozenset(within)
    least = min(map(len, within)) if within else 0
    lengths = {len(x) for x in within or ()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), strict=True):
                n = normalise(t)
                if wanted is None or (len(n) >= least and any(n[:k] in wanted for k in lengths)):
                    out.append((n[:size], i, len(n) <= size))
            head, ids, whole = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(head, pa.binary()), pa.array(ids, pa.int64()), pa.array(whole, pa.bool_())], names=["head", "id", "whole"])

    picked = rows.where(F.rand(11) < share) if share < 1 else rows
    found = picked.mapInArrow(run, "head binary, id long, whole boolean")
    # Equal starts travel once, with their ids.
    return [(bytes(r["head"]), r["ids"], r["whole"]) for r in found.groupBy("head", "whole").agg(F.collect_list("id").alias("ids")).toLocalIterator()]


def splitters(rows: DataFrame, ranges: int, sampled: int = SAMPLED, head: int = HEAD) -> list[tuple[bytes, int]]:
    """At most ``ranges`` - 1 places (text or its start, id) that cut the order of (normalised bytes, id) into like shares."""
    total = rows.count()
    if ranges < 2 or total < 2:
        return []
    # (start, id) with the share of all rows that a sampled row stands for
    items: list[tuple[bytes, int, float]] = []
    within, weight, size = None, 1.0, head
    while True:
        most = max(2 * ranges, min(sampled * ranges, DRIVER_BYTES // size))
        got = _sample(rows, min(1.0, most / max(total * weight, 1)), size, within)
        every = sum(len(ids) for _, ids, _ in got)
        if not every:
            break
        each = weight / every
        hot = []
        for start, ids, whole in got:
            if whole:
                items += [(start, i, each) for i in ids]
            elif len(ids) * each > 1 / ranges:
                hot.append((start, len(ids) * each))
            else:
                items += [(start, LEAST_ID, each)] * len(ids)
        if not hot:
            break
        within, weight, size = [h for h, _ in hot], sum(w for _, w in hot), size * LONGER
    items.sort()
    out, done, step = [], 0.0, sum(w for _, _, w in items) / ranges
    for start, i, w in items:
        if done >= step * (len(out) + 1) and len(out) < ranges - 1 and (not out or (start, i) > out[-1]):
            out.append((start, i))
        done += w
    return out


def _dealt(rows: DataFrame, extra: bool) -> DataFrame:
    """(part, norm, doc_id[, row]): rows in ranges of the order of (normalised bytes, id), sorted inside each."""
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = spark.sparkContext.broadcast(splitters(rows.select("doc_id", "text"), ranges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = cuts.value
        for b in batches:
            for s in text_slices(b):
                ids = s.column("doc_id")
                norm = [normalise(t) for t in utf8(s.column("text"))]
                part = [bisect_right(at, key) for key in zip(norm, ids.to_pylist(), strict=True)]
                kept = [s.column("row")] if extra else []
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(norm, pa.binary()), ids, *kept], names=["part", "norm", "doc_id", *(["row"] if extra else [])])

    row = f", row {rows.schema['row'].dataType.simpleString()}" if extra else ""
    dealt = rows.mapInArrow(run, f"part int, norm binary, doc_id long{row}").repartitionById(ranges, "part")
    # Ranges follow the order of the sort; of rows with one text and id the first by their other columns comes first.
    tie = [F.to_json("row")] if extra else []
    return dealt.sortWithinPartitions("norm", "doc_id", *tie)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document, in runs of equal texts; behind a range a row of its border: the first and last text, and their runs."""
    names = ["doc_id", "keep", "size", "text_sha256", "part", "place", "first", "last", "head_keep", "head_size"]
    out: list[tuple] = []
    text, ids, part, head, first = None, [], None, None, True

    def flush() -> Iterator[pa.RecordBatch]:
        if out:
            cols = zip(*out, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
            out.clear()

    def close(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal head, first
        place = (FIRST if first else INNER) + (LAST if last else INNER)
        if first:
            head = (text, ids[0], len(ids))
        first = False
        keep, size, sha = ids[0], len(ids), hashlib.sha256(text).hexdigest()
        for i in ids:
            out.append((i, keep, size, sha, part, place, None, None, None, None))
            if len(out) >= 8192:
                yield from flush()
        if last:
            out.append((None, keep, size, None, part, place, head[0], text, head[1], head[2]))

    for b in batches:
        for p, t, i in zip(b.column("part").to_pylist(), b.column("norm").to_pylist(), b.column("doc_id").to_pylist(), strict=True):
            if p == part and t == text:
                ids.append(i)
                continue
            if ids:
                yield from close(p != part)
            if p != part:
                part, first = p, True
            text, ids = t, [i]
    if ids:
        yield from close(True)
    yield from flush()


_RUNS = "doc_id long, keep long, size long, text_sha256 string, part int, place int, first binary, last binary, head_keep long, head_size long"


def _tied(edges: DataFrame) -> set[int]:
    """Ranges whose first text is the last text of the range with rows before. The texts are compared in a join; numbers of ranges come back."""
    parts = sorted(r["part"] for r in edges.select("part").collect())
    if len(parts) < 2:
        return set()
    follows = edges.sparkSession.createDataFrame(list(zip(parts, parts[1:], strict=False)), "part int, next int")
    before = edges.select("part", "last").join(F.broadcast(follows), "part").select(F.col("next").alias("part"), F.col("last").alias("before"))
    return {r["part"] for r in edges.select("part", "first").join(before, "part").where("first = before").select("part").collect()}


def _keyed(id_col: str, text_col: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text")


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space (space, tab, LF, VT, FF, CR) became one space; a
    null text counts as empty. keep_id is the smallest id of the group. A null id counts as larger than all others
    and comes back as null. Rows that repeat an id are counted as rows; all rows with the keeping id are kept
    (:func:`distinct_texts` keeps one row). An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    runs = materialise(_dealt(docs.select(*_keyed(id_col, text_col)), False).mapInArrow(_runs, _RUNS), "runs")
    edges = runs.where("first is not null")
    tied = _tied(edges)
    # Numbers of the ranges' border runs: bounded by the number of ranges, whatever the data.
    numbers = sorted(tuple(r) for r in edges.select("part", "place", "keep", "size", "head_keep", "head_size").collect())
    chains: list[list[tuple[int, int, int, int]]] = []
    for part, place, keep, size, head_keep, head_size in numbers:
        whole = place == FIRST + LAST
        head = (part, place if whole else FIRST, head_keep, head_size)
        if part in tied:
            chains[-1].append(head)
        else:
            chains.append([head])
        if not whole:
            chains.append([(part, LAST, keep, size)])
    fixed = [(part, place, min(c[2] for c in chain), sum(c[3] for c in chain)) for chain in chains if len(chain) > 1 for part, place, _, _ in chain]
    fix = spark.createDataFrame(fixed, "part int, place int, all_keep long, all_size long")
    out = runs.where("first is null").join(F.broadcast(fix), ["part", "place"], "left")
    keep, size = F.coalesce("all_keep", "keep"), F.coalesce("all_size", "size")
    null = lambda c: F.when(c != NULL_ID, c)
    kept = F.col("doc_id") == keep
    return out.select(null(F.col("doc_id")).alias("doc_id"), null(keep).alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each run of equal texts, and behind a range a row with its first and last text."""
    text = part = head = kind = None

    def edge() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([part], pa.int32()), pa.array([False]), pa.array([head], pa.binary()), pa.array([text], pa.binary())], names=names)

    names = ["row", "part", "opens", "first", "last"]
    for b in batches:
        pick, parts, opens = [], [], []
        kind = b.column("row").type
        ends = []
        for k, (p, t) in enumerate(zip(b.column("part").to_pylist(), b.column("norm").to_pylist(), strict=True)):
            if p == part and t == text:
                continue
            if p != part:
                if part is not None:
                    ends.append(edge())
                head = t
            pick.append(k)
            parts.append(p)
            opens.append(p != part)
            part, text = p, t
        n = len(pick)
        yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(pick, pa.int64())), pa.array(parts, pa.int32()), pa.array(opens, pa.bool_()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)
        yield from ends
    if part is not None:
        yield edge()


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one for each distinct normalised text: that with the smallest id, a null id after all others; of rows alike in text and id the first by its other columns.

    Texts are equal as in :func:`content_sort`. All columns come back as they are. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(*_keyed(id_col, text_col), row)
    kind = rows.schema["row"].dataType.simpleString()
    runs = materialise(_dealt(rows, True).mapInArrow(_firsts, f"row {kind}, part int, opens boolean, first binary, last binary"), "texts")
    tied = [(p,) for p in _tied(runs.where("first is not null"))]
    held = docs.sparkSession.createDataFrame(tied, "part int").withColumn("opens", F.lit(True))
    return runs.where("first is null").join(F.broadcast(held), ["part", "opens"], "left_anti").select("row.*")


def op2_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of all documents; see :func:`content_sort`."""
    return content_sort(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
