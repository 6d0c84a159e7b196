"""SimHash near-dedup: fingerprints, pigeonhole blocks, exact Hamming verification, components.

Two 64-bit fingerprints that differ in at most three bits agree on one of four 16-bit blocks. Distinct
fingerprints are dealt by (block number, block value), each bucket is compared in full inside one task, and only
a spanning forest of the links leaves the task. A bucket above ``dense`` fingerprints is dealt again by a second
pigeonhole over its other 48 bits; nothing is capped. Buckets that are still large are searched by bit flips
(distance 3 = 2 + 1), so their cost grows with their size and not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import bound_batches, materialise, table, utf8
from ._graph import connected_components, forest
from ._words import mix

U = np.uint64
DISTANCE, DENSE = 3, 4096
#: Flipped fingerprints, and links, that a task holds at once.
FLIPPED = 1 << 22
_PAIRS = "u long, v long, key long"
_ARROW = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int64())])


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The SimHash of one text: bit b is set when over half of the shingle hashes have it. Shingles are ``width`` words, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(start[:n].tolist(), end[width - 1 :].tolist(), strict=True)), U, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        ones += np.unpackbits(h[k : k + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(U)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the columns in ``keep``: the fingerprint of each text as a signed long; null texts count as empty."""
    bound_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in utf8(b.column("text"))], U).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp), *(b.column(c) for c in keep)], names=["doc_id", "fp", *keep])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    return rows.mapInArrow(run, "doc_id long, fp long" + "".join(f", `{c}` {kinds[c]}" for c in keep))


def _flips() -> tuple[np.ndarray, np.ndarray]:
    one = U(1) << np.arange(64, dtype=U)
    i, j = np.triu_indices(64, 1)
    return one, one[i] | one[j]


def close_pairs(fp: np.ndarray, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same fingerprints as all links of distance 3 or less among the distinct ``fp``."""
    m = len(fp)
    a, b = [], []
    if m <= 4 * dense:
        for k in range(0, m, 256):
            i, j = np.nonzero(np.bitwise_count(fp[k : k + 256, None] ^ fp[None, k:]) <= DISTANCE)
            a.append(fp[i[j > i] + k])
            b.append(fp[j[j > i] + k])
            if sum(map(len, a)) > 1 << 20:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                a, b = [x], [y]
    else:
        # a and b are within 3 bits exactly when some a ^ x equals some b ^ y, |x| <= 1 and |y| <= 2. The values are
        # gone through in shares of the same hash, so that memory doesn't grow with 65 copies of the bucket.
        one, two = _flips()
        shares = U(max(1, -(-65 * m // FLIPPED)))

        def flipped(masks: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
            got = [(v[p], fp[p]) for v in (fp ^ x for x in masks) for p in (np.flatnonzero(mix(v) % shares == share),)]
            return np.concatenate([v for v, _ in got]), np.concatenate([o for _, o in got])

        for share in range(int(shares)):
            near, owner = flipped(np.concatenate([[U(0)], one]), share)
            order = np.argsort(near, kind="stable")
            near, owner = near[order], owner[order]
            # All owners of one flipped value are within 2 bits of each other: link them to the first.
            first = np.flatnonzero(np.r_[True, near[1:] != near[:-1]]) if len(near) else np.zeros(0, np.int64)
            lead = np.repeat(owner[first], np.diff(np.r_[first, len(near)]))
            x, y = forest(owner[owner != lead], lead[owner != lead])
            a.append(x)
            b.append(y)
            value, head = near[first], first
            for masks in np.array_split(np.concatenate([[U(0)], one, two]), 64):
                seek, by = flipped(masks, share)
                at = np.minimum(np.searchsorted(value, seek), max(len(value) - 1, 0))
                hit = np.flatnonzero(value[at] == seek) if len(value) else at[:0]
                # every owner of the value is within |flip| + 1 <= 3 bits of the seeker; the first stands for all, they are linked above
                a.append(by[hit])
                b.append(owner[head[at[hit]]])
                if sum(map(len, a)) > FLIPPED:
                    x, y = forest(np.concatenate(a), np.concatenate(b))
                    a, b = [x], [y]
    if not a:
        return np.zeros(0, U), np.zeros(0, U)
    a, b = np.concatenate(a), np.concatenate(b)
    return forest(a[a != b], b[a != b])


def _buckets(deal_again: bool, dense: int):
    """Compare the buckets of one partition, sorted by key; with deal_again, pass on those above ``dense`` under finer keys."""

    def rows(u: np.ndarray, v: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
        k = pa.nulls(len(u), pa.int64()) if key is None else pa.array(key.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), k], schema=_ARROW)

    def finer(key: int, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        block = key >> 16
        low = U((1 << (16 * block)) - 1)
        rest = (fp & low) | ((fp >> U(16)) & ~low)  # the other 48 bits
        for j in range(4):
            yield rows(fp, fp, U(key) << U(14) | U(j) << U(12) | (rest >> U(12 * j) & U(0xFFF)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, key, held, large = [], [], None, [], False

        def end() -> Iterator[pa.RecordBatch]:
            if held and large:
                yield from finer(key, np.concatenate(held))
            elif held:
                fp = np.unique(np.concatenate(held))
                x, y = close_pairs(fp, dense)
                a.append(x)
                b.append(y)

        for batch in batches:
            k, fp = (batch.column(c).to_numpy() for c in ("key", "fp"))
            k, fp = k.view(U), fp.view(U)
            cut = np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)]
            size = np.diff(cut)
            inner = np.zeros(len(size), bool)
            inner[1:-1] = True
            small = inner & (size <= 32)
            # Small buckets wholly inside the batch: by shifts, all at once.
            pick = np.repeat(small, size)
            ks, fs = k[pick], fp[pick]
            for d in range(1, 32):
                same = ks[d:] == ks[:-d]
                if not same.any():
                    break
                near = np.flatnonzero(same & (np.bitwise_count(fs[d:] ^ fs[:-d]) <= DISTANCE))
                a.append(fs[near])
                b.append(fs[near + d])
            for g in np.flatnonzero(~small).tolist():
                value, part = int(k[cut[g]]), fp[cut[g] : cut[g + 1]]
                if value != key:
                    yield from end()
                    key, held, large = value, [], False
                held.append(part)
                if deal_again and sum(map(len, held)) > dense:
                    large = True
                if large:
                    yield from finer(key, np.concatenate(held))
                    held = []
        yield from end()
        if a:
            x, y = np.concatenate(a), np.concatenate(b)
            if len(x):
                yield rows(*forest(x, y))

    return run


def near_components(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """``fps``: a column fp of distinct fingerprints. Returns (fp, root) for all that link, at first or further hand, to a smaller fp."""
    n = 4
    value = lambda j: F.shiftrightunsigned("fp", 16 * j).bitwiseAND(F.lit(0xFFFF))
    keyed = fps.select("fp", F.explode(F.array(*[F.lit(j << 16).cast("long") + value(j) for j in range(n)])).alias("key"))
    deal = lambda df: df.repartition("key").sortWithinPartitions("key", "fp")
    first = materialise(deal(keyed).mapInArrow(_buckets(True, dense), _PAIRS), "blocks")
    again = deal(first.where("key is not null").select(F.col("u").alias("fp"), "key")).mapInArrow(_buckets(False, dense), _PAIRS)
    links = first.where("key is null").select("u", "v").unionByName(again.select("u", "v"))
    return connected_components(links).select(F.col("node").alias("fp"), F.col("root").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint, component_id, root) for each row of ``docs``, and its columns in ``keep``.

    Fingerprints within three bits are linked; component_id is the smallest id of all rows reachable over links, the
    row itself included, and root the component's least fingerprint. Null and empty texts have fingerprint zero and link
    like any other. Rows with a null id come back with their component; a component of null ids only has a null
    component_id. Repeated rows give repeated rows. An empty table gives an empty result.
    """
    fp = materialise(fingerprints(docs, id_col, text_col, width, keep), "fp")
    ids = materialise(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "ids")
    roots = near_components(ids.select("fp"))
    whole = ids.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    named = whole.join(least, "root").select("fp", "component_id", "root")
    # A fingerprint that very many rows share is one key of this join; the planner splits it (skew join) or broadcasts the names.
    return fp.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", *keep)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents; see :func:`near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("root")
