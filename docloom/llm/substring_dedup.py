"""Substring dedup by relative factorisation.

Documents are parsed against indexed blocks of reference text. To ask every block for every document would grow with
the square of the corpus, so reference and documents meet by content: a text is cut into pieces, the runs of 13-word
windows with one minimizer (the least 5-word hash of a window). Equal windows have equal minimizers, so all places that
can match a window lie in the one block that its minimizer is dealt to, and a piece is asked of that block only.

A block holds the distinct pieces of a range of minimizers, each with the smallest document that has it, as words coded
by a dictionary of the block. Its index is the order of all suffixes by their first 13 words (prefix doubling); places
that share these words are neighbours, and the smallest document among them is the first holder. The words themselves
are compared, not hashes of windows. A document's factors run greedily from a window that a smaller document holds to
the last such window in a row; the windows that reach over a factor's end, and over that of a piece, are asked like all
others. Words inside factors go.

A bitmap of fixed size holds the minimizers that occur in two documents; a false hit costs a row and never a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import bound_batches, drop, materialise, sized, table, text_slices, utf8
from ._words import Words, mix

U = np.uint64
WINDOW, SEED = 13, 5
#: The bitmap has eight bits or more for each repeated hash, within these bounds (2**31 bits are 256 MB).
BITS_LEAST, BITS_MOST, SEGMENT = 20, 31, 16
#: Keys of rows without an id begin here; behind come bits of a digest of the text.
NULL_BITS = 40
NULL_FROM = (1 << 63) - (1 << NULL_BITS)
#: Words of a reference block, and the most distinct pieces of one minimizer; a minimizer with more is dealt again by single windows.
BLOCK_WORDS, HOT = 1 << 20, 20_000


def _windows(words: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows inside one text, the windows' hashes, and their minimizers."""
    h = words.hashes()
    w, inside = words.grams(h, window)
    at = np.flatnonzero(inside)
    if not len(at):
        return at, w[:0], w[:0]
    g, _ = words.grams(h, seed)
    low = g[: len(w)].copy()
    for j in range(1, window - seed + 1):
        np.minimum(low, g[j : j + len(w)], out=low)
    return at, w[at], low[at]


def _least(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.minimum.reduceat(doc, first) if len(first) else doc, np.maximum.reduceat(doc, first) if len(first) else doc


def _repeats(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """Minimizers that two documents or more hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids = [], []
            for s in text_slices(b):
                words = Words(s.column("text"))
                at, _, low = _windows(words, window, seed)
                if len(at):
                    row = words.row[at]
                    new = np.r_[True, (low[1:] != low[:-1]) | (row[1:] != row[:-1])]
                    keys.append(low[new])
                    ids.append(s.column("doc_id").to_numpy()[row[new]])
            if keys:
                k, lo, hi = _least(np.concatenate(keys), np.concatenate(ids))
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(lo), pa.array(hi)], names=["k", "lo", "hi"])

    seen = docs.mapInArrow(run, "k long, lo long, hi long")
    return seen.groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("k")


def _bitmap(spark: SparkSession, keys: DataFrame):
    """A broadcast bitmap of ``keys``; its size is set by their count and never passes 2**BITS_MOST bits."""
    n = keys.count()
    bits = min(BITS_MOST, max(BITS_LEAST, (8 * n).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            bit = b.column("k").to_numpy().view(U) & U((1 << bits) - 1)
            seg = (bit >> U(SEGMENT)).astype(np.int64)
            for s in np.unique(seg).tolist():
                held.setdefault(s, np.zeros(1 << SEGMENT, bool))[(bit[seg == s] & U((1 << SEGMENT) - 1)).astype(np.int64)] = True
        for s, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([np.packbits(m, bitorder="little").tobytes()])], names=["segment", "bits"])

    out = bytearray(1 << bits - 3)
    width = 1 << SEGMENT - 3
    dealt = keys.repartitionByRange(F.col("k").bitwiseAND(F.lit((1 << bits) - 1))).mapInArrow(fill, "segment long, bits binary")
    for row in dealt.toLocalIterator():
        part = slice(row["segment"] * width, (row["segment"] + 1) * width)
        out[part] = (np.frombuffer(out[part], np.uint8) | np.frombuffer(bytes(row["bits"]), np.uint8)).tobytes()
    return spark.sparkContext.broadcast(bytes(out)), bits


def _hit(bitmap: np.ndarray, bits: int, low: np.ndarray) -> np.ndarray:
    bit = low & U((1 << bits) - 1)
    return (bitmap[(bit >> U(3)).astype(np.int64)] >> (bit & U(7)).astype(np.uint8) & 1).astype(bool)


class _Pieces:
    """The runs of candidate windows with one minimizer in the texts of a slice: first word, windows, minimizer, row, and a key of all words.

    A run has at most ``window - seed + 1`` windows; a longer one is several pieces.
    """

    def __init__(self, words: Words, window: int, seed: int, bitmap: np.ndarray, bits: int):
        at, w, low = _windows(words, window, seed)
        hit = np.flatnonzero(_hit(bitmap, bits, low))
        self.at, self.w, low, row = at[hit], w[hit], low[hit], words.row[at[hit]]
        n = len(hit)
        new = np.r_[True, (low[1:] != low[:-1]) | (row[1:] != row[:-1]) | (self.at[1:] != self.at[:-1] + 1)][:n]
        first = np.flatnonzero(new)
        # Where its seed comes again within a window (a a a ..., a b a b ...) a run has no end: it is cut, since a mask has 64 bits.
        new |= (np.arange(n) - first[np.cumsum(new) - 1]) % (window - seed + 1) == 0
        first = np.flatnonzero(new)
        self.piece = np.cumsum(new) - 1  # of each window
        self.run = np.diff(np.r_[first, n])
        self.start, self.low, self.row = self.at[first], low[first], row[first]
        self.place = np.arange(n) - np.repeat(first, self.run)  # of each window in its piece
        # the first and the last window of a piece have all of its words
        self.key = mix(self.w[first] * U(0x9E3779B97F4A7C15) + mix(self.w[first + self.run - 1] + self.run.astype(U)))


def _held(codes: np.ndarray, ends: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows inside the pieces of a block, and the smallest document that holds each.

    ``codes``: the pieces' words one behind the other; ``ends``, ``doc``: of the piece of each word. Ranks of suffixes by 1, 2, 4 ...
    words are doubled until two of them cover a window; suffixes with one rank have the same words.
    """
    n = len(codes) - window + 1
    at = np.flatnonzero(np.arange(max(n, 0)) + window <= ends[: max(n, 0)])
    rank, width = codes.astype(np.int64), 1
    while 2 * width <= window:
        pairs = rank[:-width] * (int(rank.max(initial=0)) + 1) + rank[width:]
        rank = np.unique(pairs, return_inverse=True)[1]
        width *= 2
    pairs = rank[at] * (int(rank.max(initial=0)) + 1) + rank[at + window - width]
    order = np.argsort(pairs, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(pairs[order]) != 0])[: len(order)]
    least = np.empty(len(at), np.int64)
    if len(order):
        least[order] = np.repeat(np.minimum.reduceat(doc[at][order], first), np.diff(np.r_[first, len(order)]))
    return at, least


def _index(window: int, block_words: int):
    """Blocks of a partition's pieces, which come sorted by minimizer: for each piece which of its windows its document holds first."""

    def block(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = pa.Table.from_batches(parts).combine_chunks()
        lists = pc.split_pattern(table_.column("piece").combine_chunks(), " ")
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        doc, end = table_.column("doc").to_numpy(), np.cumsum(size)
        owner = np.repeat(np.arange(len(size)), size)
        at, least = _held(codes, end[owner], doc[owner], window)
        mine = owner[at]
        bit = np.where(least == doc[mine], np.int64(1) << (at - (end - size)[mine]), 0)
        mask = np.zeros(len(size), np.int64)
        np.bitwise_or.at(mask, mine, bit)
        keep = np.flatnonzero(mask)
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), table_.column("key").combine_chunks().take(pa.array(keep)), pa.array(mask[keep])], names=["doc", "key", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for b in batches:
            low = b.column("low").to_numpy()
            size = pc.count_substring(b.column("piece"), " ").to_numpy(zero_copy_only=False).astype(np.int64) + 1
            total = words + np.cumsum(size)
            # where a new minimizer begins behind a full block
            begins = np.flatnonzero(np.r_[not held or held[-1].column("low")[-1].as_py() != low[0], low[1:] != low[:-1]])
            start = 0
            for k in begins.tolist():
                if total[k] - size[k] >= block_words:
                    if k > start:
                        held.append(b.slice(start, k - start))
                    if held:
                        yield from block(held)
                    held, start = [], k
                    total -= total[k] - size[k]
            held.append(b.slice(start))
            words = int(total[-1])
        if held:
            yield from block(held)

    return run


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, block_words: int = BLOCK_WORDS, hot: int = HOT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256, spans, n_factors.

    spans lists [from, to) word ranges that earlier documents hold; kept_sha256 is of the other words, joined by one space.
    A null text has no words; a text of fewer than ``window`` words keeps all. Rows without an id count as larger than all
    others, among themselves by a digest of their text, and come back with a null id; ids from 2**63 - 2**40 on stand
    among them. Rows that share an id, or lack one and have one text, do not remove each other's words; ids are meant
    to be unique, and all that the rows of one id hold first is asked for each of them. Repeats inside one document stay.
    Long texts are parsed whole. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    if window - seed + 1 > 63:
        raise ValueError("a piece has at most 63 windows: take a longer seed")
    text = F.col(text_col).cast("string")
    none = F.lit(NULL_FROM) + F.shiftrightunsigned(F.xxhash64(text), 64 - NULL_BITS)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), none).alias("doc_id"), text.alias("text"))
    repeats = materialise(_repeats(rows, window, seed), "repeats")
    shared, bits = _bitmap(spark, repeats)
    drop(repeats)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            for s in text_slices(b):
                words = Words(s.column("text"))
                p = _Pieces(words, window, seed, bitmap, bits)
                if not len(p.key):
                    continue
                texts, held, at = [], -1, 0
                column = s.column("text")
                for r, first, n in zip(p.row.tolist(), p.start.tolist(), p.run.tolist(), strict=True):
                    if r != held:
                        tokens, held, at = column[r].as_buffer().to_pybytes().split(), r, int(words.first[r])
                    texts.append(b" ".join(tokens[first - at : first - at + n + window - 1]))
                ids = s.column("doc_id").take(pa.array(p.row))
                piece = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(p.low.view(np.int64)), piece, pa.array(p.key.view(np.int64)), ids], names=["low", "piece", "key", "doc"])

    # A passage that very many documents have is one piece here, with its smallest document.
    pieces = rows.mapInArrow(cut, "low long, piece string, key long, doc long").groupBy("low", "piece", "key").agg(F.min("doc").alias("doc"))
    pieces = materialise(pieces, "pieces")
    many = materialise(pieces.groupBy("low").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("low"), "hot")
    cold = pieces.join(sized(many), "low", "left_anti")
    # In the order of the minimizer, so that a partition's blocks have all pieces of theirs.
    firsts = cold.repartition("low").sortWithinPartitions("low").mapInArrow(_index(window, block_words), "doc long, key long, mask long")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = Words(b.column("piece"))
            w, inside = words.grams(words.hashes(), window)
            at = np.flatnonzero(inside)
            texts = [x.split() for x in utf8(b.column("piece"))]
            row = words.row[at]
            out = [b" ".join(texts[r][k : k + window]) for r, k in zip(row.tolist(), (at - words.first[row]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), pa.array(w[at].view(np.int64)), b.column("doc").take(pa.array(row))], names=["words", "key", "doc"])

    # Windows of the other minimizers meet one by one; of equal ones only the smallest document leaves a task.
    alone = pieces.join(sized(many), "low", "left_semi").mapInArrow(single, "words string, key long, doc long").groupBy("words", "key").agg(F.min("doc").alias("doc"))
    firsts = firsts.unionByName(alone.select("doc", "key", F.lit(-1).cast("long").alias("mask")))
    # What a document holds first: as many windows at most as it has words.
    firsts = firsts.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("key").alias("keys"), F.collect_list("mask").alias("masks"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            for s in text_slices(b):
                words = Words(s.column("text"))
                p = _Pieces(words, window, seed, bitmap, bits)
                size = np.asarray(pc.list_value_length(s.column("keys")).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
                flat = lambda c, s=s: np.asarray(s.column(c).flatten().to_numpy(zero_copy_only=False), np.int64)
                own, mask = _pair(np.repeat(np.arange(len(size)), size), flat("keys").view(U)), flat("masks")
                order = np.argsort(own, kind="stable")
                own, mask = own[order], mask[order]
                by_piece = _look(own, mask, _pair(p.row, p.key))
                first_here = (by_piece[p.piece] >> p.place & 1).astype(bool) | (_look(own, mask, _pair(p.row[p.piece], p.w)) == -1)
                start = p.at[~first_here]
                cover = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + window, -1)
                gone = np.cumsum(cover)[:-1] > 0
                removed = np.bincount(words.row, gone, words.rows).astype(np.int64)
                digest, spans = [], []
                for r, t in enumerate(utf8(s.column("text"))):
                    tokens, part = t.split(), gone[words.first[r] : words.first[r + 1]]
                    if removed[r]:
                        edge = np.flatnonzero(np.diff(np.r_[0, part.astype(np.int8), 0]))
                        spans.append(edge.reshape(-1, 2).tolist())
                        tokens = [x for x, g in zip(tokens, part.tolist(), strict=True) if not g]
                    else:
                        spans.append([])
                    digest.append(hashlib.sha256(b" ".join(tokens)).hexdigest())
                ranges = pa.array(spans, pa.list_(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(
                    [s.column("id"), pa.array(words.counts.astype(np.int64)), pa.array(removed), pa.array(digest), ranges],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"],
                )

    out = rows.join(firsts, "doc_id", "left").mapInArrow(parse, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<int>>")
    return out.select("*", F.size("spans").alias("n_factors"))


def _pair(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    # keys are 64-bit hashes already; rows of a slice are few
    return key ^ (row.astype(U) * U(0x9FB21C651E98DF25))


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of the wanted keys; 0 for those that aren't there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def op8_relative_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that an earlier document holds in a window of 13; see :func:`factors`."""
    return factors(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256", "n_factors")


SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM t),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS k FROM p),
f AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
s AS (SELECT g.doc_id, g.i FROM g JOIN f ON g.k = f.k WHERE f.least < g.doc_id),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM s),
n AS (SELECT doc_id, count(*) AS n_removed, list(j) AS js FROM r GROUP BY doc_id),
b AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM s),
c AS (SELECT doc_id, count(*) FILTER (WHERE gap IS NULL OR gap > 13) AS n_factors FROM b GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(js, i)) END, ' ')) AS kept_sha256,
  CAST(coalesce(n_factors, 0) AS INTEGER) AS n_factors
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN c ON c.doc_id = t.doc_id
"""
