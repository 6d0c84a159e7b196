"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated models over the bytes inside words, one of toxic and one of ordinary documents. Orders 6 to 4 are
counted by class; below them both share one chain of continuation counts, which smooths rare expressions alike. A
document's evidence is its log-likelihood ratio, normalised by length over the whole text and over its most telling
words; a logistic fit on held-back training rows turns it into a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import bound_batches, table, text_slices
from ._words import Words

U = np.uint64
#: At most about so many labelled rows and bytes of them are learnt from, picked by a hash of the id; a fifth of the rows sets the
#: logistic fit. The bytes bound the distinct 6-grams that the driver holds.
SAMPLE, SAMPLE_BYTES, FOLDS = 8000, 64 << 20, 5
ORDER, SHARED, DISCOUNT, CUT, THRESHOLD = 6, 3, 0.75, 4.0, 0.3
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _low(g: np.ndarray, n: int) -> np.ndarray:
    return g & U((1 << 8 * n) - 1)


class _Level:
    """Counts of n-grams, sorted, with totals by context."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams, kind="stable")
        grams, counts = grams[order], counts[order].astype(float)
        first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
        self.grams, self.counts = grams[first], np.add.reduceat(counts, first) if len(first) else counts
        context = self.grams >> U(8)
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.zeros(0, np.int64)
        self.context, self.total = context[first], np.add.reduceat(self.counts, first) if len(first) else self.counts
        self.kinds = np.diff(np.r_[first, len(context)]).astype(float)

    def smooth(self, q: np.ndarray, below: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return below
        at = np.minimum(np.searchsorted(self.context, q >> U(8)), len(self.context) - 1)
        seen = self.context[at] == q >> U(8)
        total = np.where(seen, self.total[at], 1.0)
        back = np.where(seen, DISCOUNT * self.kinds[at] / total, 1.0)
        at = np.minimum(np.searchsorted(self.grams, q), len(self.grams) - 1)
        own = np.where((self.grams[at] == q) & seen, np.maximum(self.counts[at] - DISCOUNT, 0) / total, 0.0)
        return own + back * below


class KneserNey:
    """``grams``: distinct packed 6-grams; ``counts``: how often each occurs in toxic and ordinary texts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        g = grams.astype(U)
        self.shared: list[_Level] = []
        for n in range(1, SHARED + 1):
            wide = np.unique(_low(g, n + 1))
            self.shared.append(_Level(_low(wide, n), np.ones(len(wide))))
        self.classes: list[list[_Level]] = []
        for c in range(2):
            mine = g[counts[:, c] > 0]
            levels = []
            for n in range(SHARED + 1, ORDER):
                wide = np.unique(_low(mine, n + 1))
                levels.append(_Level(_low(wide, n), np.ones(len(wide))))
            levels.append(_Level(mine, counts[counts[:, c] > 0, c]))
            self.classes.append(levels)

    def likelihoods(self, grams: np.ndarray) -> list[np.ndarray]:
        """log P(last byte | five bytes before) under the toxic and the ordinary model."""
        p = np.full(len(grams), 1 / 256)
        for n, level in enumerate(self.shared, 1):
            p = level.smooth(_low(grams, n), p)
        out = []
        for levels in self.classes:
            q = p
            for n, level in enumerate(levels, SHARED + 1):
                q = level.smooth(_low(grams, n), q)
            out.append(np.log(q))
        return out


def _grams(words: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed 6-grams of the picked words, from their first byte to an end mark; and where each word's begin."""
    start, size = words.starts[pick], (words.ends - words.starts)[pick]
    room = size + ORDER
    edge = np.r_[0, np.cumsum(room)]
    text = np.full(int(edge[-1]), 2, np.uint8)
    begin = np.cumsum(np.r_[0, size])
    inner = np.arange(int(begin[-1]))
    text[inner + np.repeat(edge[:-1] + ORDER - 1 - begin[:-1], size)] = _FOLD[words.data[inner + np.repeat(start - begin[:-1], size)]]
    text[edge[1:] - 1] = 3
    wide = text.astype(U)
    codes = np.zeros(len(text), U)
    for j in range(ORDER):
        codes[ORDER - 1 :] = codes[ORDER - 1 :] << U(8) | wide[j : len(wide) - ORDER + 1 + j]
    valid = np.ones(len(text), bool)
    valid[(edge[:-1, None] + np.arange(ORDER - 1)).reshape(-1)] = False
    return codes[valid], np.r_[0, np.cumsum(size + 1)]


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    h = words.hashes()
    _, pick, back = np.unique(h, return_index=True, return_inverse=True)
    return pick, back


def features(model: KneserNey, words: Words) -> np.ndarray:
    """For each text: its ratio a byte, that of its most telling word, the mean of its three most telling, and the log and share of words past ``CUT``."""
    out = np.zeros((words.rows, 5))
    if not len(words.starts):
        return out
    pick, back = _distinct(words)
    codes, edge = _grams(words, pick)
    grams, place = np.unique(codes, return_inverse=True)
    toxic, plain = model.likelihoods(grams)
    ratio = np.add.reduceat((toxic - plain)[place], edge[:-1])[back]
    size = (words.ends - words.starts + 1).astype(float)
    full = np.flatnonzero(words.counts)
    at = words.first[:-1][full]
    out[full, 0] = np.add.reduceat(ratio, at) / np.add.reduceat(size, at)
    clipped = np.clip(ratio, -12, 12)
    out[full, 1] = np.maximum.reduceat(clipped, at)
    order = np.lexsort((-clipped, words.row))
    rank = np.arange(len(order)) - np.repeat(words.first[:-1], words.counts)
    top = rank < 3
    out[:, 2] = np.bincount(words.row[order][top], clipped[order][top], words.rows) / np.maximum(np.minimum(words.counts, 3), 1)
    past = np.bincount(words.row, ratio > CUT, words.rows)
    out[:, 3] = np.log1p(past)
    out[:, 4] = past / np.maximum(words.counts, 1)
    return out


class Logistic:
    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 30):
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(5), np.ones(5))
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        w = np.zeros(z.shape[1])
        for _ in range(steps if len(set(y.tolist())) > 1 else 0):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            pull = ridge * np.r_[0, w[1:]]
            w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - pull)
        if len(set(y.tolist())) < 2:
            rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.05
            w[0] = np.log(rate / (1 - rate))
        self.w = w

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.w[0] + (x - self.mean) / self.scale @ self.w[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[KneserNey, Logistic]:
    """Fit on labelled rows that are not held out, at most about ``sample`` rows with ``sample_bytes`` bytes of text.

    Rows without a label, id or text teach nothing; of repeated labels the greatest counts, and of rows that repeat an id
    each is learnt from. Without labels, or with one kind only, all scores are one rate. Other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    picked = known.where(place < int(min(1.0, sample / max(known.count(), 1)) * (1 << 20)))
    size = docs.select("doc_id", F.octet_length(F.col("text").cast("string")).alias("n")).join(F.broadcast(picked), "doc_id").agg(F.sum("n")).first()[0] or 0
    if size > sample_bytes:
        picked = picked.where(place * size < F.lit(sample_bytes) * (1 << 20) * min(1.0, sample / max(known.count(), 1)))
    # Bounded by the sample: two numbers a row.
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in text_slices(b):
                words = Words(s.column("text"))
                toxic = s.column("toxic").to_numpy()[words.row]
                for c in (0, 1):
                    mine = np.flatnonzero((toxic > 0) == bool(c))
                    if len(mine):
                        codes, _ = _grams(words, mine)
                        g, n = np.unique(codes, return_counts=True)
                        none = np.zeros(len(g), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(n if c else none), pa.array(none if c else n)], names=["g", "t", "o"])

    got = rows.where("fold > 0").mapInArrow(count, "g long, t long, o long").groupBy("g").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).toArrow()
    model = KneserNey(got.column("g").to_numpy().astype(np.int64).view(U), np.c_[got.column("t").to_numpy(), got.column("o").to_numpy()] if len(got) else np.zeros((0, 2)))
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in text_slices(b):
                x = features(shared.value, Words(s.column("text")))
                yield pa.RecordBatch.from_arrays([s.column("toxic"), *(pa.array(x[:, k]) for k in range(5))], names=["toxic", *"abcde"])

    fit = rows.where("fold = 0").mapInArrow(measure, "toxic int, a double, b double, c double, d double, e double").toPandas()
    return model, Logistic(fit[list("abcde")].to_numpy(float).reshape(-1, 5), (fit["toxic"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: KneserNey, fit: Logistic, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``, repeated ones too; whole texts are read.

    Null texts count as empty; rows with a null id are scored and are not held out. Other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast((model, fit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, fit = shared.value
        for b in batches:
            for s in text_slices(b, limit=4 << 20):
                p = fit.score(features(model, Words(s.column("text"))))
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), s.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents, learnt from the labels of those whose crc32 leaves another rest than 2."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, *train(docs, table(spark, sf_dir, "labels")))
