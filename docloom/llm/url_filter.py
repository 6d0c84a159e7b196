"""URL filters: host and path rules, then gradient-boosted trees on lexical features.

Features are length, depth, digit ratio, entropy, parameter counts and statistics of the address suffix. The trees are
fitted on a bounded sample of labelled URLs; suffix counts cover all rows, in a fixed number of hash buckets.

Rates by suffix and site come from labels. Every URL belongs to a fold by the document it leads to, and its rates are
taken from the labels of the other folds, when trees are fitted and when URLs are judged: no URL meets its own label in
its features. The number of trees is the one with the least loss on a fold that was held back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import bound_batches, materialise, table

#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SAMPLE, BUCKETS, PRIOR, FOLDS = 20_000, 4096, 20.0, 5
NAMES = ("length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "params", "query_length", "hyphens", "symbols", "suffix_rate", "suffix_share", "site_rate")


def address(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(u, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(u, pattern, 2)


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


class Trees:
    """Boosted trees with logistic loss over quantile bins. ``fit`` is deterministic."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 32, leaf: float = 10.0, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.leaf, self.ridge = trees, depth, rate, bins, leaf, ridge
        self.base, self.cuts, self.trees = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray | None = None) -> Trees:
        """Boost on all rows; with ``held`` (a flag by row), only up to the number of trees, maybe none, that serves the held-back rows best when fitted on the others."""
        if held is not None and held.any() and not held.all():
            trial = Trees(self.n, self.depth, self.rate, self.bins, self.leaf, self.ridge).fit(x[~held], y[~held])
            losses = [_loss(y[held], f) for f in trial.margins(x[held])]
            return Trees(int(np.argmin(losses)), self.depth, self.rate, self.bins, self.leaf, self.ridge).fit(x, y)
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.02
        self.base = float(np.log(rate / (1 - rate)))
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T] if len(x) else [np.zeros(0)] * len(NAMES)
        self.trees = []
        if len(np.unique(y)) < 2:
            return self
        b = self._bin(x)
        f = np.full(len(y), self.base)
        wide = self.bins + 1
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            column, cut = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1, np.int64)
            for level in range(self.depth):
                size, off = 1 << level, (1 << level) - 1
                best = np.zeros(size)
                for k in range(x.shape[1]):
                    slot = node * wide + b[:, k]
                    G = np.bincount(slot, g, size * wide).reshape(size, wide).cumsum(1)
                    H = np.bincount(slot, h, size * wide).reshape(size, wide).cumsum(1)
                    left, right = H, H[:, -1:] - H
                    gain = G**2 / (left + self.ridge) + (G[:, -1:] - G) ** 2 / (right + self.ridge) - G[:, -1:] ** 2 / (H[:, -1:] + self.ridge)
                    gain[(left < self.leaf * 0.1) | (right < self.leaf * 0.1)] = 0
                    top = gain.argmax(1)
                    win = gain[np.arange(size), top] > best + 1e-9
                    best = np.where(win, gain[np.arange(size), top], best)
                    column[off : off + size][win], cut[off : off + size][win] = k, top[win]
                at = off + node
                go = (column[at] >= 0) & (b[np.arange(len(y)), np.maximum(column[at], 0)] > cut[at])
                node = 2 * node + go
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            f += value[node]
            self.trees.append((column, cut, value))
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, col, side="left") for c, col in zip(self.cuts, x.T, strict=True)], 1) if len(x) else np.zeros(x.shape, np.int64)

    def margins(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Log-odds of the rows with no tree, one, two ..."""
        b, f = self._bin(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        yield f
        for column, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + ((column[at] >= 0) & (b[rows, np.maximum(column[at], 0)] > cut[at]))
            f = f + value[node]
            yield f

    def score(self, x: np.ndarray) -> np.ndarray:
        *_, f = self.margins(x)
        return 1 / (1 + np.exp(-f))


def _loss(y: np.ndarray, margin: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0, -margin, margin)).mean())


def _entropy(data: bytes) -> float:
    if not data:
        return 0.0
    n = np.bincount(np.frombuffer(data, np.uint8))
    p = n[n > 0] / len(data)
    return float(-(p * np.log2(p)).sum())


def lexical(url: str | None, host: str, path: str) -> list[float]:
    """The features of one URL that need no statistics."""
    url = url or ""
    data = url.encode()
    query = url.partition("?")[2].partition("#")[0]
    size = max(len(url), 1)
    return [len(url), len(host), len(path), path.count("/"), host.count(".") + bool(host), sum(map(str.isdigit, url)) / size, _entropy(data), sum(1 for x in query.split("&") if x), len(query), url.count("-"), sum(not c.isalnum() for c in url) / size]


def _number(url: Column) -> Column:
    """The number that ends an address, that of the document it leads to; empty without one."""
    return F.regexp_extract(url, r"://[^/?#]*/(?:[^/?#]+/)*?([0-9]{1,18})(?:[./?#]|$)", 1)


def _with_buckets(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    host, path = address(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    group = F.coalesce(F.nullif(_number(F.col("url")), F.lit("")), F.col("url"), F.lit(""))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(group, F.lit("fold")), F.lit(FOLDS)).cast("int"))
    return rows.withColumn("suffix", bucket(F.regexp_extract("host", r"([^.]*)$", 1))).withColumn("site", bucket(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)))


def fit_filter(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE) -> tuple[Trees, np.ndarray]:
    """``labels``: (page_id, bad). Returns the trees and, for each fold and suffix bucket, the bad rate outside the fold, the share of all rows, and the site bucket's bad rate outside the fold.

    Null ids and labels teach nothing; of repeated labels the worst counts; rows that repeat a page_id are rows like others.
    Without labels no URL is bad beyond a small prior, and the trees are none.
    """
    rows = _with_buckets(pages, id_col, url_col)
    known = rows.join(labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("int").alias("bad")), "page_id")
    known = materialise(known, "urls")
    stats = np.zeros((FOLDS, BUCKETS, 3))
    n = 0
    for kind, place in (("suffix", 0), ("site", 2)):
        # At most as many cells as buckets and folds.
        counts = np.zeros((FOLDS, BUCKETS, 2))
        for r in known.groupBy("fold", kind).agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).collect():
            counts[r["fold"], r[kind]] = r["n"], r["bad"]
        n = int(counts[:, :, 0].sum())
        others = counts.sum(0, keepdims=True) - counts
        rate = ((others[:, :, 1].sum(1) + 0.5) / (others[:, :, 0].sum(1) + 1))[:, None]
        stats[:, :, place] = (others[:, :, 1] + PRIOR * rate) / (others[:, :, 0] + PRIOR)
    seen = rows.groupBy("suffix").count().collect()
    every = sum(r["count"] for r in seen)
    for r in seen:
        stats[:, r["suffix"], 1] = r["count"] / every
    share = min(1.0, sample / max(n, 1))
    picked = known.where(F.pmod(F.xxhash64("page_id", F.lit("urls")), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy("page_id", "url").toPandas()
    fold = picked["fold"].to_numpy(int)
    x = _features(picked["url"].tolist(), picked["host"].tolist(), picked["path"].tolist(), fold, picked["suffix"].to_numpy(int), picked["site"].to_numpy(int), stats)
    return Trees().fit(x, picked["bad"].to_numpy(float), fold == 0), stats


def _features(url: list, host: list, path: list, fold: np.ndarray, suffix: np.ndarray, site: np.ndarray, stats: np.ndarray) -> np.ndarray:
    own = np.array([lexical(*r) for r in zip(url, host, path, strict=True)], float).reshape(-1, len(NAMES) - 3)
    return np.c_[own, stats[fold, suffix, 0], stats[fold, suffix, 1], stats[fold, site, 2]]


def judge(pages: DataFrame, model: Trees, stats: np.ndarray, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row.

    A rule's verdict stands; else "block" from ``threshold`` on. Null URLs have empty host and path and are scored like
    others; null and repeated ids come back as they are, a row each. Long URLs are read whole. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast((model, stats))
    rows = _with_buckets(pages, id_col, url_col)
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("verdict", verdict)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, stats = shared.value
        for b in batches:
            col = {c: b.column(c) for c in b.schema.names}
            place = (col[c].to_numpy() for c in ("fold", "suffix", "site"))
            p = model.score(_features(col["url"].to_pylist(), col["host"].to_pylist(), col["path"].to_pylist(), *place, stats))
            told = [v or ("block" if s >= threshold else "allow") for v, s in zip(col["verdict"].to_pylist(), p, strict=True)]
            yield pa.RecordBatch.from_arrays([col["page_id"], col["host"], col["path"], col["rule"], pa.array(told, pa.string()), pa.array(p)], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad): the quality label of the document whose number ends a page's address; low quality is bad."""
    number = _number(F.col("url"))
    keyed = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id")).where("doc_id is not null")
    return keyed.join(labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id").select("page_id", (F.col("quality") == 0).cast("int").alias("bad"))


def op3_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for all pages: by rule, else by trees learnt from the quality labels of the documents behind labelled pages."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return judge(pages, *fit_filter(pages, page_labels(pages, labels)))
