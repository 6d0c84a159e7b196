"""Mixing sources to target weights by temperature.

Shares of tokens are raised to an exponent and normalised; the exponent is bisected until the weights have the
target entropy or no source repeats more often than allowed. A source's budget is its weight of the whole budget: it
gives whole passes over its documents, each a block with a permutation of its own, and a prefix of one more block.
Places and running tokens inside a block come from totals over ranges of the permutation's key, so that a source of
any size spreads over many tasks.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import materialise, table

SEED, RANGE_ROWS, MAX_SOURCES = 7, 4000, 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def weights(tokens: np.ndarray, exponent: float) -> np.ndarray:
    """Normalised shares to the power ``exponent``; sources without tokens get no weight."""
    share = np.asarray(tokens, float)
    w = np.where(share > 0, np.exp(exponent * np.log(np.maximum(share, 1) / max(share.sum(), 1))), 0.0)
    return w / w.sum() if w.sum() else w


def entropy(w: np.ndarray) -> float:
    w = w[w > 0]
    return float(-(w * np.log(w)).sum())


def passes(tokens: np.ndarray, w: np.ndarray, budget: float | None) -> np.ndarray:
    """How often each source is read. Without a budget, the least-read source is read once in full."""
    n = np.maximum(np.asarray(tokens, float), 1)
    if budget is None:
        live = w > 0
        budget = float((n[live] / w[live]).max()) if live.any() else 0.0
    return w * budget / n


def exponent(tokens: np.ndarray, target_entropy: float | None = None, max_passes: float | None = None, budget: float | None = None, steps: int = 60) -> float:
    """The largest exponent in 0..1 whose weights reach the target entropy, raised until no source is read over ``max_passes`` times.

    Entropy falls as the exponent grows, and so do the most passes: both are bisected. A limit that exponent 1 breaks gives 1.
    """

    def bisect(meets_low) -> float:
        low, high = 0.0, 1.0
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if meets_low(mid) else (low, mid)
        return (low + high) / 2

    found = 1.0
    if target_entropy is not None and entropy(weights(tokens, 1.0)) < target_entropy:
        found = bisect(lambda x: entropy(weights(tokens, x)) >= target_entropy)
    if max_passes is not None and passes(tokens, weights(tokens, found), budget).max(initial=0) > max_passes:
        found = max(found, bisect(lambda x: passes(tokens, weights(tokens, x), budget).max(initial=0) > max_passes))
    elif target_entropy is None and max_passes is not None:
        found = 0.0 if passes(tokens, weights(tokens, 0.0), budget).max(initial=0) <= max_passes else bisect(lambda x: passes(tokens, weights(tokens, x), budget).max(initial=0) > max_passes)
    return found


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    entropy_share: float | None = 0.9,
    max_passes: float | None = 4.0,
    budget: float | str | None = "corpus",
    seed: int = SEED,
    range_rows: int = RANGE_ROWS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each document in the mixture: source, block, position, doc_id, n_tokens, tokens_before, weight, progress.

    Tokens are words. ``entropy_share`` is the target entropy as a share of the most that the sources allow. ``budget``
    counts tokens; "corpus" means as many as there are, None as many as read each source once or more. Whole blocks
    hold every document of their source; the last block is cut before the document that would pass the budget.
    progress is the share of its source's budget that comes before a document: in its order, sources interleave at
    their weights. Columns in ``keep`` come along in a struct ``row``. Documents without tokens are in every whole block
    and take nothing; a source without tokens is read once. A null source is a source of its own. Repeated rows and null
    ids are documents like others. An empty table gives an empty mixture.
    """
    spark = docs.sparkSession
    row = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("\0null")).alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("key"),
        *row,
    )
    base = materialise(base, "mix")
    sizes = base.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources: group them first")
    n = np.array([r["n"] for r in sizes], float)
    total = float(n.sum()) if budget == "corpus" else budget
    most = math.log(max(1, int((n > 0).sum())))
    x = exponent(n, None if entropy_share is None else entropy_share * most, max_passes, total)
    w = weights(n, x)
    times = np.where(n > 0, passes(n, w, total), 1.0)
    rows = []
    for r, weight, k in zip(sizes, w.tolist(), times.tolist(), strict=True):
        whole = int(math.floor(k + 1e-9))
        rest = (k - whole) * r["n"] if k > whole else 0.0
        rows.append((r["source"], weight, whole, rest, float(r["n"]), k * r["n"], max(1, math.ceil(r["docs"] / range_rows))))
    plan = spark.createDataFrame(rows, "source string, weight double, whole int, rest double, block_tokens double, source_budget double, ranges int")
    # Sources are few by the check above; the plan holds seven numbers for each. The last block is left out where nothing is due of it.
    last = F.col("whole") - F.when(F.col("rest") > 0, 0).otherwise(1)
    dealt = base.join(F.broadcast(plan), "source").where("whole > 0 or rest > 0").withColumn("block", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.withColumn("key", F.xxhash64("key", F.lit(seed), "block"))
    dealt = dealt.withColumn("range", F.floor(F.shiftrightunsigned("key", 33) * F.col("ranges") / F.lit(2.0**31)).cast("int"))
    group = ["source", "block", "range"]
    totals = dealt.groupBy(group).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c"))
    before = Window.partitionBy("source", "block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    inner = Window.partitionBy(*group).orderBy(F.shiftrightunsigned("key", 1), "key", F.col("doc_id").asc_nulls_last())
    run = F.coalesce(F.sum("n_tokens").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("at", F.row_number().over(inner)).withColumn("run", run).join(totals, group)
    placed = placed.withColumn("tokens_before", F.col("t0") + F.col("run")).withColumn("position", F.col("c0") + F.col("at") - 1)
    placed = placed.where((F.col("block") < F.col("whole")) | (F.col("tokens_before") + F.col("n_tokens") <= F.col("rest")))
    return placed.select(
        F.when(F.col("source") != "\0null", F.col("source")).alias("source"),
        "block",
        F.col("position").cast("long").alias("position"),
        "doc_id",
        "n_tokens",
        F.col("tokens_before").cast("long").alias("tokens_before"),
        "weight",
        ((F.col("block") * F.col("block_tokens") + F.col("tokens_before")) / F.greatest("source_budget", F.lit(1.0))).alias("progress"),
        *(["row"] if keep else []),
    )


def op6_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents mixed to nine tenths of the sources' greatest entropy, at most four passes, over as many tokens as there are."""
    return mix(table(spark, sf_dir, "documents"))
