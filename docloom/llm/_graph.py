"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import drop, materialise


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contract edges held by one task to (node, smallest node of its part): fewer rows, the same components."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = flat[: len(u)], flat[len(u) :], np.arange(len(nodes))
    while True:
        before = label
        low = np.minimum(label[a], label[b])
        label = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    move = label != np.arange(len(nodes))
    return nodes[move], nodes[label[move]]


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges``: columns u, v. Returns (node, root) for each node that is not the smallest of its component.

    Each round writes the edges to the shared folder and deletes those of the round before. Rounds grow with the logarithm of the longest path;
    minima are pre-aggregated, so a hub costs no more than its edges. Self-loops and repeats are harmless.
    """
    e = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    sign = None
    for _ in range(rounds):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == sign or not now[0]:
            break
        sign = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        e, old = materialise(small, "edges"), e
        drop(old)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
