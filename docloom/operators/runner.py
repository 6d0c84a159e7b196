"""Training and scoring by model: a registry of trainers, and runs that train, score a held-out share, or score by folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.schema import FIELDS
from . import evaluation as E
from . import perceptron

#: Models whose labels a trainer learns: the folds' models, the segmenter and the body.
MODELS = (*FIELDS, "segmenter", "full_text")
TRAINERS: dict[str, Callable[[DataFrame], perceptron.Model]] = {m: perceptron.train for m in MODELS}


def train(model: str, labeled: DataFrame) -> perceptron.Model:
    """The trained labeller of a model, from (doc_id, pos, tok, label)."""
    if model not in TRAINERS:
        raise ValueError(f"no trainer for {model}: {', '.join(TRAINERS)}")
    return TRAINERS[model](labeled)


def _scored(rows: DataFrame, fitted: perceptron.Model) -> DataFrame:
    return perceptron.decode(rows.select("doc_id", "pos", "tok", F.col("label").alias("gold")), fitted)


def split_evaluate(model: str, labeled: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Scores by label on the documents that the split holds out, learnt from the others."""
    parts = E.split(labeled, ratio)
    return E.token_report(_scored(parts.where("part = 'eval'"), train(model, parts.where("part = 'train'"))))


def fold_evaluate(model: str, labeled: DataFrame, n: int = 10) -> DataFrame:
    """Scores by fold and label: each fold of documents scored by a labeller learnt from the other folds."""
    dealt, out = E.folds(labeled, n), None
    for k in range(n):
        one = E.token_report(_scored(dealt.where(F.col("fold") == k), train(model, dealt.where(F.col("fold") != k)))).withColumn("fold", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out
