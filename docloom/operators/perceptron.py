"""A trainable sequence labeller: averaged perceptron with transitions, decoded by Viterbi.

Sequential by nature, so Python. A sequence is a run of ``LONGEST`` tokens of one document, numbered before the rows are
dealt, so that the answer doesn't depend on how rows come in batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import flow
from .tokens import label_by_rules

#: Weights are hashed to a fixed number of slots, and at most so many tokens train them.
SLOTS, TOKENS, EPOCHS, LONGEST = 1 << 18, 40_000, 3, 256
#: Scores of so many distinct tokens stay known in a task.
KNOWN_TOKENS = 100_000


def _features(tok: str) -> list[int]:
    low = tok.lower()
    kind = "d" if tok.isdigit() else "U" if tok.isupper() else "C" if tok[:1].isupper() else "l" if tok.isalpha() else "p"
    size = str(min(len(tok), 8))
    return [zlib.crc32(x.encode()) % SLOTS for x in ("w=" + low, "k=" + kind, "ks=" + kind + size, "s3=" + low[-3:], "p2=" + low[:2], "at=" + str("@" in tok))]


class Model:
    def __init__(self, labels: list[str]):
        self.labels = labels
        self.emit, self.move = np.zeros((SLOTS, len(labels)), np.float32), np.zeros((len(labels) + 1, len(labels)), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        """The scores of the labels of each word."""
        out = np.zeros((len(words), len(self.labels)), np.float32)
        if words:
            for place in np.array([_features(w) for w in words]).T:
                out += self.emit[place]
        return out

    def decode(self, feats: list[list[int]]) -> np.ndarray:
        return self.path(np.array([self.emit[f].sum(0) for f in feats]))

    def path(self, score: np.ndarray) -> np.ndarray:
        """The best path through the scores of a sequence's tokens."""
        n, L = score.shape
        back = np.zeros((n, L), np.int64)
        best = score[0] + self.move[L]
        for i in range(1, n):
            step = best[:, None] + self.move[:L]
            back[i] = step.argmax(0)
            best = step.max(0) + score[i]
        path = np.zeros(n, np.int64)
        path[-1] = best.argmax()
        for i in range(n - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path

    def paths(self, score: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The best paths of many sequences, which lie one behind the other in ``score`` and have ``size`` tokens each: :meth:`path` for all at once."""
        order = np.argsort(-size, kind="stable")
        size, start = size[order], (np.cumsum(size) - size)[order]
        back, out, best = np.zeros(score.shape, np.int16), np.zeros(len(score), np.int64), score[start] + self.move[len(self.labels)]
        steps = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0))), side="left")  # sequences with more than i tokens
        for i, n in enumerate(steps.tolist(), 1):
            step, at = best[:n, :, None] + self.move[: len(self.labels)], start[:n] + i
            back[at] = step.argmax(1)
            best[:n] = step.max(1) + score[at]
        out[start + size - 1] = best.argmax(1)
        for i, n in reversed(list(enumerate(steps.tolist(), 1))):
            at = start[:n] + i
            out[at - 1] = back[at, out[at]]
        return out


def fit(sequences: list[tuple[list[str], list[str]]], epochs: int = EPOCHS) -> Model:
    labels = sorted({x for _, ls in sequences for x in ls}) or ["other"]
    place = {x: k for k, x in enumerate(labels)}
    m = Model(labels)
    emit, move, t, L = np.zeros_like(m.emit), np.zeros_like(m.move), 0, len(labels)
    made = [([_features(w) for w in ws], [place[x] for x in ls]) for ws, ls in sequences if ws]
    total = max(1, epochs * len(made))
    for _ in range(epochs):
        for feats, gold in made:
            guess = m.decode(feats)
            left = (total - t) / total  # averaging: an update counts for the steps that remain
            prev_g = prev_s = L
            for f, g, s in zip(feats, gold, guess.tolist(), strict=True):
                if g != s:
                    m.emit[f, g] += 1
                    m.emit[f, s] -= 1
                    emit[f, g] += left
                    emit[f, s] -= left
                if (prev_g, g) != (prev_s, s):
                    m.move[prev_g, g] += 1
                    m.move[prev_s, s] -= 1
                    move[prev_g, g] += left
                    move[prev_s, s] -= left
                prev_g, prev_s = g, s
            t += 1
    m.emit, m.move = emit, move
    return m


def train(labeled: DataFrame, most: int = TOKENS, epochs: int = EPOCHS) -> Model:
    """Fit on the documents whose id hashes lowest, up to about ``most`` tokens."""
    n = labeled.count()
    share = min(1.0, most / max(n, 1))
    return _fit(_sample(labeled, share), epochs)


def _sample(rows: DataFrame, share: float) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit("perceptron")), F.lit(1 << 20)) < int(share * (1 << 20)))


def _fit(labeled: DataFrame, epochs: int) -> Model:
    rows = labeled.orderBy("doc_id", "pos").select("doc_id", "tok", "label").toPandas()
    seqs = [(list(g["tok"])[k : k + LONGEST], list(g["label"])[k : k + LONGEST]) for _, g in rows.groupby("doc_id", sort=True) for k in range(0, len(g), LONGEST)]
    return fit(seqs, epochs)


def train_texts(docs: DataFrame, most: int = TOKENS, epochs: int = EPOCHS) -> Model:
    """:func:`train` on the rule labels of texts; only the texts of the sample are read as token rows."""
    sizes = flow.per_document(docs, lambda: lambda t: {"doc_id": np.arange(len(t.size)), "n": np.bincount(t.row[t.solid()], minlength=len(t.size))}, "n long")
    n = sizes.agg(F.sum("n")).first()[0] or 0
    return _fit(label_by_rules(flow.tokens(_sample(docs, min(1.0, most / max(n, 1))))), epochs)


def _guesses(shared):
    """The solid tokens of a slice with a guess: rows, numbers, rule labels of words, and numbers of guessed labels; sequences are cut as in training."""
    m = shared.value

    def guess(t: flow.Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = t.solid()
        row, code = t.row[at], t.code[at]
        scores = m.scores(t.words)
        count = np.bincount(row, minlength=len(t.size))
        number = (np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)) // LONGEST
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (number[1:] != number[:-1])][: len(at)])
        return at, t.of(flow.rule_label), m.paths(scores[code], np.diff(np.r_[first, len(at)])) if len(at) else at

    return guess


def decode_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, pos, tok, label, guess) of the tokens of all texts that aren't blank; sequences are cut as in training."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        of, names = _guesses(shared), np.array(shared.value.labels, object)

        def rows(t: flow.Tokens) -> dict:
            at, label, guess = of(t)
            code = t.code[at]
            return {"doc_id": t.row[at], "pos": t.pos[at], "tok": flow.taken(t, np.array(t.words, object), code), "label": flow.taken(t, label, code), "guess": flow.taken(t, names, guess)}

        return rows

    return flow.per_document(docs, make, "pos long, tok string, label string, guess string")


def confusion_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(label, guess, n): tokens of :func:`decode_texts` by rule label and guess, counted where they are decoded."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        of, names = _guesses(shared), shared.value.labels

        def rows(t: flow.Tokens) -> dict:
            at, label, guess = of(t)
            kinds = sorted(set(label.tolist()))
            place = {x: k for k, x in enumerate(kinds)}
            n = np.bincount(np.array([place[x] for x in label.tolist()], np.int64)[t.code[at]] * len(names) + guess) if len(at) else np.zeros(0, np.int64)
            met = np.flatnonzero(n)
            # a slice has one row at least, but counts belong to no row: the first stands for all
            return {"doc_id": np.zeros(len(met), np.int64), "label": [kinds[k // len(names)] for k in met.tolist()], "guess": [names[k % len(names)] for k in met.tolist()], "n": n[met].astype(np.int64)}

        return rows

    return flow.per_document(docs, make, "label string, guess string, n long").groupBy("label", "guess").agg(F.sum("n").alias("n"))


def decode(tokens: DataFrame, model: Model) -> DataFrame:
    """All columns and ``guess``. Sequences are runs of tokens of one document, cut at a fixed length as in training; a batch's last one waits for the next batch."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, names, known, held = shared.value, np.array(shared.value.labels, object), {}, None

        def answer(frame: pd.DataFrame) -> pd.DataFrame:
            guess = np.empty(len(frame), object)
            toks = frame["tok"].tolist()
            feats = []
            for w in toks:
                f = known.get(w)
                if f is None:
                    if len(known) > KNOWN_TOKENS:
                        known.clear()
                    f = known[w] = m.emit[_features(w)].sum(0)
                feats.append(f)
            score = np.array(feats).reshape(len(toks), -1)
            for index in frame.groupby(["doc_id", "__seq"], sort=False, dropna=False).indices.values():
                guess[index] = names[m.path(score[index])]
            return frame.drop(columns="__seq").assign(guess=guess)

        for frame in frames:
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            if not len(frame):
                continue
            same = (frame["__seq"] == frame["__seq"].iloc[-1]) & (frame["doc_id"].eq(frame["doc_id"].iloc[-1]) | (frame["doc_id"].isna() & pd.isna(frame["doc_id"].iloc[-1])))
            held = frame[same]
            if len(held) < len(frame):
                yield answer(frame[~same].reset_index(drop=True))
        if held is not None and len(held):
            yield answer(held.reset_index(drop=True))

    schema = ", ".join(f"`{n}` {t}" for n, t in tokens.dtypes) + ", guess string"
    number = F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1) / LONGEST)
    return tokens.withColumn("__seq", number).sortWithinPartitions("doc_id", "__seq", "pos").mapInPandas(run, schema)
