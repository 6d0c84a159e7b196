"""Encoding and decoding with a SentencePiece model on the tokenizers library.

The model's protobuf is parsed here: pieces with scores and kinds, the kind of model, and the normaliser. From these the
normaliser, the space marker, the unigram scores or BPE merges, and byte fallback are rebuilt. Texts are encoded in
batches on several threads. Where no piece holds a marker behind another character (true of models that split at
spaces), a text's tokens are those of its marked words, so that each distinct word of a batch is encoded once.
Distinct words are compared with the sentencepiece library (``parity``) and decoded back (``round_trip``).
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import bound_batches, table, text_slices, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown piece reads as.
UNKNOWN_TEXT = " \u2047 "


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message: ints, 4- or 8-byte strings, or bytes."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                if kind != 2:
                    raise ValueError(f"unknown wire type {kind}")
                size = varint()
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """What the protobuf of a model says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unk = 1, False, 0
        self.charsmap, self.prefix, self.squeeze, self.escape = b"", True, True, True
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        self.kind = v
                    elif n == 35:
                        self.byte_fallback = bool(v)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        self.charsmap = v
                    elif n == 3:
                        self.prefix = bool(v)
                    elif n == 4:
                        self.squeeze = bool(v)
                    elif n == 5:
                        self.escape = bool(v)
        self.unk = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        if self.kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")


def build_normalizer(model: PieceModel):
    """What the model does to a text before it is cut, or None where that is nothing."""
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.prefix:
        steps.append(normalizers.Prepend(MARK))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence(steps) if steps else None


def build(model: PieceModel, merged: tuple[int, ...] = (NORMAL, USER, UNUSED)):
    """A ``tokenizers.Tokenizer`` over normalised texts that does what the model says.

    Only normal and user-defined pieces can stand in a text. Unigram: control, unknown, byte and unused pieces get a name
    that texts don't have and so keep their ids; a user-defined piece scores as its bytes times the best score, as the
    model's own library has it, and so is taken whole; unknown characters come out as the unknown piece, and
    :class:`Codec` puts their bytes. BPE: unused pieces merge and are taken apart again by the codec.
    """
    from tokenizers import AddedToken, Tokenizer, decoders, models

    if model.kind == 1:
        normal = [s for _, s, k in model.pieces if k == NORMAL]
        best, least = max(normal, default=0.0), min(normal, default=0.0)
        score = {NORMAL: lambda p, s: s, USER: lambda p, s: len(p.encode()) * best - 0.1}
        hidden = lambda i: f"\U0010ffff\U0010fffe{i}\U0010ffff"
        vocab = [(p, score[k](p, s)) if k in score else (hidden(i), least) for i, (p, s, k) in enumerate(model.pieces)]
        tok = Tokenizer(models.Unigram(vocab, model.unk, False))
    else:
        normal = {p: (i, s) for i, (p, s, k) in enumerate(model.pieces) if k in merged}
        merges = sorted((-s, normal[p[:k]][0], normal[p[k:]][0], p[:k], p[k:]) for p, (_, s) in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal)
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        tok = Tokenizer(models.BPE(vocab=vocab, merges=[m[3:] for m in merges], unk_token=model.pieces[model.unk][0], fuse_unk=True, byte_fallback=model.byte_fallback))
        user = [AddedToken(p, normalized=False, special=False) for p, _, k in model.pieces if k == USER]
        if user:
            tok.add_tokens(user)
    lead = [decoders.Strip(" ", 1, 0)] if model.prefix else []
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *lead])
    return tok


def unused_parts(model: PieceModel) -> dict[int, list[int]]:
    """Ids of unused BPE pieces, and the ids that their text has by the merges of all other pieces."""
    unused = [(i, p) for i, (p, _, k) in enumerate(model.pieces) if k == UNUSED]
    if model.kind != 2 or not unused:
        return {}
    tok = build(model, (NORMAL, USER))
    return {i: ids for i, p in unused for ids in [tok.encode(p, add_special_tokens=False).ids] if ids != [i]}


class Codec:
    """Encoder and decoder of one process. Distinct words stay known between batches, up to ``held`` words and ``held_bytes`` of text."""

    def __init__(self, data: bytes, threads: int = 2, held: int = 250_000, held_bytes: int = 16 << 20, parity: bool = True):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        import sentencepiece

        self.model = PieceModel(data)
        self.tok, self.normalizer = build(self.model), build_normalizer(self.model)
        self.parts = unused_parts(self.model)
        kinds = self.model.pieces
        self.bytes = [i for _, i in sorted((int(p[3:5], 16), i) for i, (p, _, k) in enumerate(kinds) if k == BYTE)]
        self.fallback = self.model.kind == 1 and self.model.byte_fallback and len(self.bytes) == 256
        self.surface = [MARK.join(p.split(" ")) if k in (NORMAL, USER, UNUSED) else "" for p, _, k in kinds]
        self.byte_of = {i: n for n, i in enumerate(self.bytes)}
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data) if parity else None
        plain = not self.model.charsmap and not self.model.squeeze and self.model.prefix and self.model.escape
        inner = any(MARK in p.lstrip(MARK) for p, _, k in kinds if k in (NORMAL, USER, UNUSED)) or any(k == USER for _, _, k in kinds)
        self.by_word = plain and not inner
        self.held, self.held_bytes, self.words, self.known_bytes = held, held_bytes, {}, 0
        self._reset()

    def _reset(self) -> None:
        self.words.clear()
        self.known_bytes = 0
        self.ids, self.size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        self.fine = [np.zeros(0, bool)]
        self.flat = None

    def tokens(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, through the normaliser and the model on several threads."""
        normal = [self.normalizer.normalize_str(t) for t in texts] if self.normalizer is not None else texts
        if self.fallback:
            out = []
            for text, e in zip(normal, self.tok.encode_batch(normal, add_special_tokens=False), strict=True):
                ids = e.ids
                if self.model.unk in ids:
                    spans = zip(ids, e.offsets, strict=True)
                    ids = [x for i, (a, b) in spans for x in ([self.bytes[n] for n in text[a:b].encode()] if i == self.model.unk else (i,))]
                out.append(ids)
            return out
        got = [e.ids for e in self.tok.encode_batch_fast(normal, add_special_tokens=False)]
        if self.parts:
            got = [[x for i in ids for x in self.parts.get(i, (i,))] for ids in got]
        return got

    def _split(self, text: str) -> list[str]:
        """Marked words, without the first mark: 'a  b' gives 'a' and MARK + 'b'."""
        if not text:
            return []
        if MARK in text:
            return [x[1:] for x in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]
        words = text.split(" ")
        if "" in words:
            out, ahead = [], ""
            for w in words[:-1]:
                if w:
                    out.append(ahead + w)
                    ahead = ""
                else:
                    ahead += MARK
            return [*out, ahead + words[-1]]
        return words

    def _learn(self, new: list[str]) -> None:
        texts = [w.replace(MARK, " ") for w in new]
        got = self.tokens(texts)
        self.known_bytes += sum(map(len, new))
        # The empty word is a lone mark, which a text only has behind other words.
        mark = self.tok.token_to_id(MARK)
        for k, w in enumerate(new):
            if not w:
                got[k] = [mark] if mark is not None else got[k]
        size = np.fromiter(map(len, got), np.int64, len(got))
        self.ids.append(np.fromiter((i for x in got for i in x), np.int32, int(size.sum())))
        self.size.append(size)
        fine = np.array([a == b for a, b in zip(self.decode(got), texts, strict=True)], bool)
        if self.reference is not None:
            fine &= np.array([not w or a == b for w, a, b in zip(new, got, self.reference.encode(texts, num_threads=1), strict=True)], bool)
        self.fine.append(fine)
        self.flat = None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, offsets, whether each text agrees: same ids as the sentencepiece library gives, and they decode to the same text as there, whole words to themselves)."""
        if not self.by_word:
            got = self.tokens(texts)
            size = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((i for x in got for i in x), np.int32, int(size.sum()))
            fine = np.ones(len(got), bool)
            if self.reference is not None:
                want = self.reference.encode(texts, num_threads=1)
                back = [self.reference.decode(x) for x in want]
                fine = np.array([a == b and c == d for a, b, c, d in zip(got, want, self.decode(got), back, strict=True)], bool)
            return flat, np.r_[0, np.cumsum(size)], fine
        if len(self.words) > self.held or self.known_bytes > self.held_bytes:
            self._reset()
        words, index, new = self.words, [], []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            parts = self._split(text)
            counts[k] = len(parts)
            for w in parts:
                n = words.get(w)
                if n is None:
                    n = words[w] = len(words)
                    new.append(w)
                index.append(n)
        if new:
            self._learn(new)
        if self.flat is None:
            self.ids, self.size, self.fine = [np.concatenate(self.ids)], [np.concatenate(self.size)], [np.concatenate(self.fine)]
            self.flat = np.r_[0, np.cumsum(self.size[0])]
        at = np.array(index, np.int64)
        size = self.size[0][at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) + np.repeat(self.flat[at] - (ends - size), size)
        edges = np.r_[0, np.cumsum(counts)]
        offsets = np.r_[0, ends][edges]
        wrong = np.r_[0, np.cumsum(~self.fine[0][at])][edges]
        return self.ids[0][take], offsets, np.diff(wrong) == 0

    def decode(self, ids: list[list[int]]) -> list[str]:
        if self.model.kind != 1:
            return self.tok.decode_batch(ids, skip_special_tokens=False)
        return [self._text(x) for x in ids]

    def _text(self, ids: list[int]) -> str:
        """The text of unigram ids: control pieces are nothing, the unknown piece a mark of its own, runs of byte pieces UTF-8."""
        out, run = [], bytearray()
        for i in ids:
            if not 0 <= i < len(self.surface):
                continue
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            out.append(run.decode(errors="replace"))
            run.clear()
            out.append(UNKNOWN_TEXT if i == self.model.unk else self.surface[i])
        text = "".join([*out, run.decode(errors="replace")]).replace(MARK, " ")
        return text.removeprefix(" ") if self.model.prefix else text


def model_bytes(spark: SparkSession, path: str) -> bytes:
    """The model's file, from the driver's disk or through Spark."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


_CODECS: dict[tuple, Codec] = {}


def _codec(data: bytes, **how) -> Codec:
    """One codec for a Python worker, however many batches and tasks it serves."""
    key = (hash(data), *sorted(how.items()))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(data, **how)
    return _CODECS[key]


def encode_column(docs: DataFrame, text_col: str = "text", path: str = MODEL, keep: tuple[str, ...] = ("doc_id",), parity: bool = True) -> DataFrame:
    """``keep`` columns with n_tokens, ids and agrees (same ids as the sentencepiece library, and words decode to themselves).

    Null and empty texts have no tokens. A literal marker character is a space to the model and decodes as one, in either library. Other columns are ignored; rows may repeat; whole texts are encoded.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model_bytes(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, parity=parity)
        for b in batches:
            for s in text_slices(b, "__text", 2 << 20):
                texts = [t.decode() for t in utf8(s.column("__text"))]
                ids, offsets, fine = codec.encode(texts)
                listed = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in keep), pa.array(np.diff(offsets)), listed, pa.array(fine)], names=[*keep, "n_tokens", "ids", "agrees"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens long, ids array<int>, agrees boolean"
    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def decode_column(df: DataFrame, ids_col: str = "ids", path: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with the text of the ids; null ids give a null text. Ids outside the vocabulary are dropped by the backend."""
    spark = df.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model_bytes(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, parity=False)
        for b in batches:
            rows = b.column("__ids").to_pylist()
            texts = codec.decode([x or [] for x in rows])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([None if x is None else t for x, t in zip(rows, texts, strict=True)], pa.string())], names=[*keep, "text"])

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string"
    return df.select(*keep, F.col(ids_col).alias("__ids")).mapInArrow(run, schema)


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents; see :func:`encode_column`."""
    return encode_column(table(spark, sf_dir, "documents"))
