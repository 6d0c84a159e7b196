"""Feature lines of the token models: one builder, driven by a list of columns a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as X
from . import flow
from .gazetteer import CLASSES, flags, members
from .layout import POSITION_BINS

_BASE = ["tok", "low", "p1", "p2", "p3", "p4", "s1", "s2", "s3", "s4"]
_LAYOUT = ["line", "block"]
_KIND = ["caps", "digit", "single"]
VECTORS: dict[str, list[str]] = {
    "ner": ["tok", "low", "p1", "p2", "p3", "p4", "p5", "s1", "s2", "s3", "s4", "s5", *_KIND, "punct", "year", "month", "email", "http", "shape", "trimmed"],
    "header": [*_BASE, *_LAYOUT, *_KIND, "year", "month", "email", "http", "punct", "position"],
    "left_note": [*_BASE, *_LAYOUT, *_KIND, "year", "month", "email", "http", "punct", "position"],
    "full_text": [*_BASE, *_LAYOUT, *_KIND, "punct", "position"],
    "medic": [*_BASE, "line", *_KIND, "email", "http", "punct", "shape"],
    "patient": [*_BASE, "line", *_KIND, "year", "month", "email", "http", "punct", "shape"],
    "person_name": [*_BASE, "line", *_KIND, "punct"],
    "address": [*_BASE, "line", *_KIND, "punct", "shape"],
    "organization": [*_BASE, "line", *_KIND, "email", "http", "punct", "shape"],
    "dateline": [*_BASE, "line", *_KIND, "year", "month", "email", "http", "punct", "shape"],
}


#: Known names and places that the lines of a model look up.
KNOWN_OF = {
    "medic": ("title", "suffix", "name", "city", "country"),
    "patient": ("name", "title", "suffix"),
    "person_name": ("name", "title", "suffix"),
    "address": ("city", "country"),
    "organization": ("city", "country"),
    "dateline": ("city", "country"),
}


def vector(docs: DataFrame, model: str, replaced: DataFrame | None = None, lex: DataFrame | None = None, classes: tuple[str, ...] | None = None, key: str | None = None) -> DataFrame:
    """(doc_id, pos, features). With a map of pseudonyms, or a key that makes one, tokens are swapped first: features never show the original.
    With a lexicon, one flag for each of ``classes`` (all classes of entities unless given) stands at the end of a line."""
    if lex is None:
        return flow.lines(docs, VECTORS[model], POSITION_BINS, key, replaced)
    wanted = classes or CLASSES
    held = flags(lex, wanted)
    if held is not None:
        return flow.lines(docs, VECTORS[model], POSITION_BINS, key, replaced, (held, " ".join("0" * len(wanted))))
    return members(flow.lines(docs, VECTORS[model], POSITION_BINS, key, replaced, toks=True), lex, classes=wanted).select("doc_id", "pos", X.serialise(F.col("features"), *[F.col(f"is_{c}") for c in wanted]).alias("features"))
