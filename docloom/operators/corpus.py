"""Annotated corpora: repair offsets, flag nested entities, annotate inline, read tagged XML and BioC."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import xml_escape
from ..plans.schema import ALIASES, FIELDS
from .tokens import ordered_join


def repair_offsets(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """Shift all offsets of a document by the error of its first entity: offset minus where its text stands."""
    rows = entities.join(docs.select("doc_id", F.col("text").alias("passage")), "doc_id")
    w = Window.partitionBy("doc_id").orderBy("offset", F.desc("length"), "text").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.expr("locate(text, passage)")
    error = F.first(F.when(place > 0, F.col("offset") - (place - 1)).otherwise(0)).over(w)
    return rows.withColumn("offset", (F.col("offset") - error).cast("long")).drop("passage")


def nested(entities: DataFrame) -> DataFrame:
    """A flag on entities that lie inside a longer one of their document. By running maxima over sorted spans: no pairs are made."""
    w = Window.partitionBy("doc_id").orderBy("offset", F.desc("length"), "type")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("offset") + F.col("length")
    # what begins earlier, or together and is listed first (longer), and reaches as far, holds the span; equal spans don't hold each other
    longest = F.max(F.struct(end.alias("e"), (-F.col("offset")).alias("s"))).over(before)
    inside = (longest["e"] > end) | ((longest["e"] == end) & (-longest["s"] < F.col("offset")))
    return entities.withColumn("is_nested", F.coalesce(inside, F.lit(False)).cast("int"))


def annotate_inline(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, tagged): texts with ``<type>..</type>`` around entities that aren't nested. The text is cut at their borders, nothing is shifted."""
    outer = nested(entities).where("is_nested = 0").dropDuplicates(["doc_id", "offset", "length"]).join(docs.select("doc_id", F.col("text").alias("passage")), "doc_id")
    w = Window.partitionBy("doc_id").orderBy("offset")
    start = F.coalesce(F.lag(F.col("offset") + F.col("length")).over(w), F.lit(0)).cast("int")
    rows = outer.withColumn("prev", start).withColumn("last", F.lead(F.lit(1)).over(w).isNull()).where("prev <= offset")
    cut = lambda a, n: xml_escape(F.substr("passage", (a + 1).cast("int"), n.cast("int")))
    end = F.col("offset") + F.col("length")
    piece = F.concat(cut(F.col("prev"), F.col("offset") - F.col("prev")), F.lit("<"), F.col("type"), F.lit(">"), cut(F.col("offset"), F.col("length")), F.lit("</"), F.col("type"), F.lit(">"), F.when(F.col("last"), cut(end, F.length("passage") - end)).otherwise(""))
    done = rows.withColumn("piece", piece).groupBy("doc_id").agg(ordered_join("piece", "offset", "").alias("tagged"))
    return docs.select("doc_id", "text").join(done, "doc_id", "left").select("doc_id", F.coalesce("tagged", xml_escape(F.col("text"))).alias("tagged"))


def tag_table(model: str) -> dict[str, str]:
    """Tag to label for a model's corpora: its labels, the tags of its records' fields, and aliases."""
    from .assembly import FRAGMENTS

    out = {label: label for label, _, _ in FIELDS[model]}
    for field, tag, _ in FRAGMENTS.get(model, ()):
        out.setdefault(tag, next(label for label, f, _ in FIELDS[model] if f == field))
    return out | {alias: label for alias, label in ALIASES.items() if label in out}


def read_tagged(files: DataFrame, tags: dict[str, str], xml_col: str = "xml") -> DataFrame:
    """(doc_id, pos, tok, label) of texts with inline tags; mixed content needs a real parser. Text outside known tags is ``other``; broken XML gives one row with the label ``error``."""

    def walk(node: ET.Element, label: str) -> Iterator[tuple[str, str, bool]]:
        own = tags.get(node.tag.rpartition("}")[2], ALIASES.get(node.tag, None)) or label
        new = own != label
        for word in (node.text or "").split():
            yield word, own, new
            new = False
        for child in node:
            yield from walk(child, own)
            for word in (child.tail or "").split():
                yield word, own, False

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, text in zip(frame["doc_id"], frame["xml"], strict=True):
                try:
                    root = ET.fromstring(text or "")
                except ET.ParseError as e:
                    out.append((doc, 0, str(e), "error"))
                    continue
                out += [(doc, pos, word, f"I-{label}" if begins and label != "other" else label) for pos, (word, label, begins) in enumerate(walk(root, "other"))]
            yield pd.DataFrame(out, columns=["doc_id", "pos", "tok", "label"])

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(xml_col).alias("xml")).mapInPandas(run, "doc_id long, pos long, tok string, label string")


def read_bioc(files: DataFrame, xml_col: str = "xml") -> DataFrame:
    """(doc_id, type, text, offset, length) of BioC collections, one row an annotation."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text in frame["xml"]:
                for document in ET.fromstring(text).iter("document"):
                    name = document.findtext("id", "")
                    for a in document.iter("annotation"):
                        kind = next((i.text or "" for i in a.iter("infon") if i.get("key") == "type"), "")
                        out += [(name, kind, a.findtext("text", ""), int(x.get("offset", "0")), int(x.get("length", "0"))) for x in a.iter("location")]
            yield pd.DataFrame(out, columns=["doc_id", "type", "text", "offset", "length"])

    return files.select(F.col(xml_col).alias("xml")).mapInPandas(run, "doc_id string, type string, text string, offset long, length long")
