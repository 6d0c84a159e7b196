"""Whole documents and single strings through the cascade: zones, labels, folds, XML. Rule labellers stand where trained ones would."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.schema import FIELDS
from . import assembly as A
from . import extraction as X
from . import tokens as K
from .layout import text_lines

_CAPITAL = lambda t: t.rlike(r"^\p{Lu}\p{L}+$")
_TITLE = lambda t: F.lower(t).isin("docteur", "dr", "professeur", "pr", "chef", "interne")
_MAIL = lambda t: F.contains(t, F.lit("@")) & (F.length(t) > 1)
_NUMBER = lambda t: t.rlike(r"^\p{N}+$")
_DATE = lambda t: t.rlike(r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}$")
#: Tokens of single strings: dates and emails whole.
STRING_TOKEN = r"\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\p{L}+|\p{N}+|[^\p{L}\p{N}]"
LABELLERS = {
    "medic": (("rolename", _TITLE), ("email", _MAIL), ("phone", _NUMBER), ("persname", _CAPITAL)),
    "patient": (("birthdate", _DATE), ("email", _MAIL), ("idno", lambda t: _NUMBER(t) & (F.length(t) >= 6)), ("sex", lambda t: F.lower(t).isin("madame", "monsieur", "mme")), ("persname", _CAPITAL)),
    "dateline": (("date", _DATE), ("time", lambda t: t.rlike(r"^\d{1,2}h\d{0,2}$")), ("place", _CAPITAL)),
}


def labelled(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, pos, ws, tok, char_offset, label) of strings by the rules of a model."""
    return K.label_by_rules(K.spaced_tokens(docs, STRING_TOKEN), LABELLERS[model])


def string_records(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, xml): each string of ``docs`` as one record of the model; strings without a field have no row."""
    runs = K.cluster(labelled(docs, model)).groupBy("doc_id", "cluster_no", "label").agg(K.ordered_join("tok", "pos", " ").alias("text"))
    return X.fold(runs, model).select("doc_id", A.fragment(model).alias("xml")).where("xml <> ''")


def string_tags(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, tagged): each string with inline tags."""
    return K.inline_tags(labelled(docs, model), {label: label for label, _ in LABELLERS[model]})


def header_label(line: Column, first: Column) -> Column:
    """A label for a line of the header zone."""
    return (
        F.when(line.rlike(r"\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}"), "date")
        .when(line.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), "email")
        .when(line.rlike(r"(?i)^(docteur|dr|pr|professeur)[ .]"), "medic")
        .when(first, "title")
        .otherwise("note")
    )


def body_label(line: Column) -> Column:
    """A label for a line of the body: numbered heads, items, paragraphs."""
    return F.when(line.rlike(r"^\d+(\.\d+)+\.?\s+\p{L}"), "subsection").when(line.rlike(r"^\d+\.?\s+\p{Lu}"), "section").when(line.rlike(r"^\s*[-•]\s"), "item").otherwise("paragraph")


def zoned_lines(docs: DataFrame) -> DataFrame:
    """Lines of whole documents with their zone as ``label``; one distribution by doc_id serves all branches."""
    return X.label_zones(text_lines(docs.where(F.trim(F.coalesce("text", F.lit(""))) != "")))


#: Labels of lines of a left note, first match wins; lines that none fits aren't part of one.
LEFT_NOTE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("web", r"(?i)\b(https?://|www\.)"),
    ("fax", r"(?i)^\s*(fax|télécopie)\b"),
    ("phone", r"(?i)^\s*(tél|tel|téléphone|phone|secrétariat)\b|^\s*(\d{2}[ .]){4}\d{2}\s*$"),
    ("idno", r"(?i)\b(finess|rpps|adeli)\b"),
    ("medic", r"(?i)^\s*(docteur|dr|professeur|pr)[ .]"),
    ("org", r"(?i)\b(hôpital|hopital|chu|clinique|centre hospitalier|service)\b"),
    ("address", r"(^|\D)\d{5}\s+\p{Lu}|(?i)\b(rue|avenue|boulevard|place)\b"),
)
#: Heads that open the back matter of a text.
BACK = (("acknowledgement", r"(?i)^\s*(remerciements?|acknowledge?ments?)\b"), ("annex", r"(?i)^\s*(annexes?|appendix|appendices)\b"))


def left_note_label(line: Column) -> Column:
    """A label for a line of a left note; null for other lines."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(LEFT_NOTE):
        out = F.when(line.rlike(pattern), name).otherwise(out)
    return out


def left_note_lines(docs: DataFrame, pages: tuple[int, int] = (0, 2)) -> DataFrame:
    """(doc_id, cluster_no, label, text): lines with contact data on the pages of the header's window. Null and blank texts have none."""
    lines = text_lines(docs.where(F.trim(F.coalesce("text", F.lit(""))) != "")).where(F.col("page").between(*pages))
    return lines.select("doc_id", F.col("line_no").alias("cluster_no"), left_note_label(F.col("line")).alias("label"), F.trim("line").alias("text")).where("label is not null")


def left_note_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, xml): the left note of each document that has one."""
    return left_notes(left_note_lines(docs)).where("xml <> ''")


def header_documents(docs: DataFrame, stamp: str | None = None) -> DataFrame:
    """(doc_id, xml): header and left note of each document as one header."""
    record = _header_records(zoned_lines(docs)).join(left_note_documents(docs).withColumnRenamed("xml", "left_note"), "doc_id", "left")
    return record.select("doc_id", A.header_xml(stamp=stamp, left_note=F.col("left_note")).alias("xml"))


def back_zones(lines: DataFrame) -> DataFrame:
    """Zoned lines whose body ends at the first head of back matter: lines from there on are ``annex`` or ``acknowledgement``, by the last such head."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.lit(None).cast("string")
    for name, pattern in reversed(BACK):
        opens = F.when((F.col("label") == "body") & F.col("line").rlike(pattern), name).otherwise(opens)
    since = F.last(opens, ignorenulls=True).over(w)
    return lines.withColumn("label", F.when((F.col("label") == "body") & since.isNotNull(), since).otherwise(F.col("label")))


def back_xml(lines: DataFrame) -> DataFrame:
    """(doc_id, back): acknowledgement, then annex, of zoned lines; a division each, a paragraph a line."""
    rows = lines.where(F.col("label").isin(*[n for n, _ in BACK]))
    divs = rows.groupBy("doc_id", "label").agg(K.ordered_join(A.element("p", F.col("line")), F.col("line_no"), "").alias("x"))
    place = F.when(F.col("label") == BACK[0][0], 0).otherwise(1)
    piece = F.concat(F.lit('<div type="'), F.col("label"), F.lit('">'), F.col("x"), F.lit("</div>"))
    return divs.groupBy("doc_id").agg(K.ordered_join(piece, place, "").alias("matter"))


def people(lines: DataFrame) -> DataFrame:
    """(doc_id, people): medics and patients named at the start of lines, each list in order."""
    kinds = {"medic": r"(?i)^\s*(docteur|dr|professeur|pr)[ .]", "patient": r"(?i)^\s*(madame|monsieur|mme|patiente?)\b"}
    lists = None
    for model, pattern in kinds.items():
        rows = lines.where(F.col("line").rlike(pattern)).select(F.struct("doc_id", "line_no").alias("doc_id"), F.col("line").alias("text"))
        runs = K.cluster(labelled(rows, model)).groupBy("doc_id", "cluster_no", "label").agg(K.ordered_join("tok", "pos", " ").alias("text"))
        record = X.fold(runs, model).withColumn("block_no", F.col("doc_id.line_no")).withColumn("doc_id", F.col("doc_id.doc_id"))
        one = A.people_list(record, model).withColumnRenamed("xml", model)
        lists = one if lists is None else lists.join(one, "doc_id", "full")
    return lists.select("doc_id", F.concat(*[F.coalesce(m, F.lit("")) for m in kinds]).alias("people"))


def _header_records(lines: DataFrame) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) == 1
    rows = lines.where("label = 'header'").withColumn("label", header_label(F.col("line"), first))
    return X.fold(rows.select("doc_id", F.col("line_no").alias("cluster_no"), "label", F.col("line").alias("text")), "header")


def headers(lines: DataFrame, stamp: str | None = None) -> DataFrame:
    """(doc_id, header) of zoned lines."""
    return _header_records(lines).select("doc_id", A.header_xml(stamp=stamp).alias("header"))


def full_documents(docs: DataFrame, stamp: str | None = None, lang: str = "fr") -> DataFrame:
    """(doc_id, xml): header with left note, people, body, back matter, notes and entities of each document as one XML text.

    Null and blank texts have no row; ids are taken as unique.
    """
    lines = back_zones(zoned_lines(docs))
    rows = lines.where("label = 'body'").select("doc_id", F.col("line_no").alias("cluster_no"), body_label(F.col("line")).alias("label"), F.col("line").alias("text"))
    foot = A.notes(lines.where("label = 'footnote'").select("doc_id", F.col("line_no").alias("note_no"), F.col("line").alias("text")))
    notes = foot.groupBy("doc_id").agg(K.ordered_join(A.element("note", F.col("text")), F.col("note_no"), "").alias("notes"))
    found = A.entities_xml(X.ordered_entities(K.entities(docs))).withColumnRenamed("xml", "entities")
    left = left_note_documents(docs).withColumnRenamed("xml", "left_note")
    joined = _header_records(lines).join(left, "doc_id", "left")
    joined = joined.select("doc_id", A.header_xml(stamp=stamp, left_note=F.col("left_note")).alias("header"))
    for part in (A.body_xml(rows), people(lines.where("label in ('header', 'body')")), back_xml(lines), notes, found):
        joined = joined.join(part, "doc_id", "left")
    back = F.concat(*[F.coalesce(c, F.lit("")) for c in ("people", "matter", "notes", "entities")])
    return joined.select("doc_id", A.document_xml(F.col("header"), F.col("body"), back, F.lit(lang)).alias("xml"))


def left_notes(clusters: DataFrame) -> DataFrame:
    """(doc_id, xml) of labelled clusters of left notes."""
    return X.fold(clusters, "left_note").select("doc_id", A.left_note_xml().alias("xml"))


MODELS = tuple(FIELDS)
