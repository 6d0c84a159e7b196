"""XML assembly of records and bodies. Times of a run are parameters, so that outputs compare equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dehyphenize, note_number, normalize_space, section_number, xml_escape
from .tokens import ordered_join


def element(tag: str, value: Column, attributes: str = "") -> Column:
    """<tag>value</tag>, or nothing for a null or empty value."""
    head = f"<{tag} {attributes}>" if attributes else f"<{tag}>"
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(head), xml_escape(value), F.lit(f"</{tag}>"))).otherwise("")


def wrap(tag: str, inner: Column, attributes: str = "") -> Column:
    head = f"<{tag} {attributes}>" if attributes else f"<{tag}>"
    return F.when(inner != "", F.concat(F.lit(head), inner, F.lit(f"</{tag}>"))).otherwise("")


_MEDIC = (("idno", "idno", ""), ("role", "roleName", ""), ("pers_name", "persName", ""), ("affiliation", "affiliation", ""), ("org_name", "orgName", ""), ("institution", "institution", ""), ("address", "address", ""), ("country", "country", ""), ("town", "settlement", ""), ("email", "email", ""), ("phone", "phone", ""), ("fax", "fax", ""), ("web", "ptr", ""), ("note", "note", ""))
_PATIENT = (("id", "idno", ""), ("id_type", "idType", ""), ("pers_name", "persName", ""), ("sex", "sex", ""), ("birth", "birth", ""), ("birth_place", "placeName", ""), ("age", "age", ""), ("death", "death", ""), ("address", "address", ""), ("country", "country", ""), ("town", "settlement", ""), ("phone", "phone", ""), ("email", "email", ""), ("note", "note", ""))
_DATELINE = (("doctype", "note", 'type="doctype"'), ("place_name", "placeName", ""), ("date", "date", ""), ("time_string", "time", ""), ("note", "note", ""))
_NAME = (("title", "roleName", ""), ("first_name", "forename", 'type="first"'), ("middle_name", "forename", 'type="middle"'), ("last_name", "surname", ""), ("suffix", "genName", ""))
FRAGMENTS = {"medic": _MEDIC, "patient": _PATIENT, "dateline": _DATELINE, "person_name": _NAME}
ROOTS = {"medic": "medic", "patient": "patient", "dateline": "dateline", "person_name": "persName"}


def fragment(model: str) -> Column:
    """The record of a model as XML, fields in fixed order; empty for an empty record."""
    return wrap(ROOTS[model], F.concat(*[element(tag, F.col(f), a) for f, tag, a in FRAGMENTS[model]]))


def people_list(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, xml): the records of each document in block order."""
    one = rows.select("doc_id", "block_no", fragment(model).alias("x")).where("x <> ''")
    return one.groupBy("doc_id").agg(wrap("listPerson", ordered_join("x", "block_no", ""), f'type="{model}"').alias("xml"))


PUBLICATION = ("affiliation", "address", "org", "email", "phone", "fax", "web", "date", "docnum", "time", "note")
SCHEMAS = {
    "dtd": '<!DOCTYPE TEI SYSTEM "tei.dtd">',
    "xsd": '<?xml-model href="tei.xsd" type="application/xml"?>',
    "rng": '<?xml-model href="tei.rng" schematypens="http://relaxng.org/ns/structure/1.0"?>',
}


def header_xml(schema: str | None = None, stamp: str | None = None, left_note: Column | None = None) -> Column:
    """The header record as XML: the title, or else the type; a publication block when one of its fields is there, else a default publisher."""
    title = element("title", F.coalesce("title", "doctype"), 'level="a" type="main"')
    has = F.coalesce(*[F.col(c) for c in PUBLICATION]).isNotNull()
    org = F.concat(element("orgName", F.col("org")), element("affiliation", F.col("affiliation")), element("address", F.col("address")), element("email", F.col("email")), element("phone", F.col("phone")), element("fax", F.col("fax")), element("ptr", F.col("web")), element("date", F.col("date")), element("time", F.col("time")))
    publication = F.when(has, F.concat(F.lit("<publicationStmt>"), org, element("idno", F.col("docnum")), element("note", F.col("note")), F.lit("</publicationStmt>"))).otherwise("<publicationStmt><publisher/></publicationStmt>")
    note = F.coalesce(left_note, F.lit("")) if left_note is not None else F.lit("")
    made = f'<encodingDesc><appInfo when="{stamp}"/></encodingDesc>' if stamp else ""
    lead = SCHEMAS[schema] if schema else ""
    return F.concat(F.lit(f"{lead}<teiHeader>{made}<fileDesc><titleStmt>"), title, F.lit("</titleStmt>"), publication, F.lit("<sourceDesc>"), wrap("listOrg", note), F.lit("</sourceDesc></fileDesc></teiHeader>"))


def left_note_xml() -> Column:
    fields = (("org", "orgName"), ("affiliation", "affiliation"), ("idno", "idno"), ("address", "address"), ("country", "country"), ("settlement", "settlement"), ("phone", "phone"), ("fax", "fax"), ("email", "email"), ("web", "ptr"), ("medic", "medic"), ("note", "note"))
    return wrap("org", F.concat(*[element(t, F.col(f)) for f, t in fields]))


#: Labels of body clusters that open a division, with its level.
HEADS = {"title": 0, "section": 1, "subsection": 2}
MARKERS = ("figure_marker", "table_marker")


def body_xml(clusters: DataFrame) -> DataFrame:
    """(doc_id, body) from (doc_id, cluster_no, label, text). Titles, sections and subsections open a ``div``; items in a row share a list;
    markers stand inside a paragraph and don't break it. Divisions without content are dropped."""
    w = Window.partitionBy("doc_id").orderBy("cluster_no")
    head = F.col("label").isin(*HEADS)
    rows = clusters.withColumn("kind", F.when(F.col("label").isin(*MARKERS), "paragraph").otherwise(F.col("label")))
    # An own paragraph cluster begins a paragraph unless a marker came right before it; a marker never begins one behind a paragraph.
    marker, before = F.col("label").isin(*MARKERS), F.lag("label").over(w)
    joins = F.coalesce(((F.col("kind") == "paragraph") & (before.isin(*MARKERS) | (marker & (before == "paragraph")))) | ((F.col("label") == "item") & (before == "item")), F.lit(False))
    rows = rows.withColumn("div_no", F.sum(head.cast("int")).over(w)).withColumn("run", F.sum((~joins).cast("int")).over(w))
    level = F.lit(None).cast("int")
    for name, n in HEADS.items():
        level = F.when(F.col("label") == name, n).otherwise(level)
    number, title = section_number(normalize_space(F.col("text")))
    heading = F.concat(F.lit("<head"), F.when(level > 0, F.concat(F.lit(' level="'), level.cast("string"), F.lit('"'))).otherwise(""), F.when(number != "", F.concat(F.lit(' n="'), xml_escape(number), F.lit('"'))).otherwise(""), F.lit(">"), xml_escape(title), F.lit("</head>"))
    clean = xml_escape(normalize_space(dehyphenize(F.col("text"))))
    ref = F.concat(F.lit('<ref type="'), F.replace("label", F.lit("_marker"), F.lit("")), F.lit('">'), clean, F.lit("</ref>"))
    inline = F.when(head, heading).when(marker, ref).when(F.col("label") == "item", F.concat(F.lit("<item>"), clean, F.lit("</item>"))).otherwise(clean)
    runs = rows.withColumn("x", inline).groupBy("doc_id", "div_no", "run").agg(F.min_by("kind", "cluster_no").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster_no", "x"))), lambda v: v["x"]), " ").alias("x"), F.max(head).alias("is_head"))
    tag = F.when(F.col("is_head"), F.col("x")).when(F.col("kind") == "paragraph", F.concat(F.lit("<p>"), F.col("x"), F.lit("</p>"))).when(F.col("kind") == "item", F.concat(F.lit("<list>"), F.col("x"), F.lit("</list>"))).otherwise(F.concat(F.lit("<"), F.col("kind"), F.lit(">"), F.col("x"), F.lit("</"), F.col("kind"), F.lit(">")))
    divs = runs.withColumn("x", tag).groupBy("doc_id", "div_no").agg(ordered_join("x", "run", "").alias("x"))
    return divs.where("x <> ''").groupBy("doc_id").agg(F.concat(F.lit("<body>"), ordered_join(F.concat(F.lit("<div>"), F.col("x"), F.lit("</div>")), F.col("div_no"), ""), F.lit("</body>")).alias("body"))


def resolve_references(markers: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, marker_no, target): the first figure or table of the document, by id, whose label the marker's text holds; null without one."""
    t = targets.select("doc_id", F.col("id").alias("target"), F.lower("label").alias("name")).where("name <> ''")
    near = markers.join(t, "doc_id").where(F.contains(F.lower("text"), F.col("name"))).groupBy("doc_id", "marker_no").agg(F.min("target").alias("target"))
    return markers.select("doc_id", "marker_no").join(near, ["doc_id", "marker_no"], "left")


def notes(rows: DataFrame, least: int = 6) -> DataFrame:
    """(doc_id, note_no, number, text): notes of a document, dehyphenised, six characters or more, each text once, in order."""
    clean = normalize_space(dehyphenize(F.col("text")))
    once = rows.select("doc_id", "note_no", clean.alias("text")).where(F.length("text") >= least).groupBy("doc_id", "text").agg(F.min("note_no").alias("note_no"))
    number, rest = note_number(F.col("text"))
    return once.select("doc_id", "note_no", number.alias("number"), F.trim(rest).alias("text"))


def facsimile(pages: DataFrame) -> DataFrame:
    """(doc_id, xml): one surface a page."""
    surface = F.concat(F.lit('<surface n="'), F.col("page").cast("string"), F.lit('" ulx="0.0" uly="0.0" lrx="'), F.col("width").cast("string"), F.lit('" lry="'), F.col("height").cast("string"), F.lit('"/>'))
    return pages.groupBy("doc_id").agg(F.concat(F.lit("<facsimile>"), ordered_join(surface, F.col("page"), ""), F.lit("</facsimile>")).alias("xml"))


def coordinates(boxes: Column) -> Column:
    """Boxes (page, x, y, w, h) as an attribute value."""
    return F.array_join(F.transform(boxes, lambda b: F.concat_ws(",", b["page"].cast("string"), *[F.format_string("%.2f", b[c]) for c in ("x", "y", "w", "h")])), ";")


def element_id(doc: Column, n: Column) -> Column:
    """A generated id that the same element gets in every run."""
    return F.concat(F.lit("_"), F.substring(F.sha2(F.concat_ws("|", doc.cast("string"), n.cast("string")), 256), 1, 7))


def entities_xml(entities: DataFrame) -> DataFrame:
    """(doc_id, xml): entities in order of their offsets."""
    one = F.concat(F.lit('<entity type="'), F.col("type"), F.lit('" start="'), F.col("offset_start").cast("string"), F.lit('" end="'), F.col("offset_end").cast("string"), F.lit('">'), xml_escape(F.col("raw_name")), F.lit("</entity>"))
    return entities.groupBy("doc_id").agg(F.concat(F.lit("<entities>"), ordered_join(one, F.struct("offset_start", "offset_end", "type"), ""), F.lit("</entities>")).alias("xml"))


def entity_json() -> Column:
    """An entity as JSON."""
    return F.to_json(F.struct(F.col("raw_name").alias("rawName"), "type", F.col("offset_start").alias("offsetStart"), F.col("offset_end").alias("offsetEnd")))


def document_xml(header: Column, body: Column, back: Column, lang: Column) -> Column:
    return F.concat(F.lit("<TEI>"), header, F.lit('<text xml:lang="'), lang, F.lit('">'), F.coalesce(body, F.lit("<body/>")), wrap("back", F.coalesce(back, F.lit(""))), F.lit("</text></TEI>"))
