"""Cascade stages: fold labelled clusters into typed records by the table of merge rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.schema import FIELDS, fields_of


def merged(values: Column, rule: str) -> Column:
    """Fold an ordered array of texts by a merge rule."""
    kind, _, sep = rule.partition(":")
    if kind == "join":
        return F.array_join(values, sep)
    if kind == "first":
        return F.element_at(values, 1)
    if kind == "longest":
        return F.aggregate(values, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    more = lambda a, x: F.concat(a, F.lit(sep), x)
    rest, start = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1)
    if kind == "differ":
        return F.aggregate(rest, start, lambda a, x: F.when(T.same_content(a, x), x).otherwise(more(a, x)))
    if kind == "shorter":
        return F.aggregate(rest, start, lambda a, x: F.when(~T.same_content(a, x) & (F.length(a) < F.length(x)), more(a, x)).otherwise(x))
    raise ValueError(rule)


def fold(clusters: DataFrame, model: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One record a key: ``clusters`` has the keys, cluster_no, label and text. Unknown labels and blank texts are left out; one shuffle on the keys."""
    field, rule = F.lit(None).cast("string"), {}
    for label, name, how in FIELDS[model]:
        field = F.when(F.col("label") == label, name).otherwise(field)
        rule[name] = how
    rows = clusters.withColumn("field", field).where("field is not null and trim(text) <> ''")
    pick = lambda f: F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("cluster_no", "text"))))
    values = rows.groupBy(*keys).agg(*[pick(f).alias(f) for f in fields_of(model)])
    return values.select(*keys, *[F.when(F.size(f) > 0, merged(F.transform(f, lambda x: x["text"]), rule[f])).alias(f) for f in fields_of(model)])


def enrich_header(header: DataFrame, datelines: DataFrame) -> DataFrame:
    """Type, date and place from the dateline where the header has none; an ISO date beside the raw one; people split at ``;``."""
    d = datelines.select("doc_id", F.col("doctype").alias("d_type"), F.col("date").alias("d_date"), F.col("place_name").alias("place"))
    out = header.join(d, "doc_id", "left").withColumn("doctype", F.coalesce("doctype", "d_type")).withColumn("date", F.coalesce("date", "d_date"))
    out = out.withColumn("iso_date", T.raw_date(F.col("date")))
    names = lambda c: F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return out.withColumn("medic_list", names("medics")).drop("d_type", "d_date")


def records(clusters: DataFrame, model: str, block: str = "block_no") -> DataFrame:
    """One record for each block of a document: organizations, medics, patients."""
    return fold(clusters, model, ("doc_id", block))


def not_empty(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows with a value in one of the fields."""
    return rows.where(F.coalesce(*[F.col(f) for f in fields]).isNotNull())


def sane_datelines(rows: DataFrame) -> DataFrame:
    """Drop datelines without a date; dots in dates become slashes."""
    return rows.where("date is not null").withColumn("date", F.replace("date", F.lit("."), F.lit("/")))


def guard_zones(sizes: DataFrame, most_tokens: int = 1_000_000, most_blocks: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(kept, rejects): documents within the limits, and the others with a reason. Rejects are reported, not lost."""
    reason = F.when(F.col("n_tokens") == 0, "empty").when(F.col("n_tokens") > most_tokens, "too many tokens").when(F.col("n_blocks") > most_blocks, "too many blocks")
    marked = sizes.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select("doc_id", F.lit("segmenter").alias("stage"), "reason")


def zones(lines: DataFrame) -> DataFrame:
    """(doc_id, zone_no, zone, line_start, line_end): runs of one zone label over labelled lines."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    opens = F.coalesce(F.lag("label").over(w) != F.col("label"), F.lit(True))
    runs = lines.withColumn("zone_no", F.sum(opens.cast("int")).over(w).cast("long"))
    return runs.groupBy("doc_id", "zone_no", F.col("label").alias("zone")).agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"))


def label_zones(lines: DataFrame, header_lines: int = 3) -> DataFrame:
    """A rule labeller for lines: the first lines are the header, short lines that end a page are footnotes, all else is body."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    last = F.coalesce(F.lead("page").over(w) != F.col("page"), F.lit(False))
    return lines.withColumn("label", F.when(F.row_number().over(w) <= header_lines, "header").when(last & (F.length("line") < 60), "footnote").otherwise("body"))


def figures(clusters: DataFrame, label: str) -> DataFrame:
    """Figure or table records: ordinal, page of the first token that isn't blank, the blocks it touches."""
    own = clusters.where(F.col("label") == label)
    solid = F.when(F.trim("tok") != "", F.struct("pos", "page"))
    each = own.groupBy("doc_id", "cluster_no").agg(F.min(solid)["page"].alias("page"), F.array_join(F.array_sort(F.collect_set("block_no")).cast("array<string>"), ",").alias("blocks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), " ").alias("text"))
    return each.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("cluster_no")).cast("long").alias("id"), "page", "blocks", "text")


def majority_markers(markers: DataFrame) -> DataFrame:
    """(doc_id, kind, type): the most frequent type of each marker kind; a marker counts once, ties go to the first type in order."""
    counts = markers.select("doc_id", "kind", "marker", "type").distinct().groupBy("doc_id", "kind", "type").agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id", "kind").orderBy(F.desc("n"), "type")
    return counts.withColumn("r", F.row_number().over(order)).where("r = 1").select("doc_id", "kind", "type", "n")


def sane_names(names: DataFrame) -> DataFrame:
    return names.where("trim(last_name) <> ''")


def dedupe_names(names: DataFrame) -> DataFrame:
    """Names of one document with the same last name and first initial are one person, the longest value of each field wins.
    A name without a first name joins the person of its last name when there is just one; signatures that clash stay apart."""
    sign = names.withColumn("last_key", F.lower("last_name")).withColumn("initial", F.lower(F.substring(F.coalesce("first_name", F.lit("")), 1, 1)))
    initials = sign.where("initial <> ''").groupBy("doc_id", "last_key").agg(F.countDistinct("initial").alias("n"), F.min("initial").alias("only"))
    keyed = sign.join(initials, ["doc_id", "last_key"], "left").withColumn("initial", F.when((F.col("initial") == "") & (F.col("n") == 1), F.col("only")).otherwise(F.col("initial")))
    longest = lambda f: F.max(F.when(F.col(f).isNotNull(), F.struct(F.length(f).alias("k"), F.col(f).alias("v"))))["v"].alias(f)
    return keyed.groupBy("doc_id", "last_key", "initial").agg(*[longest(f) for f in ("title", "first_name", "middle_name", "last_name", "suffix")], F.count("*").alias("mentions")).drop("last_key", "initial")


def ordered_entities(rows: DataFrame) -> DataFrame:
    """Entities once for each (start, end), numbered in order; of equal spans the first type in order stays."""
    one = rows.groupBy("doc_id", "offset_start", "offset_end").agg(F.min(F.struct("type", "raw_name")).alias("e"))
    w = Window.partitionBy("doc_id").orderBy("offset_start", "offset_end")
    return one.select("doc_id", F.row_number().over(w).cast("long").alias("entity_no"), "offset_start", "offset_end", "e.type", "e.raw_name")


def body_entities(docs: DataFrame) -> DataFrame:
    """Entities of each line of the text on its own, with offsets into the line."""
    from .tokens import entities

    rows = docs.select("doc_id", F.posexplode_outer(T.lines(F.col("text"))).alias("line_no", "text")).where("trim(text) <> ''")
    keyed = rows.select(F.struct("doc_id", "line_no").alias("doc_id"), "text")
    return entities(keyed).select("doc_id.doc_id", F.col("doc_id.line_no").cast("long").alias("line_no"), "type", "offset_start", "offset_end", "raw_name")
