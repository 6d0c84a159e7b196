"""Token tables, clusters of equal labels, inline tags: the spine of every extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import flow

#: First match wins; a placeholder for a trained labeller.
RULES = (
    ("email", lambda t: F.contains(t, F.lit("@")) & (F.length(t) > 1)),
    ("idno", lambda t: t.rlike(r"^\p{N}+$") & (F.length(t) >= 6)),
    ("value", lambda t: t.rlike(r"^\p{N}+$")),
    ("persname", lambda t: t.rlike(r"^\p{Lu}\p{L}+$")),
)


def explode_tokens(docs: DataFrame, pattern: str = T.TOKEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, tok, char_offset): all tokens, white space included. Null and empty texts have none."""
    return flow.tokens(docs, pattern, id_col, text_col)


def label_by_rules(tokens: DataFrame, rules=RULES) -> DataFrame:
    """Tokens that aren't blank, with a label."""
    label = F.lit("other")
    for name, test in reversed(rules):
        label = F.when(test(F.col("tok")), name).otherwise(label)
    return tokens.where(~F.col("tok").rlike(r"^\s$")).withColumn("label", label)


def cluster(labeled: DataFrame, keys: tuple[str, ...] = ("doc_id",), order: str = "pos") -> DataFrame:
    """Number the runs of one label, from 1. A label with the prefix ``I-`` begins a run and loses the prefix."""
    w = Window.partitionBy(*keys).orderBy(order)
    plain = F.regexp_replace("label", "^I-", "")
    opens = F.col("label").startswith("I-") | F.lag(plain).over(w).isNull() | (F.lag(plain).over(w) != plain)
    return labeled.withColumn("cluster_no", F.sum(opens.cast("int")).over(w).cast("long")).withColumn("label", plain)


def entity_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, type, offset_start, offset_end) of all runs that have a label, over the rule labeller."""
    return flow.spans(docs).drop("raw_name")


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, type, offset_start, offset_end, raw_name) of all runs that have a label, in documents with an id."""
    return flow.spans(docs.where("doc_id is not null"))


def ordered_join(value: Column | str, order: Column | str, sep: str) -> Column:
    """Values of a group joined in order; aggregation alone promises none."""
    value = F.col(value) if isinstance(value, str) else value
    order = F.col(order) if isinstance(order, str) else order
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), sep)


def label_map(labeled: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Label to all of its tokens, in order."""
    return labeled.groupBy(*keys, "label").agg(ordered_join("tok", "pos", " ").alias("tokens"))


def inline_tags(labeled: DataFrame, tag_of: dict[str, str], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Text with a tag around each run of a label that has one; white space comes from the token column ``ws`` (what stood before the token)."""
    runs = cluster(labeled, keys)
    first = F.min_by("ws", "pos")
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ws", "tok"))), lambda x, i: F.when(i == 0, T.xml_escape(x["tok"])).otherwise(F.concat(x["ws"], T.xml_escape(x["tok"])))), "")
    text = runs.groupBy(*keys, "cluster_no", "label").agg(first.alias("lead"), inner.alias("inner"))
    tag = F.lit(None).cast("string")
    for label, name in tag_of.items():
        tag = F.when(F.col("label") == label, name).otherwise(tag)
    close = F.split(tag, " ")[0]
    piece = F.concat("lead", F.when(tag.isNull(), F.col("inner")).otherwise(F.concat(F.lit("<"), tag, F.lit(">"), F.col("inner"), F.lit("</"), close, F.lit(">"))))
    return text.withColumn("piece", piece).groupBy(*keys).agg(ordered_join("piece", "cluster_no", "").alias("tagged"))


def nested_tags(labeled: DataFrame, tag_of: dict[str, str], inside: str, inner_tag_of: dict[str, str]) -> DataFrame:
    """(doc_id, tagged): as :func:`inline_tags`, and runs of the label ``inside`` carry the tags of a second labelling (column ``inner``) within."""
    outer = cluster(labeled).withColumnRenamed("label", "outer")
    inner = F.when(F.col("outer") == inside, F.col("inner")).otherwise("other")
    runs = cluster(outer.select("doc_id", F.col("cluster_no").alias("outer_no"), "outer", "pos", "ws", "tok", inner.alias("label")), ("doc_id", "outer_no"))
    kept = lambda x, i: F.when(i == 0, T.xml_escape(x["tok"])).otherwise(F.concat(x["ws"], T.xml_escape(x["tok"])))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ws", "tok"))), kept), "")
    text = runs.groupBy("doc_id", "outer_no", "outer", "cluster_no", "label").agg(F.min_by("ws", "pos").alias("lead"), body.alias("x"))

    def tagged(label: Column, names: dict[str, str], value: Column) -> Column:
        out = value
        for own, tag in names.items():
            out = F.when(label == own, F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag.split(' ')[0]}>"))).otherwise(out)
        return out

    parts = text.withColumn("x", tagged(F.col("label"), inner_tag_of, F.col("x")))
    # the white space before an outer run stays before its tag
    first = F.col("cluster_no") == 1
    whole = parts.groupBy("doc_id", "outer_no", "outer").agg(F.min_by("lead", "cluster_no").alias("lead"), ordered_join(F.when(first, F.col("x")).otherwise(F.concat("lead", "x")), F.col("cluster_no"), "").alias("x"))
    piece = F.concat(F.col("lead"), tagged(F.col("outer"), tag_of, F.col("x")))
    return whole.groupBy("doc_id").agg(ordered_join(piece, F.col("outer_no"), "").alias("tagged"))


def spaced_tokens(docs: DataFrame, pattern: str = T.TOKEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, ws, tok, char_offset): tokens that aren't blank, each with the white space before it, cut in one pass. White space at the end of a text is left out."""
    pieces = explode_tokens(docs, rf"\s*+(?:{pattern})", id_col, text_col)
    ws = F.regexp_extract("tok", r"^(\s*)", 1)
    return pieces.withColumn("ws", ws).select("doc_id", "pos", "ws", F.substr("tok", F.length("ws") + 1).alias("tok"), (F.col("char_offset") + F.length("ws")).alias("char_offset"))


def with_white_space(tokens: DataFrame) -> DataFrame:
    """Drop blank tokens of a token table; ``ws`` of each other token is the white space before it. From texts, :func:`spaced_tokens` is cheaper."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    blank = F.col("tok").rlike(r"^\s$")
    # the run of blanks before a token belongs to it
    group = F.sum((~F.lag(blank, 1, False).over(w)).cast("int")).over(w)
    grouped = tokens.withColumn("blank", blank).withColumn("g", group)
    return grouped.groupBy("doc_id", "g").agg(F.max("pos").alias("pos"), ordered_join(F.when(F.col("blank"), F.col("tok")).otherwise(""), F.col("pos"), "").alias("ws"), F.max_by("tok", "pos").alias("tok"), F.max_by("char_offset", "pos").alias("char_offset"), F.max_by("blank", "pos").alias("blank")).where("not blank").select("doc_id", "pos", "ws", "tok", "char_offset")


def chunks(tokens: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Runs of tokens whose offsets touch: (keys, chunk_no, start, end, text)."""
    w = Window.partitionBy(*keys).orderBy("char_offset")
    breaks = F.coalesce(F.lag(F.col("char_offset") + F.length("tok")).over(w) != F.col("char_offset"), F.lit(True))
    numbered = tokens.withColumn("chunk_no", F.sum(breaks.cast("int")).over(w).cast("long"))
    return numbered.groupBy(*keys, "chunk_no").agg(F.min("char_offset").cast("long").alias("start"), F.max(F.col("char_offset") + F.length("tok")).cast("long").alias("end"), ordered_join("tok", "char_offset", "").alias("text"))


def sequences(labeled: DataFrame, wanted: tuple[str, ...], inline: tuple[str, ...], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Runs of the wanted labels; tokens of inline labels inside don't end a run and aren't part of it."""
    w = Window.partitionBy(*keys).orderBy("pos")
    rest = labeled.where(~F.col("label").isin(*inline))
    is_in = F.col("label").isin(*wanted)
    opens = is_in & ~F.coalesce(F.lag(is_in).over(w), F.lit(False))
    numbered = rest.withColumn("seq_no", F.sum(opens.cast("int")).over(w).cast("long")).where(is_in)
    return numbered.groupBy(*keys, "seq_no").agg(ordered_join("tok", "pos", " ").alias("text"))


def token_at(tokens: DataFrame, offsets: DataFrame) -> DataFrame:
    """The first token at or behind each asked offset: (doc_id, asked, pos). As-of by a union and a running minimum, one shuffle on doc_id."""
    both = tokens.select("doc_id", F.col("char_offset").alias("at"), F.col("pos").cast("long").alias("pos"), F.lit(None).cast("long").alias("asked")).unionByName(offsets.select("doc_id", F.col("asked").alias("at"), F.lit(None).cast("long").alias("pos"), "asked"))
    w = Window.partitionBy("doc_id").orderBy(F.col("at").desc(), F.col("asked").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.min("pos").over(w)).where("asked is not null").select("doc_id", "asked", F.col("found").alias("pos"))
