"""Splits and scores of labelled corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences
from ..plans.schema import ALIASES


def bucket(value: Column, key: str, n: int) -> Column:
    """A number from 0 to n - 1 that depends on the key and the value alone."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(key), value.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(n))


def split(rows: DataFrame, ratio: float = 0.8, key: str = "split", id_col: str = "doc_id") -> DataFrame:
    """A column ``part``: train or eval, by document."""
    return rows.withColumn("part", F.when(bucket(F.col(id_col), key, 10_000) < int(ratio * 10_000), "train").otherwise("eval"))


def folds(rows: DataFrame, n: int = 10, key: str = "fold", id_col: str = "doc_id") -> DataFrame:
    return rows.withColumn("fold", bucket(F.col(id_col), key, n))


def begin_marks(tokens: DataFrame) -> DataFrame:
    """(doc_id, field_no, pos, tok, label): the first token of a field gets ``I-``; aliases of corpora become labels."""
    label = F.col("label")
    for alias, name in ALIASES.items():
        label = F.when(F.lower("label") == alias, name).otherwise(label)
    first = F.row_number().over(Window.partitionBy("doc_id", "field_no").orderBy("pos")) == 1
    return tokens.withColumn("label", F.when(first & (label != "other"), F.concat(F.lit("I-"), label)).otherwise(label))


def begin_to_inside(label: Column) -> Column:
    return F.regexp_replace(label, "^B-", "I-")


def _report(counts: DataFrame) -> DataFrame:
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    safe = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    p, r = F.when(F.col("tp") + F.col("fp") > 0, p).otherwise(0.0), F.when(F.col("tp") + F.col("fn") > 0, r).otherwise(0.0)
    return counts.select("label", "tp", "fp", "fn", safe(p).alias("precision"), safe(r).alias("recall"), safe(F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r))).alias("f1"))


def token_report(rows: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) over tokens with columns gold and guess."""
    pairs = F.when(F.col("gold") == F.col("guess"), F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn")))).otherwise(
        F.array(F.struct(F.col("guess").alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn")), F.struct(F.col("gold").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn")))
    )
    return _report(rows.select(F.explode(pairs).alias("x")).groupBy("x.label").agg(*[F.sum(f"x.{c}").alias(c) for c in ("tp", "fp", "fn")]))


def field_report(gold: DataFrame, guess: DataFrame) -> DataFrame:
    """The same over spans (doc_id, label, start, end): a span counts when label and both ends agree."""
    key = ["doc_id", "label", "start", "end"]
    both = gold.select(*key).distinct().withColumn("g", F.lit(1)).join(guess.select(*key).distinct().withColumn("s", F.lit(1)), key, "full")
    g, s = F.coalesce("g", F.lit(0)), F.coalesce("s", F.lit(0))
    return _report(both.groupBy("label").agg(F.sum(g * s).cast("long").alias("tp"), F.sum(s * (1 - g)).cast("long").alias("fp"), F.sum(g * (1 - s)).cast("long").alias("fn")))


def instance_report(rows: DataFrame) -> DataFrame:
    """(instances, correct, accuracy): sequences whose tokens are all right."""
    each = rows.groupBy("doc_id").agg(F.min((F.col("gold") == F.col("guess")).cast("int")).alias("ok"))
    return each.agg(F.count("*").alias("instances"), F.sum("ok").alias("correct"), F.round(F.avg("ok"), 6).alias("accuracy"))


def label_counts(labeled: DataFrame) -> DataFrame:
    """Counts by (model, label), by model, and in all."""
    return labeled.rollup("model", "label").agg(F.count("*").alias("n"))


def blank_training(tokens: DataFrame) -> DataFrame:
    """Unlabelled training rows."""
    return tokens.withColumn("label", F.lit("other"))


def training_rows(labeled: DataFrame, mapping: DataFrame, tag_of: dict[str, str], model: str) -> DataFrame:
    """(doc_id, model, variant, payload) of the three kinds of training texts: blank, annotated, pseudonymised. Labels come from the originals, texts of the last kind from the map."""
    from .pseudonymize import anonymised_tags
    from .tokens import inline_tags

    made = {"blank": inline_tags(blank_training(labeled), tag_of), "annotated": inline_tags(labeled, tag_of), "pseudonymised": anonymised_tags(labeled, mapping, tag_of)}
    parts = [df.select("doc_id", F.lit(model).alias("model"), F.lit(variant).alias("variant"), F.col("tagged").alias("payload")) for variant, df in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def merge_sentences(sentences: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, start, end): sentences joined where an entity reaches over their border; by running maximum of ends, one shuffle."""
    spans = sentences.select("doc_id", "start", "end", F.lit(1).alias("is_sentence")).unionByName(entities.select("doc_id", F.col("start"), F.col("end"), F.lit(0).alias("is_sentence")))
    before = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "is_sentence").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True))
    order = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "is_sentence")
    grouped = spans.withColumn("opens", opens).withColumn("g", F.sum(F.col("opens").cast("int")).over(order))
    return grouped.groupBy("doc_id", "g").agg(F.min(F.when(F.col("is_sentence") == 1, F.col("start"))).alias("start"), F.max("end").alias("end")).where("start is not null").drop("g")


def sentences_outside(docs: DataFrame, span: str = r"[(\[][^)\]]*[)\]]") -> DataFrame:
    """(doc_id, start, end): sentences of the texts, joined where a span of the pattern (brackets) reaches over their border."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)

    def placed(pieces: Column) -> DataFrame:
        rows = docs.select("doc_id", F.posexplode(pieces).alias("pos", "piece"))
        start = F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0)).cast("long")
        return rows.withColumn("start", start).withColumn("end", F.col("start") + F.length("piece"))

    found = placed(F.regexp_extract_all("text", F.lit(span + r"|[^(\[]+|."), 0)).where(F.col("piece").rlike(r"^[(\[]"))
    return merge_sentences(placed(sentences(F.col("text"))).select("doc_id", "start", "end"), found.select("doc_id", "start", "end"))


def align(labeled: DataFrame, raw: DataFrame) -> DataFrame:
    """Labels on raw feature lines by the carried token number; a raw line without a label takes the last one before it."""
    w = Window.partitionBy("doc_id").orderBy("token_no").rowsBetween(Window.unboundedPreceding, 0)
    joined = raw.join(labeled.select("doc_id", "token_no", "label"), ["doc_id", "token_no"], "left")
    return joined.withColumn("matched", F.col("label").isNotNull().cast("int")).withColumn("label", F.coalesce(F.last("label", ignorenulls=True).over(w), F.lit("other")))
