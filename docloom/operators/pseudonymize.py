"""Collect personal data, build the map of pseudonyms, apply it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pseudonym as P
from ..functions.text import PLAIN_TOKEN, date_shape, is_determiner
from .gazetteer import BROADCAST_TERMS, _sized
from .tokens import ordered_join

#: Fields of the records that hold personal data, by kind.
KINDS = {"idno": "idno", "id": "idno", "docnum": "idno", "pers_name": "name", "birth": "date", "date": "date", "phone": "phone", "fax": "phone", "email": "email", "address": "address"}


def collect(records: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, kind, original): personal data of records, split at ``;`` and tab, cleaned by kind, each once a document."""
    each = F.array(*[F.struct(F.lit(KINDS[f]).alias("kind"), F.col(f).alias("v")) for f in fields])
    rows = records.select("doc_id", F.explode(each).alias("e")).where("e.v is not null").select("doc_id", "e.kind", F.explode(F.split("e.v", "[;\t]")).alias("v"))
    clean = F.trim(F.when(F.col("kind") == "idno", F.replace("v", F.lit("*"), F.lit(""))).otherwise(F.col("v")))
    rows = rows.select("doc_id", "kind", clean.alias("original"))
    ok = F.when(F.col("kind") == "idno", F.length("original") > 1).when(F.col("kind") == "name", (F.length("original") > 2) & ~F.contains("original", F.lit("."))).otherwise(F.length("original") > 0)
    return rows.where(ok).distinct()


def pseudo(kind: Column, original: Column, key: str) -> Column:
    """The replacement of a value by its kind."""
    return (
        F.when(kind == "name", P.mask_name(original, key))
        .when(kind == "email", F.when(F.contains(original, F.lit("@")), P.mask_email(original, key)).otherwise(original))
        .when(kind == "date", F.when(F.try_to_date(original, "yyyy-MM-dd").isNotNull(), P.shift_date(original, key)).otherwise(P.shift_raw_date(original, key)))
        .otherwise(P.mask_number(original, key))
    )


def components(pairs: DataFrame) -> DataFrame:
    """Pairs and their aligned parts: original and pseudonym split by the tokenizer, parts longer than 1 kept (names: 2)."""
    solid = lambda c: F.filter(F.regexp_extract_all(c, F.lit(PLAIN_TOKEN), 0), lambda t: t.rlike(r"^[\p{L}\p{N}]"))
    least = F.when(F.col("kind") == "name", 2).otherwise(1)
    aligned = F.arrays_zip(solid("original").alias("o"), solid("pseudo").alias("p"))
    parts = F.filter(aligned, lambda x: x["o"].isNotNull() & x["p"].isNotNull() & (F.length(x["o"]) > least))
    # One pass: the pairs come from the texts, which a union would read twice.
    whole = F.array(F.struct(F.col("original").alias("o"), F.col("pseudo").alias("p")))
    each = F.explode(F.concat(whole, F.coalesce(parts, F.slice(whole, 1, 0)))).alias("z")
    return pairs.select("doc_id", "kind", each).select("doc_id", "kind", F.col("z.o").alias("original"), F.col("z.p").alias("pseudo"))


def pseudonym_map(pairs: DataFrame) -> DataFrame:
    """(doc_id, kind, original, pseudo): a function of (doc_id, original); the first by (kind, pseudo) wins. Case variants are added unless shaped like dates or numbers."""
    w = Window.partitionBy("doc_id", "original").orderBy("kind", "pseudo")
    one = pairs.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    plain = (date_shape(F.col("original")) == 0) & ~F.col("original").rlike(r"^\p{N}+$")
    variants = F.when(plain, F.array(*[F.struct(f(F.col("original")).alias("o"), f(F.col("pseudo")).alias("p")) for f in (lambda c: c, F.upper, F.lower, F.initcap)])).otherwise(F.array(F.struct(F.col("original").alias("o"), F.col("pseudo").alias("p"))))
    wide = one.select("doc_id", "kind", F.posexplode(variants).alias("k", "v")).select("doc_id", "kind", "k", F.col("v.o").alias("original"), F.col("v.p").alias("pseudo"))
    first = Window.partitionBy("doc_id", "original").orderBy("k", "kind", "pseudo")
    return wide.withColumn("r", F.row_number().over(first)).where("r = 1").select("doc_id", "kind", "original", "pseudo")


def apply_map(tokens: DataFrame, mapping: DataFrame) -> DataFrame:
    """Tokens with the pseudonym where the exact token is in the map of its document, and a flag. A join on (doc_id, token): nothing is broadcast, maps grow with the corpus."""
    m = mapping.select("doc_id", F.col("original").alias("tok"), "pseudo")
    return tokens.join(m, ["doc_id", "tok"], "left").withColumn("replaced", F.col("pseudo").isNotNull().cast("int")).withColumn("tok", F.coalesce("pseudo", "tok")).drop("pseudo")


def apply_spans(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """(doc_id, text) with all originals of the document's map replaced, longest first, so that no original of several tokens survives.

    Placeholders that can't occur in originals stand in between, so that a pseudonym is never replaced again. Originals and
    texts meet at letters and digits only: ``Paul`` doesn't change ``Paula``.
    """
    maps = mapping.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("original")).alias("k"), "original", "pseudo"))).alias("m"))
    quoted = lambda o: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.replace(o, F.lit("\\E"), F.lit("")), F.lit(r"\E(?![\p{L}\p{N}])"))
    marked = F.aggregate(F.transform("m", lambda x, i: F.struct(x["original"].alias("o"), i.alias("i"))), F.col("text"), lambda t, x: F.regexp_replace(t, quoted(x["o"]), F.concat(F.lit(""), x["i"].cast("string"), F.lit(""))))
    filled = F.aggregate(F.transform("m", lambda x, i: F.struct(x["pseudo"].alias("p"), i.alias("i"))), F.col("marked"), lambda t, x: F.replace(t, F.concat(F.lit(""), x["i"].cast("string"), F.lit("")), x["p"]))
    held = docs.select("doc_id", "text").join(maps, "doc_id", "left")
    return held.withColumn("marked", F.when(F.col("m").isNull(), F.col("text")).otherwise(marked)).select("doc_id", F.when(F.col("m").isNull(), F.col("text")).otherwise(filled).alias("text"))


def mask_addresses(addresses: DataFrame, cities: DataFrame, key: str) -> DataFrame:
    """(doc_id, original, pseudo) of addresses: the street number, the post code, its city and the whole.

    ``cities``: (post_code, city). The city is found by the exact post code; its replacement is picked by hash among all
    cities that are no determiner, ordered by name.
    """
    code = F.regexp_extract("address", r"(?:^|\D)(\d{5})(?:\D|$)", 1)
    number = F.regexp_extract("address", r"^(\d{2,3})(?:\D|$)", 1)
    rows = addresses.withColumn("code", code).withColumn("number", number)
    names = cities.where(~is_determiner(F.col("city"))).select("city").distinct()
    count = names.count()
    ranked = names.select("city", (F.row_number().over(Window.orderBy("city")) - 1).cast("long").alias("k"))
    found = rows.join(_sized(cities.groupBy("post_code").agg(F.min("city").alias("city")), BROADCAST_TERMS), rows["code"] == F.col("post_code"), "left")
    picked = found.withColumn("k", P.pick(key, F.coalesce("city", F.lit("")), F.lit(0), max(count, 1))).join(_sized(ranked.withColumnRenamed("city", "new_city"), BROADCAST_TERMS), "k", "left")
    new_code, new_number = P.mask_number(F.col("code"), key), P.mask_number(F.col("number"), key)
    whole = F.col("address")
    for old, new in ((F.col("code"), new_code), (F.col("number"), new_number), (F.coalesce("city", F.lit("")), F.coalesce("new_city", F.lit("")))):
        whole = F.when(old != "", F.replace(whole, old, new)).otherwise(whole)
    pairs = F.array(F.struct(F.col("number").alias("o"), new_number.alias("p")), F.struct(F.col("code").alias("o"), new_code.alias("p")), F.struct(F.coalesce("city", F.lit("")).alias("o"), F.coalesce("new_city", F.lit("")).alias("p")), F.struct(F.col("address").alias("o"), whole.alias("p")))
    return picked.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", F.col("x.o").alias("original"), F.col("x.p").alias("pseudo")).where("original <> ''")


def anonymised_tags(labeled: DataFrame, mapping: DataFrame, tag_of: dict[str, str]) -> DataFrame:
    """Tags re-emitted over replaced tokens: labels come from the originals, features and texts from the pseudonyms."""
    from .tokens import inline_tags

    return inline_tags(apply_map(labeled, mapping), tag_of)


def survivors(texts: DataFrame, mapping: DataFrame) -> DataFrame:
    """(doc_id, original) of the mapped originals that still stand in a text as a token; must be empty."""
    toks = texts.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PLAIN_TOKEN), 0))).alias("original"))
    return toks.join(mapping.where("original <> pseudo").select("doc_id", "original"), ["doc_id", "original"], "left_semi")


def tsv(mapping: DataFrame) -> DataFrame:
    """One line a pair, ordered by (kind, original)."""
    line = F.concat_ws("\t", "original", "pseudo")
    return mapping.groupBy("doc_id").agg(ordered_join(line, F.struct("kind", "original"), "\n").alias("tsv"))
