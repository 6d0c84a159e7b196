"""Language identification by Bayesian evidence fusion.

Evidence: byte trigrams of the text (naive Bayes), the language that the markup declares, the address suffix, and a
prior of the host. Priors are smoothed along host, site and all hosts; their counts are sums of text posteriors,
grouped over all documents, and a document's own part is taken out of its prior again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import BROADCAST_ROWS, bound_batches, materialise, table, text_slices
from ._words import BYTE_HASH, Words, mix

U = np.uint64
BITS, SAMPLE, STRENGTH, TRUST = 16, 20_000, 8.0, 0.8
#: Trigrams overlap, so their likelihood is tempered.
TEMPER = 1 / 3
#: Prior of a text in none of the languages, whose trigrams meet those of the training sample by chance; and how often a text in one of them does.
NONE, SEEN = 1e-4, 0.9
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte, and which count: inside one text and around a letter."""
    b = _FOLD[data]
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    h = BYTE_HASH[b]
    code = mix(h[:-2] * U(3) + (h[1:-1] << U(1)) + (h[2:] >> U(3)) * U(5))
    inside = np.ones(len(b), bool)
    edge = offsets[1:-1]
    for back in (1, 2):
        cut = edge[edge >= back] - back
        inside[cut] = False
    return (code >> U(64 - BITS)).astype(np.int64), inside[:-2] & _LETTER[b[1:-1]]


def train(docs: DataFrame, text_col: str, label_col: str, id_col: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their smoothed log-likelihoods by trigram bucket, from at most about ``sample`` labelled rows, picked by a hash of the id.

    All labels are languages. The sample is dealt out evenly among them; what a rare one doesn't fill goes to the others.
    """
    bound_batches(docs.sparkSession)
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r["count"] for r in labelled.groupBy(label_col).count().collect()}
    langs = sorted(sizes)
    left, quota = sample, {}
    for k, x in enumerate(sorted(langs, key=lambda x: (sizes[x], x))):
        quota[x] = min(sizes[x], max(1, left // (len(langs) - k)))
        left -= quota[x]
    limit = F.element_at(F.create_map(*[F.lit(v) for x in langs for v in (x, math.ceil(quota[x] / sizes[x] * (1 << 20)))]), F.col(label_col)) if langs else F.lit(0)
    picked = labelled.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < limit).select(F.col(text_col).alias("text"), F.col(label_col).alias("lang"))
    place = {x: k for k, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in text_slices(b):
                words = Words(s.column("text"))
                code, ok = _grams(words.data, words.offsets)
                lang = np.repeat(np.array([place[x] for x in s.column("lang").to_pylist()], np.int64), np.diff(words.offsets))[: len(code)]
                slot, n = np.unique(lang[ok] << BITS | code[ok], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n)], names=["slot", "n"])

    found = np.zeros((max(len(langs), 1), 1 << BITS))
    if langs:
        for r in picked.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow().to_batches():
            found.reshape(-1)[r.column("slot").to_numpy()] = r.column("n").to_numpy()
    found += 0.1
    return langs, np.log(found / found.sum(1, keepdims=True)).astype(np.float32)


def known_grams(table_: np.ndarray) -> np.ndarray:
    """Which buckets the training sample has in any language."""
    return (table_ > table_.min(1, keepdims=True)).any(0)


def text_evidence(docs: DataFrame, text_col: str, id_col: str, langs: list[str], table_: np.ndarray, keep: tuple[str, ...] = ()) -> DataFrame:
    """Id, ``keep`` columns and log-likelihoods (array, by ``langs``) of each text, whether it has letters, and how many trigrams, of them known ones."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(table_)
    known = known_grams(table_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in text_slices(b, "__text"):
                words = Words(s.column("__text"))
                code, ok = _grams(words.data, words.offsets)
                at = np.searchsorted(np.flatnonzero(ok), words.offsets)
                code = code[ok]
                seen = np.diff(np.r_[0, np.cumsum(known[code])][at])
                like = np.zeros((words.rows, len(langs)), np.float64)
                full = np.flatnonzero(np.diff(at))
                for k in range(len(langs)):
                    if len(full):
                        like[full, k] = np.add.reduceat(shared.value[k][code].astype(np.float64), at[:-1][full])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(words.rows + 1, dtype=np.int32) * len(langs)), pa.array(like.reshape(-1)))
                yield pa.RecordBatch.from_arrays([s.column("__id"), *(s.column(c) for c in keep), lists, s.column("letters"), pa.array(np.diff(at).astype(np.int64)), pa.array(seen.astype(np.int64))], names=["__id", *keep, "like", "letters", "grams", "seen"])

    kinds = dict(docs.dtypes)
    schema = "__id long" + "".join(f", `{c}` {kinds[c]}" for c in keep) + ", like array<double>, letters boolean, grams long, seen long"
    return docs.select(F.col(id_col).cast("long").alias("__id"), *keep, F.col(text_col).cast("string").alias("__text"), F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letters")).mapInArrow(run, schema)


def page_evidence(pages: DataFrame) -> DataFrame:
    """(__id, pages) of the documents whose number ends the address of a page: (page_id, declared, suffix, host) of each of their pages, in the order of page_id."""
    number = F.regexp_extract("url", r"://[^/?#]*/(?:[^/?#]+/)*?([0-9]{1,18})(?:[./?#]|$)", 1)
    host = F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1))
    suffix = F.concat_ws("|", F.regexp_extract(host, r"([^.]*)$", 1), F.lower(F.regexp_extract("url", r"://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1)))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]+)", 1))
    rows = pages.select(F.when(number != "", number.cast("long")).alias("__id"), F.struct("page_id", declared.alias("declared"), suffix.alias("suffix"), host.alias("host")).alias("p"))
    return rows.where("__id is not null").groupBy("__id").agg(F.array_sort(F.collect_list("p")).alias("pages"))


def _add_totals(rows: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Rows with the totals of their key. Few keys are broadcast; of many, those that hold a thousandth of the weight or more, and the rest is joined by a shuffle."""
    if totals.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(totals), key)
    every = totals.agg(F.sum("weight")).first()[0]
    heavy = F.broadcast(totals.where(F.col("weight") * 1000 >= every))
    light = rows.join(heavy.select(key), key, "left_anti").join(totals, key)
    return rows.join(heavy, key).unionByName(light)


def identify(
    docs: DataFrame,
    pages: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    group_col: str = "source",
    sample: int = SAMPLE,
    train_on: DataFrame | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each document: doc_id, language ("und" if undecided), posterior, text_language, declared, host, accepted, and the columns in ``keep``.

    A document is rejected when it has no letters (by Unicode category) or its trigrams fit none of the languages; one that is only
    ambiguous gets its likeliest language and a low posterior. A language of the same script that no label names can still pass for its neighbour.
    ``label_col`` is used to train only, on rows of ``train_on`` where that is given. All pages of a document count: their evidence is averaged, and each
    has an equal part of the document in the priors; declared and host are those of the first. Where no page tells a host, ``group_col`` stands for it. Null texts count as
    empty and are rejected; without labelled rows all are "und". Ids may be null or repeat: each row gets its own answer. Whole texts count, however long.
    """
    langs, model = train(docs if train_on is None else train_on, text_col, label_col, id_col, sample)
    if not langs:
        none = (F.lit(None).cast("string").alias(c) for c in ("text_language", "declared", "host"))
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), *none, F.lit(False).alias("accepted"), *keep)
    L = len(langs)
    arr = lambda f: F.array(*[f(k) for k in range(L)])

    def soft(col: Column) -> Column:
        e = F.transform(col, lambda x: F.exp(x - F.array_max(col)))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))

    # Names of the caller's columns don't meet those made here.
    carried = [F.col(f"`{c}`").alias(f"__keep{k}") for k, c in enumerate(keep)]
    held = tuple(f"__keep{k}" for k in range(len(keep)))
    source = docs.select(F.col(id_col).alias("__in_id"), F.col(text_col).alias("__in_text"), F.col(group_col).cast("string").alias("__group"), *carried)
    chance = float(np.clip(known_grams(model).mean(), 1e-6, SEEN - 0.05))
    strange = F.col("seen") * F.lit(math.log(chance / SEEN)) + (F.col("grams") - F.col("seen")) * F.lit(math.log((1 - chance) / (1 - SEEN)))
    scored = text_evidence(source, "__in_text", "__in_id", langs, model, ("__group", *held))
    scored = scored.withColumn("ll", F.transform("like", lambda x: x * TEMPER)).withColumn("post", soft(F.col("ll")))
    scored = scored.withColumn("fits", F.col("letters") & (strange * TEMPER + F.lit(math.log(NONE)) <= 0))
    # The number of a row is written with it, so that it stays the same.
    scored = materialise(scored.drop("like", "letters", "grams", "seen").withColumn("__row", F.monotonically_increasing_id()), "evidence")
    none = F.array(F.struct(F.lit(None).cast("long").alias("page_id"), F.lit("").alias("declared"), F.lit("").alias("suffix"), F.lit("").alias("host")))
    seen = scored.join(page_evidence(pages), "__id", "left") if pages is not None else scored.withColumn("pages", F.lit(None))
    seen = seen.withColumn("pages", F.coalesce(F.col("pages").cast("array<struct<page_id:long,declared:string,suffix:string,host:string>>"), none))
    host = lambda p: F.coalesce(F.nullif(p["host"], F.lit("")), F.col("__group"), F.lit(""))
    # One row for each page of a document; most documents have one or none.
    each = seen.withColumn("first_host", host(F.col("pages")[0])).withColumn("first_declared", F.col("pages")[0]["declared"])
    each = each.withColumn("part", F.lit(1.0) / F.size("pages")).withColumn("p", F.explode("pages"))
    each = each.withColumns({"host": host(F.col("p")), "suffix": F.coalesce("p.suffix", F.lit("")), "declared": F.coalesce("p.declared", F.lit(""))}).drop("p", "pages")
    each = each.withColumn("site", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    # A document's own part of the sums, by language; plans grow with the number of languages and not with its square.
    own = F.transform("post", lambda x: x * F.col("part"))
    each = each.withColumn("own", F.when(F.col("fits"), own).otherwise(F.array(*[F.lit(0.0)] * L)))
    total = lambda col, name: arr(lambda k: F.sum(F.col(col)[k])).alias(name)
    # One grouping by all four gives the tables of each: hosts with their sites, suffixes, all.
    cells = materialise(each.groupBy("host", "site", "suffix").agg(total("own", "n"), F.sum("part").alias("weight")), "cells")
    every = cells.agg(total("n", "a")).first()["a"]
    a = np.array([float(v or 0) for v in every])
    base = ((a + 1) / (a.sum() + L)).tolist()
    joined = each
    for key, c in (("host", "h"), ("site", "s"), ("suffix", "x")):
        joined = _add_totals(joined, materialise(cells.groupBy(key).agg(total("n", c), F.sum("weight").alias("weight")), key), key).drop("weight")
    joined = joined.withColumn("base", F.array(*map(F.lit, base)))
    for c in ("h", "s", "x"):
        joined = joined.withColumn(c, F.zip_with(c, "own", lambda v, o: F.greatest(v - o, F.lit(0.0)))).withColumn(f"{c}n", F.aggregate(c, F.lit(0.0), lambda t, v: t + v))
    for prior, c, parent in (("sp", "s", "base"), ("hp", "h", "sp"), ("xp", "x", "base")):
        total_of = F.col(f"{c}n") + STRENGTH
        joined = joined.withColumn(prior, F.zip_with(c, parent, lambda v, q: (v + STRENGTH * q) / total_of))
    said = F.col("declared").isin(langs)
    declared = lambda k: F.when(~said, 0.0).when(F.col("declared") == langs[k], F.log(F.lit(TRUST))).otherwise(F.log(F.lit((1 - TRUST) / max(L - 1, 1))))
    suffix = lambda k: F.when(F.col("suffix") == "", 0.0).otherwise(F.log(F.col("xp")[k] / F.lit(base[k])))
    joined = joined.withColumn("told", arr(lambda k: F.col("part") * (F.log(F.col("hp")[k]) + suffix(k) + declared(k))))
    out = ("__row", "__id", "ll", "post", "fits", "first_host", "first_declared", *held)
    # Pages of one document meet again; a document with one page needs no shuffle.
    alone = joined.where("part = 1").select(*out, "told")
    several = joined.where("part < 1").groupBy("__row").agg(*[F.any_value(c).alias(c) for c in out[1:]], total("told", "told"))
    fused = alone.unionByName(several).withColumn("fused", soft(F.zip_with("ll", "told", lambda x, y: x + y)))
    best = F.array_max("fused")
    name = lambda col, top: F.element_at(F.array(*map(F.lit, langs)), F.array_position(col, top).cast("int"))
    sure = F.col("fits")
    return fused.select(
        F.col("__id").alias("doc_id"),
        F.when(sure, name(F.col("fused"), best)).otherwise("und").alias("language"),
        F.round(best, 6).alias("posterior"),
        F.when(sure, name(F.col("post"), F.array_max("post"))).alias("text_language"),
        F.nullif("first_declared", F.lit("")).alias("declared"),
        F.col("first_host").alias("host"),
        sure.alias("accepted"),
        *[F.col(f"__keep{k}").alias(c) for k, c in enumerate(keep)],
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, with the evidence of ``pages``; see :func:`identify`."""
    return identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))
