"""Lexicon operators: membership, phrase spans, tokens in spans, extraction from annotated corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PLAIN_TOKEN

CLASSES = ("anatomy", "substance", "device", "pathology", "location", "living", "object", "phenomenon", "physiology", "procedure")
#: Classes of known names and places, looked up by token.
KNOWN = ("name", "title", "suffix", "city", "country")
#: A lexicon is broadcast up to so many terms, by a count; beyond, the join shuffles.
BROADCAST_TERMS = 200_000


def lexicon(terms: DataFrame) -> DataFrame:
    """(term, class) to (term_lower, n_tokens, class): lower-cased, trimmed, distinct, blanks dropped."""
    low = F.lower(F.trim("term"))
    return terms.select(low.alias("term_lower"), "class").where("term_lower <> ''").distinct().withColumn("n_tokens", F.size(F.filter(F.regexp_extract_all("term_lower", F.lit(PLAIN_TOKEN), 0), lambda t: ~t.rlike(r"^\s$"))).cast("long"))


def _sized(lex: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(lex) if lex.limit(limit + 1).count() <= limit else lex


def _wide(lex: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    return lex.groupBy("term_lower").agg(*[F.max((F.col("class") == c).cast("int")).alias(f"is_{c}") for c in classes])


def flags(lex: DataFrame, classes: tuple[str, ...] = CLASSES, limit: int = BROADCAST_TERMS) -> dict[str, str] | None:
    """The 0/1 columns of :func:`members` by term, parted by one space; of a lexicon of more than ``limit`` terms, none."""
    rows = _wide(lex, classes).select("term_lower", F.concat_ws(" ", *[F.coalesce(F.col(f"is_{c}"), F.lit(0)) for c in classes]).alias("f")).limit(limit + 1).collect()
    return {r["term_lower"]: r["f"] for r in rows if r["term_lower"] is not None} if len(rows) <= limit else None


def members(tokens: DataFrame, lex: DataFrame, limit: int = BROADCAST_TERMS, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """One 0/1 column for each class: is the lower-cased token a term of it. One join on a lexicon with one row a term."""
    wide = _wide(lex, classes)
    out = tokens.withColumn("term_lower", F.lower("tok")).join(_sized(wide, limit), "term_lower", "left").drop("term_lower")
    return out.fillna(0, [f"is_{c}" for c in classes])


def phrase_spans(tokens: DataFrame, lex: DataFrame, longest: int | None = None, limit: int = BROADCAST_TERMS) -> DataFrame:
    """(doc_id, class, n_start, n_end, term): where terms of one or more tokens stand, in numbers of tokens that aren't blank.

    Only tokens that begin a term are looked at further. Of spans of a class that overlap, the one that begins first stays;
    of those that begin together, the longest.
    """
    k = longest or int(lex.agg(F.max("n_tokens")).first()[0] or 1)
    solid = tokens.where(~F.col("tok").rlike(r"^\s$"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    low = F.lower("tok")
    numbered = solid.select("doc_id", low.alias("head"), (F.row_number().over(w) - 1).cast("long").alias("n_start"), *[F.lead(low, j).over(w).alias(f"t{j}") for j in range(1, k)])
    terms = lex.select(F.array_join(F.filter(F.regexp_extract_all("term_lower", F.lit(PLAIN_TOKEN), 0), lambda t: ~t.rlike(r"^\s$")), " ").alias("phrase"), F.col("n_tokens").alias("n"), "class").distinct()
    heads = _sized(terms.select(F.split("phrase", " ")[0].alias("head")).distinct(), limit)
    begins = numbered.join(heads, "head", "left_semi")
    grams = F.explode(F.filter(F.array(*[F.when(F.array(F.lit(0), *[F.col(f"t{j}").isNull().cast("int") for j in range(1, n)]).getItem(n - 1) == 0, F.struct(F.lit(n).cast("long").alias("n"), F.concat_ws(" ", F.col("head"), *[F.col(f"t{j}") for j in range(1, n)]).alias("phrase"))) for n in range(1, k + 1)]), lambda g: g.isNotNull()))
    found = begins.select("doc_id", "n_start", grams.alias("g")).select("doc_id", "n_start", "g.n", "g.phrase").join(_sized(terms, limit), ["phrase", "n"])
    spans = found.select("doc_id", "class", "n_start", (F.col("n_start") + F.col("n") - 1).alias("n_end"), F.col("phrase").alias("term"))
    best = spans.groupBy("doc_id", "class", "n_start").agg(F.max(F.struct("n_end", "term")).alias("b")).select("doc_id", "class", "n_start", "b.n_end", "b.term")
    return _without_overlap(best)


def _without_overlap(spans: DataFrame) -> DataFrame:
    """Left to right, drop a span that begins inside one that stays.

    Spans that no span before them reaches stay in any case and part the others into chains, each no longer than its overlaps;
    the fold goes over one chain, so that the work grows with the spans of a text and not with their square.
    """
    w = Window.partitionBy("doc_id", "class").orderBy("n_start")
    free = F.coalesce(F.col("n_start") > F.max("n_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    chained = spans.withColumn("free", free).withColumn("chain", F.sum(F.col("free").cast("int")).over(w))
    listed = chained.groupBy("doc_id", "class", "chain").agg(F.array_sort(F.collect_list(F.struct("n_start", "n_end", "term"))).alias("s"))
    empty = F.filter(F.col("s"), lambda x: F.lit(False))
    kept = F.aggregate("s", empty, lambda acc, x: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["n_end"] < x["n_start"]), F.concat(acc, F.array(x))).otherwise(acc))
    return listed.select("doc_id", "class", F.explode(kept).alias("x")).select("doc_id", "class", "x.n_start", "x.n_end", "x.term")


def tokens_in_spans(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n, class) of all tokens that a span covers: spans are exploded to tokens, then an equi-join."""
    cells = spans.select("doc_id", "class", F.explode(F.sequence("n_start", "n_end")).alias("n")).distinct()
    w = Window.partitionBy("doc_id").orderBy("pos")
    solid = tokens.where(~F.col("tok").rlike(r"^\s$")).select("doc_id", (F.row_number().over(w) - 1).cast("long").alias("n"), "tok")
    return solid.join(cells, ["doc_id", "n"])


def email_url_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, found) of the emails and addresses in the texts."""
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "url": r"(?:https?://|www\.)[^\s<>\"]+"}
    found = lambda kind, pattern: F.transform(F.regexp_extract_all("text", F.lit(pattern), 0), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("found")))
    each = [found(k, p) for k, p in kinds.items()]
    return docs.select("doc_id", F.explode_outer(F.concat(*each)).alias("e")).where("e is not null").select("doc_id", "e.kind", "e.found")


def lexicon_from_corpus(corpus: DataFrame) -> DataFrame:
    """Distinct annotated texts by type."""
    return corpus.select("type", "text").where("text is not null").distinct()
