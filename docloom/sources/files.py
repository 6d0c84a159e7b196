"""Sources and sinks. All read and write through Spark, so any store it knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import flatten_export

LAYOUT = (
    "doc_id BIGINT, token_no INT, block_no INT, line_no INT, page INT, text STRING, char_offset INT, x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, font STRING, font_size DOUBLE, bold BOOLEAN, italic BOOLEAN, superscript BOOLEAN"
)


def read_binary(spark: SparkSession, path: str, pattern: str = "*.{pdf,PDF}", recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of the files of a folder and those below it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_layout(spark: SparkSession, path: str, first_page: int = 0, last_page: int | None = None) -> DataFrame:
    """Positioned tokens within a window of pages; the filter reaches the scan."""
    rows = spark.read.schema(LAYOUT).parquet(path).where(F.col("page") >= first_page)
    return rows if last_page is None else rows.where(F.col("page") <= last_page)


def from_strings(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(doc_id, text) of a form's strings."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def with_digest(files: DataFrame) -> DataFrame:
    """Upper-case MD5 of the content."""
    return files.withColumn("md5", F.upper(F.md5("content")))


def read_lexicon(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(term, class) of files with one term a line."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("term"), F.lit(name).alias("class")).where("term <> ''").distinct()


def parse_pairs(lines: DataFrame, column: str = "value") -> DataFrame:
    """(original, pseudo) of lines with a tab between; a line without a tab has an empty pseudonym."""
    part = lambda k: F.split_part(column, F.lit("\t"), F.lit(k))
    return lines.select(part(1).alias("original"), part(2).alias("pseudo"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(original, pseudo) of tab-separated files; blank lines are left out."""
    return parse_pairs(spark.read.text(path).where("trim(value) <> ''"))


def write_pairs(mapping: DataFrame, path: str) -> None:
    mapping.select("original", "pseudo").orderBy("original").write.csv(path, sep="\t", quote="")


def export_rows(docs: DataFrame) -> DataFrame:
    """(Document_ID, Raw_Text) on one line each."""
    return docs.select(F.col("doc_id").alias("Document_ID"), flatten_export(F.col("text")).alias("Raw_Text"))


def write_export(docs: DataFrame, path: str) -> None:
    export_rows(docs).write.csv(path, sep=";", header=True)


def write_xml(rows: DataFrame, path: str, xml_col: str = "xml", id_col: str = "doc_id", parts: int = 64) -> None:
    """XML of each document, one a line, in folders by a bounded number of hash buckets: a folder for each document would not scale."""
    rows.select(F.pmod(F.xxhash64(id_col), F.lit(parts)).alias("bucket"), F.concat_ws("\t", F.col(id_col).cast("string"), F.regexp_replace(xml_col, r"\s*\n\s*", " ")).alias("value")).write.partitionBy("bucket").text(path)


def write_features(lines: DataFrame, path: str) -> None:
    lines.select(F.col("features").alias("value")).write.text(path)


def write_lexicons(rows: DataFrame, path: str) -> None:
    """Distinct terms, one folder a type."""
    rows.select("type", F.col("text").alias("value")).distinct().write.partitionBy("type").text(path)


def write_training(rows: DataFrame, path: str) -> None:
    """(doc_id, model, variant, payload) as one long table, by model and variant."""
    rows.write.partitionBy("model", "variant").parquet(path)


def merge_corpora(parts: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All rows of several corpora, and apart from them those without content, with a reason."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    bad = F.coalesce(F.trim("xml"), F.lit("")) == ""
    return out.where(~bad), out.where(bad).select("doc_id", F.lit("merge").alias("stage"), F.lit("empty").alias("reason"))


def copy_assets(files: DataFrame) -> DataFrame:
    """(name, content) of images: png and jpg."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.where(F.lower("path").rlike(r"\.(png|jpe?g)$")).select(name.alias("name"), "content")


def html_zones(pages: DataFrame) -> DataFrame:
    """(page_id, title, lang, nav_links, n_paragraphs, body) of web pages: scripts, styles, comments and navigation are cut, tags dropped, entities decoded."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav)[^>]*>.*?</(?:script|style|nav)>|<!--.*?-->", " ")
    body = F.regexp_extract(bare, r"(?is)<body[^>]*>(.*)", 1)
    text = F.regexp_replace(body, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    nav = F.regexp_extract(html, r"(?is)<nav[^>]*>(.*?)</nav>", 1)
    return pages.select(
        "page_id", F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_extract(html, r'(?i)<html[^>]*lang="([A-Za-z-]+)"', 1).alias("lang"),
        F.size(F.regexp_extract_all(nav, F.lit("(?i)<a "), 0)).cast("long").alias("nav_links"), F.size(F.regexp_extract_all(body, F.lit("(?i)<p[ >]"), 0)).cast("long").alias("n_paragraphs"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("body"),
    )
