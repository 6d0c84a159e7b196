"""Layout features over lines and positioned tokens: windows by document, in one distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import text as T

#: Lines of a page where the layout is derived from plain text.
PAGE_LINES = 40
#: Scales of positions, block spacing, character density and line length.
POSITION_BINS, SPACING_BINS, DENSITY_BINS, LENGTH_BINS = 12, 5, 5, 10


def text_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, block_no, page): lines by LF or CR; blocks end at empty lines, pages after a fixed number of lines."""
    # Texts are dealt before they are cut, as for tokens; lines of null texts go with the blank ones.
    rows = docs.select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode_outer(T.lines(F.col("text"))).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    block = F.sum((F.trim("line") == "").cast("int")).over(w)
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line", block.cast("long").alias("block_no"), F.floor(F.col("line_no") / PAGE_LINES).cast("long").alias("page")).where("trim(line) <> ''")


def status(rows: DataFrame, part: tuple[str, ...], order: str, name: str, words: tuple[str, str, str]) -> DataFrame:
    """START, IN or END of each row in its part; a part of one row is START."""
    w = Window.partitionBy(*part).orderBy(order)
    first, last = F.row_number().over(w) == 1, F.lead(F.lit(1)).over(w).isNull()
    return rows.withColumn(name, F.when(first, words[0]).when(last, words[2]).otherwise(words[1]))


def page_status(rows: DataFrame) -> DataFrame:
    """PAGESTART on the first row of a page; the last row before a page change is PAGEEND; else PAGEIN."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    start = F.coalesce(F.lag("page").over(w) != F.col("page"), F.lit(True))
    end = F.coalesce(F.lead("page").over(w) != F.col("page"), F.lit(False))
    return rows.withColumn("page_status", F.when(end, "PAGEEND").when(start, "PAGESTART").otherwise("PAGEIN"))


def positions(rows: DataFrame) -> DataFrame:
    """Relative place of each line in its document, by characters, in twelve steps."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("doc_id")
    at = F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0))
    return rows.withColumn("relative_position", X.scaled(at, F.sum(F.length("line") + 1).over(whole), POSITION_BINS))


def line_lengths(rows: DataFrame) -> DataFrame:
    """Length of each line against the longest of its block, in ten steps."""
    w = Window.partitionBy("doc_id", "block_no")
    return rows.withColumn("length_bin", X.scaled(F.length("line"), F.max(F.length("line")).over(w), LENGTH_BINS))


def repetitive(rows: DataFrame) -> DataFrame:
    """Edge patterns: the first line of the first two blocks and of the last block of a page, digits and spaces out, longer than 8,
    that occurs more than once in a document; and whether it is the first occurrence."""
    inside = Window.partitionBy("doc_id", "page", "block_no").orderBy("line_no")
    firsts = rows.withColumn("r", F.row_number().over(inside)).where("r = 1")
    page = Window.partitionBy("doc_id", "page").orderBy("block_no")
    firsts = firsts.withColumn("i", F.row_number().over(page) - 1).withColumn("size", F.count("*").over(Window.partitionBy("doc_id", "page")))
    edge = firsts.where("i < 2 or i > size - 2").withColumn("pattern", F.lower(F.regexp_replace("line", r"[\s\p{N}]", ""))).where("length(pattern) > 8")
    same = Window.partitionBy("doc_id", "pattern")
    out = edge.withColumn("n", F.count("*").over(same)).withColumn("k", F.row_number().over(same.orderBy("line_no")))
    return out.where("n > 1").select("doc_id", "line_no", "pattern", F.col("n").cast("long").alias("n"), (F.col("k") == 1).cast("int").alias("first"))


def fonts(tokens: DataFrame) -> DataFrame:
    """Font and size against the token before (the first is NEWFONT, HIGHERFONT), and against the zone: largest, smallest, above average."""
    w = Window.partitionBy("doc_id").orderBy("token_no")
    z = Window.partitionBy("doc_id", "zone")
    size, before = F.col("font_size").cast("int"), F.lag(F.col("font_size").cast("int")).over(w)
    return tokens.select(
        "*",
        F.when(F.lag("font").over(w) == F.col("font"), "SAMEFONT").otherwise("NEWFONT").alias("font_status"),
        F.when(before.isNull() | (size > before), "HIGHERFONT").when(size == before, "SAMEFONTSIZE").otherwise("LOWERFONT").alias("size_status"),
        (F.col("font_size") == F.max("font_size").over(z)).cast("int").alias("largest"),
        (F.col("font_size") == F.min("font_size").over(z)).cast("int").alias("smallest"),
        (F.col("font_size") > F.avg("font_size").over(z)).cast("int").alias("above_average"),
    )


def indentation(tokens: DataFrame) -> DataFrame:
    """A line start that moves right by over a character's width is ALIGNEDLEFT no more but LINEINDENT, until one moves left; other tokens hold the state."""
    starts = Window.partitionBy("doc_id").orderBy("token_no")
    line = Window.partitionBy("doc_id", "line_no").orderBy("token_no")
    rows = tokens.withColumn("at_start", F.row_number().over(line) == 1)
    begin = rows.where("at_start").withColumn("before", F.lag("x").over(starts)).withColumn("wide", F.col("width") / F.greatest(F.length("text"), F.lit(1)))
    moved = begin.select("doc_id", "token_no", F.when(F.col("x") - F.col("before") > F.col("wide"), "LINEINDENT").when(F.col("before") - F.col("x") > F.col("wide"), "ALIGNEDLEFT").alias("moved"))
    held = rows.join(moved, ["doc_id", "token_no"], "left")
    state = F.last("moved", ignorenulls=True).over(starts.rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("indentation", F.coalesce(state, F.lit("ALIGNEDLEFT"))).drop("moved", "at_start")


def block_geometry(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Spacing to the block before and density of characters, in five steps; whether a block touches its page's main area."""
    w = Window.partitionBy("doc_id").orderBy("block_no")
    d = Window.partitionBy("doc_id")
    same = F.lag("page").over(w) == F.col("page")
    rows = blocks.withColumn("gap", F.when(same, F.col("y") - F.lag(F.col("y") + F.col("height")).over(w)))
    rows = rows.withColumn("largest", F.max(F.when(F.col("gap") > 0, F.col("gap"))).over(d))
    gap = F.when(F.col("gap") < 0, F.col("largest") / SPACING_BINS).otherwise(F.coalesce("gap", F.lit(0.0)))
    rows = rows.withColumn("spacing_bin", X.scaled(gap, F.col("largest"), SPACING_BINS))
    area = F.col("height") * F.col("width")
    dense = F.when(~T.is_marker(F.col("text")) & (area > 0), F.length("text") / area)
    rows = rows.withColumn("density", dense)
    low, high = F.min("density").over(d), F.max("density").over(d)
    rows = rows.withColumn("density_bin", F.when(F.col("density").isNull(), 0).otherwise(X.scaled(F.col("density") - low, F.when(high > low, high - low).otherwise(F.lit(1.0)), DENSITY_BINS)).cast("long"))
    area_of = pages.select("doc_id", "page", F.col("main_area.x").alias("mx"), F.col("main_area.y").alias("my"), F.col("main_area.w").alias("mw"), F.col("main_area.h").alias("mh"))
    touch = (F.col("x") < F.col("mx") + F.col("mw")) & (F.col("x") + F.col("width") > F.col("mx")) & (F.col("y") < F.col("my") + F.col("mh")) & (F.col("y") + F.col("height") > F.col("my"))
    return rows.join(area_of, ["doc_id", "page"], "left").withColumn("in_main_area", X.flag(touch)).select("doc_id", "block_no", "spacing_bin", "density_bin", "in_main_area")


def near_graphics(blocks: DataFrame, graphics: DataFrame, margin: float = 20.0) -> DataFrame:
    """(doc_id, block_no) of the blocks with a graphic of their page within ``margin``: an equi-join on the page, then boxes."""
    g = graphics.select("doc_id", "page", F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("width").alias("gw"), F.col("height").alias("gh"))
    close = (F.col("gx") < F.col("x") + F.col("width") + margin) & (F.col("gx") + F.col("gw") > F.col("x") - margin) & (F.col("gy") < F.col("y") + F.col("height") + margin) & (F.col("gy") + F.col("gh") > F.col("y") - margin)
    return blocks.alias("b").join(g, ["doc_id", "page"]).where(close).select("doc_id", "block_no").distinct()


def segmenter_vector(rows: DataFrame) -> DataFrame:
    """(doc_id, line_no, features): the feature line of each text line."""
    rows = status(rows, ("doc_id", "block_no"), "line_no", "block_status", ("BLOCKSTART", "BLOCKIN", "BLOCKEND"))
    rows = line_lengths(positions(page_status(rows)))
    head = T.first_token(F.col("line"))
    second = F.coalesce(F.nullif(T.second_token(F.col("line")), F.lit("")), F.lit("no"))
    low = F.lower(head)
    vector = X.serialise(
        head, second, low, *[X.prefix(low, n) for n in range(1, 5)], F.col("block_status"), F.col("page_status"), X.capitalisation(head), X.digits(head), X.single_char(head), X.flag(X.is_year(head)), X.flag(X.is_month(head)), X.flag(X.is_email(head)), X.flag(X.is_http(head)),
        F.col("relative_position"), X.profile_or_no(F.col("line")), F.length(X.punctuation_profile(F.col("line"))), F.col("length_bin"),
    )
    return rows.select("doc_id", "line_no", vector.alias("features"))
