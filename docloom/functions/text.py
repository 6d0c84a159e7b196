"""Scalar text functions as Columns. All stay inside the JVM; classes are ``\\p{L}`` and ``\\p{N}``, never ``\\w``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: An email stays one token; else runs of letters, runs of digits, and every other character alone, white space included.
#: Possessive runs (``++``) match the same and never step back: what follows a run is no character of it.
TOKEN = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\p{L}++|\p{N}++|[^\p{L}\p{N}]"
PLAIN_TOKEN = r"\p{L}++|\p{N}++|[^\p{L}\p{N}]"
MARKERS = r"@IMAGE|@PAGE|\.(pbm|ppm|png|svg|jpg)"
DETERMINERS = ("le", "la", "les", "l", "un", "une", "des", "du", "de", "d", "au", "aux", "ce", "cet", "cette", "ces", "mon", "ma", "mes", "son", "sa", "ses", "notre", "nos", "votre", "vos", "leur", "leurs")
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "was", "that", "for", "with"),
    "fr": ("le", "la", "les", "des", "et", "en", "du", "une", "que", "est"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "mit", "den", "auf"),
    "es": ("el", "los", "las", "una", "que", "por", "con", "para", "del", "su"),
}
MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
#: The six shapes of a raw date that are recognised; anything else is left alone.
DATE_SHAPES = (
    r"^\d{1,2}/\d{1,2}/\d{4}$",
    r"^\d{1,2}/\d{1,2}/\d{2}$",
    r"^\d{1,2}-\d{1,2}-\d{4}$",
    r"^\d{1,2}\.\d{1,2}\.\d{4}$",
    r"^\d{4}-\d{1,2}-\d{1,2}$",
    r"^\d{1,2} \p{L}+ \d{4}$",
)


def tokenize(text: Column, pattern: str = TOKEN) -> Column:
    """All tokens in order, delimiters kept: their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def white_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+"), 0)


def lines(text: Column) -> Column:
    return F.split(text, r"[\n\r]")


def first_token(line: Column) -> Column:
    """First of the tokens parted by space, tab, form feed or no-break space."""
    return F.regexp_extract(line, r"([^ \t\f ]+)", 1)


def second_token(line: Column) -> Column:
    return F.regexp_extract(line, r"[^ \t\f ]+[ \t\f ]+([^ \t\f ]+)", 1)


def is_marker(line: Column) -> Column:
    return line.rlike(MARKERS)


def strip_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"\s", "")


def normalize_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def dehyphenize(text: Column) -> Column:
    """Join words that a line break parts behind a hyphen, when a lower-case letter follows."""
    return F.regexp_replace(text, r"(\p{L})-[ \t]*\r?\n[ \t]*(\p{Ll})", "$1$2")


def title_case(text: Column) -> Column:
    """Upper-case the first character behind each space, lower-case all others."""
    return F.initcap(text)


def flatten_export(text: Column) -> Column:
    return F.translate(text, "\r\n\t;", "   ,")


def xml_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def bullets(text: Column) -> Column:
    return F.replace(text, F.lit("@BULLET"), F.lit("•"))


def language_scores(text: Column) -> Column:
    """A struct of the counts of stop words in the first 200 characters, by language."""
    words = F.split(F.lower(F.substring(text, 1, 200)), r"[^\p{L}]+")
    count = lambda stop: F.size(F.filter(words, lambda w: w.isin(*stop))).cast("long")
    return F.struct(*[count(stop).alias(lang) for lang, stop in STOP_WORDS.items()])


def detected_language(scores: Column) -> Column:
    """The language with most stop words; of equal ones the first in order, ``und`` without any."""
    most = F.greatest(*[scores[lang] for lang in STOP_WORDS])
    out = F.lit("und")
    for lang in reversed(STOP_WORDS):
        out = F.when((most > 0) & (scores[lang] == most), lang).otherwise(out)
    return out


def nfc(text: Column) -> Column:
    """Canonical composition; Spark has no such function, so whole Arrow batches go through Python."""

    @F.pandas_udf("string")
    def compose(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return compose(text)


def sentences(text: Column) -> Column:
    """Sentences end behind a run of ``.!?`` that white space follows; they keep what stands between them, so that offsets add up."""
    return F.regexp_extract_all(text, F.lit(r"(?s).+?(?:[.!?]+\s+|$)"), 0)


def partial_iso(year: Column, month: Column, day: Column) -> Column:
    """ISO date of the parts that are there; -1 is absent, and a day needs a month."""
    y = F.when(year > -1, F.lpad(year.cast("string"), 4, "0"))
    m = F.when((year > -1) & (month > -1), F.lpad(month.cast("string"), 2, "0"))
    d = F.when((year > -1) & (month > -1) & (day > -1), F.lpad(day.cast("string"), 2, "0"))
    return F.concat_ws("-", y, m, d)


def raw_date(text: Column) -> Column:
    """A date from one of the known shapes, French month names included; null when none fits or the day doesn't exist."""
    t = F.lower(normalize_space(text))
    out = F.lit(None).cast("string")
    slash = lambda sep: F.concat_ws("-", F.regexp_extract(t, rf"^(\d{{1,2}}){sep}(\d{{1,2}}){sep}(\d{{4}})$", 3), F.lpad(F.regexp_extract(t, rf"^(\d{{1,2}}){sep}(\d{{1,2}}){sep}(\d{{4}})$", 2), 2, "0"), F.lpad(F.regexp_extract(t, rf"^(\d{{1,2}}){sep}(\d{{1,2}}){sep}(\d{{4}})$", 1), 2, "0"))
    for sep in ("/", "-", r"\."):
        out = F.when(t.rlike(rf"^\d{{1,2}}{sep}\d{{1,2}}{sep}\d{{4}}$"), slash(sep)).otherwise(out)
    out = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).otherwise(out)
    named = r"^(\d{1,2})(?:er)? (\p{L}+) (\d{4})$"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(t, named, 2))
    out = F.when(t.rlike(named) & (month > 0), F.concat_ws("-", F.regexp_extract(t, named, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(t, named, 1), 2, "0"))).otherwise(out)
    return F.try_to_date(out, "yyyy-MM-dd").cast("string")


def date_shape(text: Column) -> Column:
    """The number of the first shape that fits, from 1; 0 without one."""
    out = F.lit(0)
    for k, shape in reversed(list(enumerate(DATE_SHAPES, 1))):
        out = F.when(text.rlike(shape), k).otherwise(out)
    return out.cast("long")


_NUMBERING = (r"^(\d+(?:\.\d+)*\.?)\s+(.*)$", r"^([IVXLC]+\.?)\s+(.*)$", r"^([A-Z]\.)\s+(.*)$")


def section_number(head: Column) -> tuple[Column, Column]:
    """(number, title) of a heading: decimal, Roman or letter numbering; an empty number without one."""
    number, title = F.lit(""), head
    for pattern in reversed(_NUMBERING):
        fits = head.rlike(pattern)
        number, title = F.when(fits, F.regexp_extract(head, pattern, 1)).otherwise(number), F.when(fits, F.regexp_extract(head, pattern, 2)).otherwise(title)
    return number, title


def note_number(note: Column) -> tuple[Column, Column]:
    return F.regexp_extract(note, r"^(\d+)(.*)", 1), F.when(note.rlike(r"^\d+"), F.regexp_extract(note, r"^(\d+)(.*)", 2)).otherwise(note)


def capitalize_name(name: Column) -> Column:
    """Lower-case all but what follows one of ``-.,;:/_`` or a space. Two capitals alone are initials: ``JM`` gives ``J M``."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"[^ .,;:/_-]+|[ .,;:/_-]"), 0)
    joined = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")
    return F.when(name.rlike(r"^\p{Lu}{2}$"), F.concat_ws(" ", F.substring(name, 1, 1), F.substring(name, 2, 1))).otherwise(joined)


def same_content(a: Column, b: Column) -> Column:
    """Equal but for case and spaces."""
    squeeze = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("")))
    return squeeze(a) == squeeze(b)


def contains_content(a: Column, b: Column) -> Column:
    """b stands in a, but for case, spaces and hyphens."""
    squeeze = lambda c: F.translate(F.lower(c), " -", "")
    return F.contains(squeeze(a), squeeze(b))


def strip_brackets(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[()\[\]{}]", ""))


def local_parts(email: Column) -> Column:
    return F.split(F.split(email, "@")[0], r"\.")


def is_determiner(word: Column) -> Column:
    return F.lower(word).isin(*DETERMINERS)
