"""Lexical features of tokens and lines as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MONTHS

EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
URL = r"^(https?://|www\.)"


def capitalisation(token: Column) -> Column:
    """ALLCAP, INITCAP or NOCAPS; digits alone are NOCAPS."""
    return F.when(token.rlike(r"^\p{N}+$"), "NOCAPS").when(token.rlike(r"^\p{Lu}+$"), "ALLCAP").when(token.rlike(r"^\p{Lu}"), "INITCAP").otherwise("NOCAPS")


def digits(token: Column) -> Column:
    return F.when(token.rlike(r"^\p{N}+$"), "ALLDIGIT").when(token.rlike(r"\p{N}"), "CONTAINSDIGITS").otherwise("NODIGIT")


def single_char(token: Column) -> Column:
    return (F.length(token) == 1).cast("int")


def punctuation(token: Column) -> Column:
    return (
        F.when(token.isin("(", "[", "{"), "OPENBRACKET")
        .when(token.isin(")", "]", "}"), "ENDBRACKET")
        .when(token == ".", "DOT")
        .when(token == ",", "COMMA")
        .when(token.isin("-", "–"), "HYPHEN")
        .when(token.isin('"', "'", "`", "’"), "QUOTE")
        .when(token.rlike(r"^\p{P}+$"), "PUNCT")
        .otherwise("NOPUNCT")
    )


def prefix(token: Column, n: int) -> Column:
    return F.left(token, F.lit(n))


def suffix(token: Column, n: int) -> Column:
    return F.right(token, F.lit(n))


def shape(token: Column) -> Column:
    """Upper-case letters as X, lower-case as x, digits as d, all else as c."""
    out = F.regexp_replace(token, r"[^\p{Lu}\p{Ll}\p{N}]", "\u0001")
    out = F.regexp_replace(out, r"\p{Lu}", "\u0002")
    out = F.regexp_replace(out, r"\p{Ll}", "\u0003")
    out = F.regexp_replace(out, r"\p{N}", "\u0004")
    return F.translate(out, "\u0001\u0002\u0003\u0004", "cXxd")


def trimmed_shape(shaped: Column) -> Column:
    """A shape with each run collapsed."""
    for c in "cXxd":
        shaped = F.regexp_replace(shaped, f"{c}+", c)
    return shaped


def punctuation_profile(line: Column) -> Column:
    return F.regexp_replace(line, r"[^\p{P}]", "")


def profile_or_no(line: Column) -> Column:
    p = punctuation_profile(line)
    return F.when(p == "", "no").otherwise(p)


def is_year(token: Column) -> Column:
    return token.rlike(r"^(19|20)[0-9]{2}$")


def is_month(token: Column) -> Column:
    return F.lower(token).isin(*MONTHS)


def is_email(token: Column) -> Column:
    return token.rlike(EMAIL)


def is_http(token: Column) -> Column:
    return token.rlike(URL)


def scaled(position: Column, length: Column, bins: int) -> Column:
    """Linear scaling of a position to ``bins`` steps, the last one clipped."""
    return F.least(F.floor(position * bins / F.greatest(length, F.lit(1))), F.lit(bins - 1)).cast("long")


def flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("int"), F.lit(0))


def serialise(*columns: Column) -> Column:
    """One feature line: values parted by one space."""
    return F.concat_ws(" ", *[c.cast("string") for c in columns])
