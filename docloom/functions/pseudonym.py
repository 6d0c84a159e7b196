"""Deterministic replacement of personal data as Columns.

Every choice follows from md5 of a key, the value and a counter, so that a value is replaced alike in all documents and
runs. A keyed hash of a short value can be guessed: real de-identification needs a secret key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MONTHS

NAMES = ("Martin", "Bernard", "Thomas", "Petit", "Robert", "Richard", "Durand", "Dubois", "Moreau", "Laurent", "Simon", "Michel", "Garcia", "David", "Bertrand", "Roux")


def pick(key: str, value: Column, counter: Column, n: int | Column) -> Column:
    """A number from 0 to n - 1."""
    digest = F.md5(F.concat_ws("|", F.lit(key), value, counter.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n))


def mask_number(value: Column, key: str) -> Column:
    """Each digit becomes another one, never itself; everything else stays."""
    chars = F.split(value, "")
    other = lambda c, i: F.pmod(c.cast("int") + 1 + pick(key, value, i, 9), F.lit(10)).cast("string")
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("^[0-9]$"), other(c, i)).otherwise(c)), "")


def mask_name(value: Column, key: str) -> Column:
    """Each word becomes a name of the list; a word in capitals stays in capitals."""
    names = F.array(*map(F.lit, NAMES))

    def one(word: Column, i: Column) -> Column:
        new = F.element_at(names, (pick(key, F.lower(word), F.lit(0), len(NAMES)) + 1).cast("int"))
        return F.when(word.rlike(r"^\p{Lu}{2,}$"), F.upper(new)).otherwise(new)

    return F.array_join(F.transform(F.split(value, " "), one), " ")


def mask_email(value: Column, key: str) -> Column:
    """Each piece of the local part becomes a lower-case name; the domain stays."""
    names = F.array(*map(F.lit, NAMES))
    piece = lambda p, i: F.lower(F.element_at(names, (pick(key, F.lower(p), F.lit(0), len(NAMES)) + 1).cast("int")))
    return F.concat(F.array_join(F.transform(F.split(F.split(value, "@")[0], r"\."), piece), "."), F.lit("@"), F.split(value, "@")[1])


def shift_date(value: Column, key: str, days: int = 3650) -> Column:
    """An ISO date moved back by 1 to ``days`` days; null stays null, and so does what is no date."""
    d = F.try_to_date(value, "yyyy-MM-dd")
    return F.date_sub(d, (pick(key, value, F.lit(0), days) + 1).cast("int")).cast("string")


def shift_raw_date(value: Column, key: str) -> Column:
    """A raw date of the shape d/m/y, or with a month's name, keeps its separators and gets another day, month and year, of as many digits.

    A day may have ``er`` behind it, and a year two digits. Of any other value the digits are masked, so that no date stays readable.
    """
    shape = r"^(\d{1,2})([/.-])(\d{1,2})([/.-])(\d{4}|\d{2})$"
    part = lambda g: F.regexp_extract(value, shape, g)
    day = F.lpad((pick(key, value, F.lit(1), 28) + 1).cast("string"), 2, "0")
    month = F.lpad((pick(key, value, F.lit(2), 12) + 1).cast("string"), 2, "0")
    long_year = F.lit(1920) + pick(key, value, F.lit(3), 100)
    year = lambda old: F.when(F.length(old) == 2, F.lpad(F.pmod(long_year, F.lit(100)).cast("string"), 2, "0")).otherwise(long_year.cast("string"))
    named = r"^(\d{1,2})(?:er)?(\s+)(\p{L}+)(\s+)(\d{4}|\d{2})$"
    gap = lambda g: F.regexp_extract(value, named, g)
    name = F.element_at(F.array(*map(F.lit, MONTHS)), (pick(key, value, F.lit(2), 12) + 1).cast("int"))
    known = value.rlike(named) & F.lower(gap(3)).isin(*MONTHS)
    dashed = F.concat(day, part(2), month, part(4), year(part(5)))
    return F.when(value.rlike(shape), dashed).when(known, F.concat(day, gap(2), name, gap(4), year(gap(5)))).otherwise(mask_number(value, key))
