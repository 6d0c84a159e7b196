"""Features and pseudonyms of single values in Python, equal to the Columns of ``features`` and ``pseudonym``: for passes that ask once for each distinct value."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable
from itertools import groupby
from operator import itemgetter

from .pseudonym import NAMES
from .text import MONTHS

_PUNCT = {**dict.fromkeys("([{", "OPENBRACKET"), **dict.fromkeys(")]}", "ENDBRACKET"), ".": "DOT", ",": "COMMA", **dict.fromkeys("-–", "HYPHEN"), **dict.fromkeys("\"'`’", "QUOTE")}
SHAPE = {"Lu": "X", "Ll": "x", "Nd": "d", "Nl": "d", "No": "d"}
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
_YEAR, _HTTP = re.compile("(19|20)[0-9]{2}"), re.compile(r"https?://|www\.")
_DATES = re.compile(r"[0-9]{1,2}/[0-9]{1,2}/(?:[0-9]{4}|[0-9]{2})|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}")
MONTH_NAMES = frozenset(MONTHS)
_WORDED = re.compile(r"[0-9]{1,2} (\S+) [0-9]{4}")


def categories(token: str) -> list[str]:
    return [unicodedata.category(c) for c in token]


def features(t: str, names: list[str]) -> str:
    """The features of a token that don't depend on its place, parted by one space."""
    kind, low = categories(t), t.lower()
    shape = "".join(SHAPE.get(k, "c") for k in kind)
    digits = [k[0] == "N" for k in kind]
    number = bool(kind) and all(digits)
    upper = bool(kind) and all(k == "Lu" for k in kind)

    made = {
        "tok": t, "low": low, "p1": low[:1], "p2": low[:2], "p3": low[:3], "p4": low[:4], "p5": low[:5], "s1": low[-1:], "s2": low[-2:], "s3": low[-3:], "s4": low[-4:], "s5": low[-5:],
        "caps": "NOCAPS" if number else "ALLCAP" if upper else "INITCAP" if kind[:1] == ["Lu"] else "NOCAPS",
        "digit": "ALLDIGIT" if number else "CONTAINSDIGITS" if any(digits) else "NODIGIT",
        "single": "1" if len(t) == 1 else "0",
        "punct": _PUNCT.get(t) or ("PUNCT" if kind and all(k[0] == "P" for k in kind) else "NOPUNCT"),
        "year": "1" if number and _YEAR.fullmatch(t) else "0", "month": "1" if low in MONTHS else "0", "email": "1" if "@" in t and _EMAIL.fullmatch(t) else "0", "http": "1" if _HTTP.match(t) else "0",
        "shape": shape, "trimmed": "".join([c for c, _ in groupby(shape)]) if "trimmed" in names else "",
    }
    return " ".join([made[x] for x in names])


#: Features in the order in which words and numbers of ASCII give them; for most words that is all, and several times cheaper.
_ORDER = ("tok", "low", "p1", "p2", "p3", "p4", "p5", "s1", "s2", "s3", "s4", "s5", "caps", "digit", "single", "punct", "year", "month", "email", "http", "shape", "trimmed")
_CASES = str.maketrans({**dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "X"), **dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "x")})


def features_of(names: list[str]) -> Callable[[str], str]:
    """:func:`features` of a token as a function of the token."""
    places = [_ORDER.index(x) for x in names]
    take = itemgetter(*places) if len(places) > 1 else lambda made: (made[places[0]],)

    def of(t: str) -> str:
        if not t.isascii() or not t.isalnum():
            return features(t, names)
        n = len(t)
        if t.isdigit():
            year = "1" if n == 4 and t[:2] in ("19", "20") else "0"
            return " ".join(take((t, t, t[:1], t[:2], t[:3], t[:4], t[:5], t[-1:], t[-2:], t[-3:], t[-4:], t[-5:], "NOCAPS", "ALLDIGIT", "1" if n == 1 else "0", "NOPUNCT", year, "0", "0", "0", "d" * n, "d")))
        if not t.isalpha():
            return features(t, names)
        low = t.lower()
        if low == t:
            caps, shape, trimmed = "NOCAPS", "x" * n, "x"
        elif t.isupper():
            caps, shape, trimmed = "ALLCAP", "X" * n, "X"
        else:
            shape = t.translate(_CASES)
            caps, trimmed = "INITCAP" if shape[0] == "X" else "NOCAPS", "".join([c for c, _ in groupby(shape)])
        return " ".join(take((t, low, low[:1], low[:2], low[:3], low[:4], low[:5], low[-1:], low[-2:], low[-3:], low[-4:], low[-5:], caps, "NODIGIT", "1" if n == 1 else "0", "NOPUNCT", "0", "1" if low in MONTH_NAMES else "0", "0", "0", shape, trimmed)))

    return of


def pick(key: str, value: str, counter: int, n: int) -> int:
    return int(hashlib.md5(f"{key}|{value}|{counter}".encode()).hexdigest()[:8], 16) % n


def mask_number(value: str, key: str) -> str:
    return "".join([str((int(c) + 1 + pick(key, value, i, 9)) % 10) if "0" <= c <= "9" else c for i, c in enumerate(value)])


def mask_name(value: str, key: str) -> str:
    out = []
    for word in value.split(" "):
        new = NAMES[pick(key, word.lower(), 0, len(NAMES))]
        capitals = word.isalpha() and word.isupper() if word.isascii() else all(k == "Lu" for k in categories(word))
        out.append(new.upper() if len(word) > 1 and capitals else new)
    return " ".join(out)


def mask_email(value: str, key: str) -> str:
    if "@" not in value:
        return value
    local, domain = value.split("@")[:2]
    return ".".join([NAMES[pick(key, p.lower(), 0, len(NAMES))].lower() for p in local.split(".")]) + "@" + domain


MASKS = {"name": mask_name, "idno": mask_number, "email": mask_email}


def normalize_space(text: str) -> str:
    return re.sub("[ \t\n\x0b\f\r]+", " ", text).strip(" ")


def letters_and_digits(text: str) -> list[str]:
    """Runs of letters and runs of digits, as the plain tokenizer cuts them."""
    if text.isascii():
        return [text] if text.isalpha() else re.findall("[A-Za-z]+|[0-9]+", text)
    return ["".join(g) for kind, g in groupby(text, lambda c: unicodedata.category(c)[0]) if kind in "LN"]


def initcap(text: str) -> str:
    """Spark's initcap: the first character behind each space in title case, all others lower."""
    if text.isascii() and text.isalpha():
        return text.capitalize()
    # a lower-cased İ comes back as one character
    first = lambda w: "İ" + w[2:] if w.startswith("i\u0307") else w[:1].title() + w[1:]
    return " ".join([first(w) for w in text.lower().split(" ")])


def plain(text: str) -> bool:
    """No date of a known shape and no number: such values have variants in case."""
    if text.isascii() and text.isalpha():
        return True
    if _DATES.fullmatch(text) or all(k[0] == "N" for k in categories(text)) and text:
        return False
    worded = _WORDED.fullmatch(text)
    return worded is None or not all(k[0] == "L" for k in categories(worded[1]))


def parts(kind: str, original: str, pseudo: str) -> list[tuple[str, str]]:
    """A pair and its aligned parts: those longer than 1 (names: 2)."""
    least = 2 if kind == "name" else 1
    return [(original, pseudo), *[(o, p) for o, p in zip(letters_and_digits(original), letters_and_digits(pseudo), strict=False) if len(o) > least]]


def variants(original: str, pseudo: str) -> list[tuple[str, str]]:
    if not plain(original):
        return [(original, pseudo)]
    return [(f(original), f(pseudo)) for f in (lambda x: x, str.upper, str.lower, initcap)]
