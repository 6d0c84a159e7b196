"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Windows are twice as long as the templates of their length class and start every class length, so that each passage of
template length lies inside a window. The number of bands follows from the least Jaccard similarity that a window
which contains four fifths of a template can have: such a pair meets in a band with probability ``MEET`` or more.
Windows that share fewer shingles with the templates than the least of their class needs are not sketched: they can't
contain four fifths of one. Templates are full license texts, their paragraphs, and sentences. Notices, and templates of
fewer words than a shingle has, match by all of their words: one other word there may be another license or version.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import bound_batches, table, text_slices
from ._words import BYTE_HASH, Words, mix

U = np.uint64
SHINGLE, CONTAINED, MEET = 5, 0.8, 0.9999
_FOLD = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _FOLD[_a:_b] = np.arange(_a, _b)
_FOLD[65:91] = np.arange(97, 123)

#: Short notices and the telling sentences of common licenses.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty.",),
}

_FSF = "as published by the Free Software Foundation"
#: Short notices with their versions; all words have to stand there. A notice inside a longer one is part of it.
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"),
    "MIT": ("MIT License", "MIT Licence"),
    "BSD-2-Clause": ("BSD 2-Clause", "2-clause BSD"),
    "BSD-3-Clause": ("BSD 3-Clause", "3-clause BSD"),
    "ISC": ("ISC License",),
    "MPL-1.1": ("Mozilla Public License, version 1.1", "Mozilla Public License, v. 1.1", "MPL 1.1"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"),
    "EPL-1.0": ("Eclipse Public License v1.0", "Eclipse Public License, version 1.0", "Eclipse Public License 1.0", "EPL 1.0"),
    "EPL-2.0": ("Eclipse Public License v2.0", "Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v. 2.0", "EPL 2.0"),
    "CC0-1.0": ("CC0 1.0",),
    "Unlicense": ("The Unlicense",),
    "GPL": ("GNU General Public License",),
    "LGPL": ("GNU Lesser General Public License", "GNU Library General Public License"),
    "AGPL": ("GNU Affero General Public License",),
    **{
        f"{short}-{v}": tuple(x for name in names for x in (f"{name}, version {v.removesuffix('.0')}", f"{name} version {v}", f"{name} v{v.removesuffix('.0')}", f"{name} v{v}", f"{name} {_FSF}, either version {v.removesuffix('.0')}", f"{name} {_FSF}; either version {v}", f"{name} {_FSF}, version {v.removesuffix('.0')}", f"{name} {_FSF}; version {v}"))
        + tuple(f"{short}{x}" for x in (f"v{v.removesuffix('.0')}", f"v{v}", f"-{v}", f" {v}"))
        for short, names, versions in (("GPL", ("GNU General Public License",), ("1.0", "2.0", "3.0")), ("LGPL", ("GNU Lesser General Public License", "GNU Library General Public License"), ("2.0", "2.1", "3.0")), ("AGPL", ("GNU Affero General Public License",), ("3.0",)))
        for v in versions
    },
    **{
        f"CC-{short}-{v}": (f"CC {short} {v}", f"Creative Commons {long} {v}")
        for short, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivs"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivs"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0")
        if "NoDeriv" not in long or long.endswith("NoDerivatives") == (v == "4.0")
    },
    "All-rights-reserved": ("All rights reserved",),
}
#: Paragraphs of full texts with so many words are templates of their own: a license is often quoted in part.
PARAGRAPH = 20


def full_texts() -> dict[str, tuple[str, ...]]:
    """Each license of ``license_texts`` whole, then its paragraphs."""
    out = {}
    for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = f.read_text("utf-8")
        parts = [p for p in re.split(r"\n\s*\n", text) if len(re.findall(r"[A-Za-z0-9]+", p)) >= PARAGRAPH]
        out[f.stem] = tuple(dict.fromkeys([text, *parts]))
    return out


def all_templates() -> dict[str, tuple[str, ...]]:
    """Sentences and full texts by license."""
    full = full_texts()
    return {n: (*TEMPLATES.get(n, ()), *full.get(n, ())) for n in [*TEMPLATES, *(n for n in full if n not in TEMPLATES)]}


def license_words(texts: list[str] | pa.Array) -> Words:
    """Words of letters and digits, lower-cased in A-Z; all other ASCII characters part them."""
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    column = column.fill_null("")
    off, data = column.buffers()[1], column.buffers()[2]
    if data is None or not data.size:
        return Words(column)
    folded = pa.py_buffer(_FOLD[np.frombuffer(data, np.uint8)].tobytes())
    return Words(pa.Array.from_buffers(pa.string(), len(column), [None, off, folded], 0, column.offset))


class Index:
    """Templates by length class, with the bands that retrieve them."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, contained: float = CONTAINED, meet: float = MEET, seed: int = 11, notices: dict[str, tuple[str, ...]] | None = None):
        self.contained = contained
        kinds = (templates, notices or {})
        self.names = [n for kind in kinds for n, ts in kind.items() for _ in ts]
        words = license_words([t for kind in kinds for ts in kind.values() for t in ts])
        self.lengths = words.counts.tolist()
        whole = sum(map(len, templates.values()))
        if not all(self.lengths):
            raise ValueError("a template needs a word")
        each = words.hashes()
        pair = words.grams(each, 2)[0]
        #: Notices by their first two words, or by their only one.
        self.exact = (defaultdict(list), defaultdict(list))
        for r, n in enumerate(self.lengths):
            if n < SHINGLE or r >= whole:
                first = words.first[r]
                self.exact[n > 1][int((pair if n > 1 else each)[first])].append((r, each[first : first + n]))
        h, ok = words.grams(words.hashes(), SHINGLE)
        row = words.row[: len(h)][ok]
        self.shingles = [np.unique(h[ok][row == r]) for r in range(words.rows)]
        by_shingle = [r for r, n in enumerate(self.lengths) if n >= SHINGLE and r < whole]
        self.known = np.unique(np.concatenate([self.shingles[r] for r in by_shingle])) if by_shingle else np.zeros(0, U)
        rng = np.random.RandomState(seed)
        self.classes: dict[int, tuple] = {}
        by_class = defaultdict(list)
        for r in by_shingle:
            by_class[1 << max(3, math.ceil(math.log2(self.lengths[r])))].append(r)
        for c, members in by_class.items():
            wide = 2 * c - SHINGLE + 1
            least = min((lambda s, k: k / (wide + s - k))(len(self.shingles[r]), self.need(r)) for r in members)
            rows = 1 if least < 0.3 else 2
            bands = math.ceil(math.log(1 - meet) / math.log(1 - least**rows))
            salts = rng.randint(1, 2**62, bands * rows).astype(U)
            found = defaultdict(list)
            for r in members:
                for b, key in enumerate(self.bands(self.shingles[r], salts, rows).tolist()):
                    found[b, key].append(r)
            self.classes[c] = (salts, rows, dict(found), min(map(self.need, members)))

    def need(self, r: int) -> int:
        return math.ceil(self.contained * len(self.shingles[r]) - 1e-9)

    @staticmethod
    def bands(shingles: np.ndarray, salts: np.ndarray, rows: int) -> np.ndarray:
        least = mix(shingles[None, :] ^ salts[:, None]).min(1).reshape(-1, rows)
        return mix(least[:, 0] * U(3) + (least[:, -1] if rows > 1 else U(0)))

    def scan(self, words: Words) -> list[tuple[int, int, int, int, float]]:
        """(row, template, first word, last word, containment) of all matches; matches of one template that overlap are one.

        Of matches over the same words the one with the greater containment stays, then the longer template: a notice or
        paragraph inside a text that matches as a whole is part of it.
        """
        each = words.hashes()
        h, ok = words.grams(each, SHINGLE)
        hit = np.zeros(0, np.int64)
        if len(h) and len(self.known):
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            hit = np.flatnonzero((self.known[at] == h) & ok)
        raw = self.notices(words, each)
        for c, (salts, rows, found, least) in self.classes.items():
            local = hit - words.first[words.row[hit]]
            seen = set()
            for row, k in zip(words.row[hit].tolist(), (local // c).tolist(), strict=True):
                for start in (k - 1, k):
                    if start < 0 or (row, start) in seen:
                        continue
                    seen.add((row, start))
                    first, end = words.first[row], words.first[row + 1]
                    a = first + start * c
                    b = min(a + 2 * c, end) - SHINGLE + 1
                    if b <= a or np.searchsorted(hit, b) - np.searchsorted(hit, a) < least:
                        continue
                    window = h[a:b]
                    have = np.unique(window)
                    for r in {r for b_, key in enumerate(self.bands(have, salts, rows).tolist()) for r in found.get((b_, key), ())}:
                        shared = np.isin(window, self.shingles[r])
                        share = np.isin(self.shingles[r], have).sum() / len(self.shingles[r])
                        if share >= self.contained - 1e-9:
                            spot = np.flatnonzero(shared)
                            raw.append((row, r, int(a - first + spot[0]), int(a - first + spot[-1] + SHINGLE - 1), float(share)))
        out: list[tuple[int, int, int, int, float]] = []
        for m in sorted(raw):
            if out and out[-1][:2] == m[:2] and m[2] <= out[-1][3]:
                out[-1] = (*m[:2], out[-1][2], max(out[-1][3], m[3]), max(out[-1][4], m[4]))
            else:
                out.append(m)
        return self.best(out)

    def notices(self, words: Words, each: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """Matches of the templates that need all of their words."""
        out = []
        for opening, known in zip((each, words.grams(each, 2)[0]), self.exact, strict=True):
            if not len(opening) or not known:
                continue
            openers = np.array(sorted(known), U)
            at = np.minimum(np.searchsorted(openers, opening), len(openers) - 1)
            for p in np.flatnonzero(openers[at] == opening).tolist():
                row = int(words.row[p])
                for r, wanted in known[int(opening[p])]:
                    if p + len(wanted) <= words.first[row + 1] and np.array_equal(each[p : p + len(wanted)], wanted):
                        first = p - int(words.first[row])
                        out.append((row, r, first, first + len(wanted) - 1, 1.0))
        return out

    def best(self, found: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, int, float]]:
        rank = lambda m: (m[4], self.lengths[m[1]])
        kept, open_ = [], []
        # what may cover a match comes before it; matches of one template don't overlap, so that few are open at once
        for m in sorted(found, key=lambda m: (m[0], m[2], -m[3], -m[4], -self.lengths[m[1]])):
            open_ = [o for o in open_ if o[0] == m[0] and o[3] >= m[2]]
            if not any(m[3] <= o[3] and rank(o) > rank(m) for o in open_):
                kept.append(m)
            open_.append(m)
        return sorted(kept)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, contained: float = CONTAINED, notices: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row for each match: doc_id, license, template, first_word, last_word, containment. Words count from 0, over letters and digits.

    Null and empty texts match nothing. Null ids come back as null; repeated rows give repeated matches.
    """
    bound_batches(docs.sparkSession)
    index = Index(templates, contained, notices=notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in text_slices(b):
                got = index.scan(license_words(s.column("text")))
                if got:
                    row, which, first, last, share = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [s.column("doc_id").take(pa.array(row)), pa.array([index.names[r] for r in which]), pa.array(which, pa.int32()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(share)], names=["doc_id", "license", "template", "first_word", "last_word", "containment"]
                    )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, template int, first_word long, last_word long, containment double")


def op4_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License texts, paragraphs, sentences and notices in all documents; see :func:`scan_licenses`."""
    return scan_licenses(table(spark, sf_dir, "documents"), templates=all_templates(), notices=NOTICES)
