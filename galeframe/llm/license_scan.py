"""License scans by patience alignment.

A template is a statement or notice of a license, as words. Around each of its telling words in a
text a window of about the template's length is aligned: words that occur once in the window and
once in the template are anchors, the longest increasing run of their places is kept, and the gaps
between the kept anchors are aligned in the same way, with words equal at a gap's two ends matched
first. Coverage is the share of the template's words that end up matched; a window counts as a
finding when it reaches min_coverage. After a finding the scan goes on behind its end, so a text
with many notices, or one notice many times, gives every finding, over its whole length.

Neighbouring licenses differ by single words, which coverage alone would forgive. So a finding must
match every license name of its template (NAMES), and the marks in and next to it (NC, SA, ND,
Lesser, Affero: MARKS) must be those of the template, no more and no less. A statement, that is a
template of at most STATEMENT words, must also match one of its words of licensing and may be
spread over slack words more than it has.

Edge cases: null and empty texts have no finding; equal rows are scanned each; of two templates
that cover one stretch the one with more matched words stays. Columns besides doc_id and text are
not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import text_slices
from galeframe.llm.textkit import words

# fixed values: notices and texts of common licenses (a long license by its head), statements made of the names below, and words too common to start a window
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WHOLE = _ISC + (
    " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_FSF = "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation"
_FSF_HEAD = "GNU {} Version {} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_LONG = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL", "This work is licensed under the GNU General Public License, version"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC", "Licensed under CC BY-NC"),
    ("CC-BY-SA", "Licensed under CC BY-SA"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MIT", _MIT),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the Apache License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL", _FSF_HEAD.format("General Public License", "3, 29 June 2007")),
    ("GPL", _FSF_HEAD.format("General Public License", "2, June 1991")),
    ("LGPL", _FSF.format("This library", "Lesser General Public License")),
    ("LGPL", _FSF.format("This library", "Library General Public License")),
    ("LGPL", _FSF_HEAD.format("Lesser General Public License", "3, 29 June 2007")),
    ("LGPL", _FSF_HEAD.format("Lesser General Public License", "2.1, February 1999")),
    ("LGPL", _FSF_HEAD.format("Library General Public License", "2, June 1991")),
    ("AGPL", _FSF.format("This program", "Affero General Public License")),
    ("AGPL", _FSF_HEAD.format("Affero General Public License", "3, 19 November 2007")),
    ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("MPL", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("ISC", _ISC),
    ("ISC", _ISC_WHOLE),
    ("BSD", _BSD + _BSD_END),
    ("BSD", _BSD + _BSD_THIRD + _BSD_END),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
)
# names as notices spell them; articles and GNU may stand between the words of a statement
_SPELT = {
    "MIT": ("MIT License", "MIT", "Expat License"),
    "Apache-2.0": ("Apache License", "Apache Software License", "Apache Public License", "Apache 2", "ASL 2"),
    "Apache-1": ("Apache License 1", "Apache License Version 1", "Apache Software License 1", "Apache Software License Version 1", "Apache 1"),
    "GPL": ("General Public License", "GPL", "GPLv2", "GPLv3"),
    "LGPL": ("Lesser General Public License", "Library General Public License", "Lesser GPL", "LGPL", "LGPLv2", "LGPLv3"),
    "AGPL": ("Affero General Public License", "Affero GPL", "AGPL", "AGPLv3"),
    "MPL": ("Mozilla Public License", "MPL"),
    "ISC": ("ISC License", "ISC"),
    "BSD": ("BSD License", "BSD", "BSD style license", "2 clause BSD License", "3 clause BSD License", "New BSD License", "Simplified BSD License"),
    "EPL": ("Eclipse Public License", "EPL"),
    "BSL": ("Boost Software License", "BSL 1"),
    "Zlib": ("zlib License", "zlib"),
    "Unlicense": ("Unlicense",),
    "CC0": ("CC0", "CC Zero", "Creative Commons Zero"),
    **{
        "-".join(("CC-BY", *kind)): tuple(
            " ".join((name, *(spelling[k] for k in kind)))
            for name, spelling in (
                ("CC BY", {k: k for k in ("NC", "SA", "ND")}), ("Creative Commons BY", {k: k for k in ("NC", "SA", "ND")}),
                ("Creative Commons Attribution", {"NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}), ("Creative Commons Attribution", {"NC": "Non Commercial", "SA": "Share Alike", "ND": "No Derivatives"}),
                ("CC Attribution", {"NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}),
            )
        )
        for kind in ((), ("SA",), ("NC",), ("ND",), ("NC", "SA"), ("NC", "ND"))
    },
}
_WORDINGS = ("under {}", "licensed under {}", "released under {}", "distributed under {}", "made available under {}", "under terms of {}", "this work is licensed under {}", "subject to terms of {}", "SPDX License Identifier {}")
TEMPLATES = (*_LONG, *dict.fromkeys((name, wording.format(spelt)) for name, spellings in _SPELT.items() for spelt in spellings for wording in _WORDINGS))
COMMON = frozenset("a and any are as at be by can for free in is it may not of or terms that the this to under use with without work you your version license licensed released 0 1 2 3 4 5".split())
STATEMENT = 16
LICENSING = frozenset("under licensed released distributed available terms subject spdx".split())
NAMES = frozenset("mit expat apache asl general gpl gplv2 gplv3 lgpl lgplv2 lgplv3 agpl agplv3 mozilla mpl isc bsd eclipse epl boost bsl zlib unlicense cc cc0 creative commons zero".split())
# what tells neighbouring licenses apart, by spelling; a mark may begin inside a finding and end behind it
MARKS = {
    "nc": "nc", "noncommercial": "nc", "non commercial": "nc", "sa": "sa", "sharealike": "sa", "share alike": "sa", "nd": "nd", "noderivatives": "nd", "noderivs": "nd", "no derivatives": "nd", "no derivative works": "nd", "no derivs": "nd",
    "lesser": "lesser", "library general": "lesser", "affero": "affero",
    "apache 1": "apache 1", "apache license 1": "apache 1", "apache license version 1": "apache 1", "apache software license 1": "apache 1", "apache software license version 1": "apache 1",
}
SPELLINGS = {"licence": "license", "licenced": "licensed", "sublicence": "sublicense"}


@dataclass(frozen=True)
class LicenseConfig:
    """A finding covers min_coverage of a template, in a window that is slack words wider on each side."""

    min_coverage: float = 0.8
    slack: int = 4


def longest_rise(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        j = bisect_left(tops, v)
        before.append(at[j - 1] if j else -1)
        tops[j : j + 1], at[j : j + 1] = [v], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(template: list[int], text: list[int]) -> list[tuple[int, int]]:
    """Matched places (in template, in text), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(template), 0, len(text))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and template[a] == text[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and template[b - 1] == text[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        n, m = Counter(template[a:b]), Counter(text[c:d])
        place = {w: i for i, w in enumerate(text[c:d], c) if m[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(template[a:b], a) if n[w] == 1 and w in place]
        kept = [anchors[i] for i in longest_rise([j for _, j in anchors])]
        if not kept:
            continue
        out += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        todo += [(i + 1, x, j + 1, y) for (i, j), (x, y) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


def _hashed(text: str) -> tuple[list[int], list[str]]:
    """The words of a text, as hashes and as they are spelt."""
    found = words(pa.array([text]))
    return found.hashes().tolist(), [bytes(found.data[s:e]).decode() for s, e in zip(found.starts, found.ends, strict=True)]


class _Template:
    def __init__(self, name: str, text: str, marks: dict[int, list[tuple[list[int], str]]], min_coverage: float):
        self.name = name
        self.words, spelt = _hashed(text)
        self.counts = Counter(self.words)
        self.need = int(np.ceil(min_coverage * len(self.words) - 1e-9))
        self.statement = len(spelt) <= STATEMENT
        self.named = {h for h, w in zip(self.words, spelt, strict=True) if w in NAMES}
        self.licensing = {h for h, w in zip(self.words, spelt, strict=True) if w in LICENSING} if self.statement else set()
        self.telling = {h for h, w in zip(self.words, spelt, strict=True) if w not in COMMON}
        if self.statement and self.named:
            self.telling = self.named
        elif not self.telling:
            self.telling = set(self.words)
        # a finding misses at most size - need words, so it has one of any size - need + 1 words; long ones are rare. It has every name
        rare = sorted(range(len(spelt)), key=lambda i: (spelt[i] in COMMON, -len(spelt[i])))[: len(spelt) - self.need + 1]
        self.gate = {max(self.named)} if self.named else {self.words[i] for i in rare}
        self.marks = {m for i in range(len(self.words)) for m, _ in _marks_at(self.words, i, marks)}


def _marks_at(hashes: list[int], i: int, marks: dict[int, list[tuple[list[int], str]]]) -> list[tuple[str, int]]:
    """(mark, its words) of the marks that begin at a place."""
    return [(m, len(form)) for form, m in marks.get(hashes[i], ()) if hashes[i : i + len(form)] == form]


class Templates:
    """Templates as word hashes, with what finds those worth aligning."""

    def __init__(self, given: tuple[tuple[str, str], ...], min_coverage: float):
        self.marks: dict[int, list[tuple[list[int], str]]] = {}
        for spelt, mark in MARKS.items():
            form = _hashed(spelt)[0]
            self.marks.setdefault(form[0], []).append((form, mark))
        self.all = [_Template(name, text, self.marks, min_coverage) for name, text in given if words(pa.array([text])).starts.size]
        self.wanted = set().union(*(t.counts for t in self.all))
        self.by_gate: dict[int, list[int]] = {}
        for k, t in enumerate(self.all):
            for h in t.gate:
                self.by_gate.setdefault(h, []).append(k)
        self.telling = np.array(sorted(self.by_gate), np.uint64)
        self.same = [(np.uint64(_hashed(a)[0][0]), np.uint64(_hashed(b)[0][0])) for a, b in SPELLINGS.items()]
        self.longest = max((len(form) for forms in self.marks.values() for form, _ in forms), default=0)

    def marks_near(self, hashes: list[int], first: int, end: int) -> set[str]:
        """The marks that begin in [first, end) or join it without a word between."""
        out = set()
        for i in range(first, end):
            out |= {m for m, _ in _marks_at(hashes, i, self.marks)}
        while end < len(hashes) and (more := _marks_at(hashes, end, self.marks)):
            out |= {m for m, _ in more}
            end += max(n for _, n in more)
        joined = True
        while joined:
            joined = False
            for i in range(max(0, first - self.longest), first):
                if more := [m for m, n in _marks_at(hashes, i, self.marks) if i + n == first]:
                    out |= set(more)
                    first, joined = i, True
                    break
        return out


@lru_cache(maxsize=16)
def templates(given: tuple[tuple[str, str], ...] = TEMPLATES, min_coverage: float = 0.8) -> Templates:
    """Templates as word hashes, made once a process."""
    return Templates(given, min_coverage)


def scan_words(hashes: list[int], cfg: LicenseConfig = LicenseConfig(), given: tuple[tuple[str, str], ...] = TEMPLATES) -> list[tuple[str, int, int, int, float]]:
    """(license, first word, word after the last, matched words, coverage) of a text's words, in order of place."""
    found: list[tuple[str, int, int, int, float]] = []
    places: dict[int, list[int]] = {}
    known = templates(given, cfg.min_coverage)
    for i, h in enumerate(hashes):
        if h in known.wanted:
            places.setdefault(h, []).append(i)
    for k in sorted({k for h in known.by_gate.keys() & places.keys() for k in known.by_gate[h]}):
        t = known.all[k]
        size, need = len(t.words), t.need
        if any(h not in places for h in t.named):
            continue
        if sum(min(n, len(places.get(h, ()))) for h, n in t.counts.items()) < need:
            continue
        seeds = sorted(i for h in t.telling for i in places.get(h, ()))
        behind = 0
        for s in seeds:
            if s < behind:
                continue
            lo, hi = max(behind, s - size - cfg.slack), min(len(hashes), s + size + cfg.slack)
            window = hashes[lo:hi]
            have = Counter(h for h in window if h in t.counts)
            if sum(min(n, have[h]) for h, n in t.counts.items()) < need:
                continue
            # the window may hold the end of one notice and the start of the next: align what begins at its densest stretch too
            best: list[tuple[int, int]] = []
            first = s - lo
            stretches = [(0, len(window)), (max(0, first - cfg.slack), len(window)), (0, min(len(window), first + size))]
            if t.statement:  # of a statement, also what begins at each of its first words
                stretches += [(a, min(len(window), a + size + cfg.slack)) for a in range(len(window)) if window[a] == t.words[0]]
            for a, b in stretches:
                got = [(i, j + a) for i, j in align(t.words, window[a:b])]
                if len(got) > len(best) and len(got) >= need and _says(t, got, window, known, hashes, lo, cfg):
                    best = got
            if best:
                found.append((t.name, lo + best[0][1], lo + best[-1][1] + 1, len(best), len(best) / size))
                behind = lo + best[-1][1] + 1
    found.sort(key=lambda x: (-x[3], x[1], x[0]))
    kept: list[tuple[str, int, int, int, float]] = []
    for f in found:
        if all(f[2] <= k[1] or f[1] >= k[2] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda x: x[1])


def _says(t: _Template, got: list[tuple[int, int]], window: list[int], known: Templates, hashes: list[int], lo: int, cfg: LicenseConfig) -> bool:
    """Whether an alignment names the template's license and not a neighbour of it."""
    matched = {t.words[i] for i, _ in got}
    if not t.named <= matched or t.licensing and not t.licensing & matched:
        return False
    first, end = got[0][1], got[-1][1] + 1
    if t.statement and end - first > len(t.words) + cfg.slack:
        return False
    return known.marks_near(hashes, lo + first, lo + end) == t.marks


_FOUND = pa.list_(pa.struct([("license", pa.string()), ("first_char", pa.int64()), ("end_char", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())]))


def _scan(cfg: LicenseConfig, given: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = templates(given, cfg.min_coverage)
        telling = known.telling
        maybe = np.zeros(1 << 20, bool)
        maybe[(telling & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = words(part.column("text"))
                h = found.hashes()
                for a, b in known.same:
                    h[h == a] = b
                at = np.flatnonzero(maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
                at = at[np.isin(h[at], telling)]
                some = np.unique(np.searchsorted(found.first, at, "right") - 1)  # texts with a telling word
                rows: list[list] = [[] for _ in range(part.num_rows)]
                for i in some:
                    f, e, o = found.first[i], found.first[i + 1], found.offsets[i]
                    spans = scan_words(h[f:e].tolist(), cfg, given)
                    if spans:
                        data = found.data[o : found.offsets[i + 1]]
                        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                        rows[i] = [{"license": n, "first_char": int(chars[found.starts[f + a] - o]), "end_char": int(chars[found.ends[f + b - 1] - o]), "matched": m, "coverage": c} for n, a, b, m, c in spans]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, _FOUND)], names=["doc_id", "findings"])

    return run


def scan(docs: DataFrame, cfg: LicenseConfig = LicenseConfig(), given: Iterable[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, findings: one row per row of docs, without any shuffle; given: (license, text) of each template."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scan(cfg, tuple((name, text) for name, text in given)), "doc_id long, findings array<struct<license: string, first_char: long, end_char: long, matched: long, coverage: double>>")
