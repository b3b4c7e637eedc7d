"""License scan by patience alignment.

Words are runs of letters and digits, lower-cased.  A template is found where a stretch of
a text aligns with at least ``COVERAGE`` of the template's words: words unique to both
sides are anchors, the longest increasing subsequence of the anchors is kept, and the gaps
between kept anchors are aligned in the same way (equal words at the ends of a gap match
first).

Stretches are sought around seeds: of a template of m words at most m - need can stay
unmatched, so one of the m - need + 1 template words rarest in the text must be part of
every match.  Each occurrence of these words opens stretches around the place where the
template would lie, the widest taking matches spread over ``STRETCH`` template lengths, so a
text that repeats a license, or hides it in the
middle of 20,000 words, is scanned whole.  Overlapping finds of one template give the best
one.

Null and empty texts, and texts without a find, give no rows; neither does a table without
rows.  Rows that repeat a doc_id are scanned each by itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8
STRETCH = 1.5
_WORDS = re.compile(r"[^\W_]+").findall
# fixed values: wording of public license notices
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
        OF ANY KIND, either express or implied.""",
    "MIT": "Released under the MIT License",
    "MIT-notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
        and associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "BSD-notice": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met""",
    "ISC-notice": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0""",
    "All-rights-reserved": "All rights reserved",
}


def words(text: str) -> list[str]:
    return _WORDS(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    ends: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(ends, v)
        back.append(at[k - 1] if k else -1)
        if k == len(ends):
            ends.append(v)
            at.append(i)
        else:
            ends[k], at[k] = v, i
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions (in a, in b), increasing in both."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a.get(w) == 1}
        anchors = [(i, place[a[i]]) for i in range(a0, a1) if a[i] in place]
        if not anchors:
            continue
        anchors = [anchors[k] for k in increasing([j for _, j in anchors])]
        found += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(found)


@dataclass(frozen=True)
class Find:
    license: str
    coverage: float
    matched: int
    first: int
    last: int


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE, stretch: float = STRETCH):
        self.templates = {name: words(t) for name, t in templates.items()}
        self.coverage, self.stretch = coverage, stretch
        self.vocabulary = {w for t in self.templates.values() for w in t}
        self.counts = {name: Counter(t) for name, t in self.templates.items()}
        self.need = {name: -int(-coverage * len(t) // 1) for name, t in self.templates.items()}

    def scan(self, text: str) -> list[Find]:
        body = words(text)
        present = self.vocabulary.intersection(body)
        possible = [name for name, c in self.counts.items()
                    if sum(n for w, n in c.items() if w in present) >= self.need[name]]
        if not possible:
            return []
        places: dict[str, list[int]] = {}
        for i, w in enumerate(body):
            if w in present:
                places.setdefault(w, []).append(i)
        return [f for name in possible for f in self._finds(name, body, places)]

    def _finds(self, name: str, body: list[str], places: dict[str, list[int]]) -> list[Find]:
        template, need = self.templates[name], self.need[name]
        m = len(template)
        rarest = sorted(range(m), key=lambda k: (len(places.get(template[k], ())), k))[:m - need + 1]
        reach = int(self.stretch * m)
        # wide for insertions; narrow so that a license said again next to it hides no anchor
        opened = sorted({(max(0, p - k - slack), min(len(body), p - k + m + slack))
                         for k in rarest for p in places.get(template[k], ()) for slack in (0, m // 4, reach - m // 2)})
        finds = []
        for a, b in opened:
            pairs = self._tightest(patience(body[a:b], template), reach)
            if len(pairs) >= need:
                finds.append(Find(name, len(pairs) / m, len(pairs), a + pairs[0][0], a + pairs[-1][0]))
        best: list[Find] = []
        for f in sorted(finds, key=lambda f: (-f.matched, f.last - f.first, f.first)):
            if all(f.last < g.first or f.first > g.last for g in best):
                best.append(f)
        return sorted(best, key=lambda f: f.first)

    @staticmethod
    def _tightest(pairs: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
        """The run of matches that spans at most ``reach`` words and holds most of them."""
        best, lo = (0, 0), 0
        for hi in range(len(pairs)):
            while pairs[hi][0] - pairs[lo][0] >= reach:
                lo += 1
            if hi + 1 - lo > best[1] - best[0]:
                best = (lo, hi + 1)
        return pairs[best[0]:best[1]]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per find in ``docs(doc_id, text)``: doc_id, license, coverage, matched,
    first_word and last_word (positions of words from 0)."""
    scanner = Scanner(templates or TEMPLATES, coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, f.license, f.coverage, f.matched, f.first, f.last)
                    for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")) if t.is_valid
                    for f in scanner.scan(t.as_py())]
            cols = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)],
                names=["doc_id", "license", "coverage", "matched", "first_word", "last_word"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, license string, coverage double, matched long, "
                                "first_word long, last_word long")
