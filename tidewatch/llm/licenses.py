"""Licence scans: Dice coefficient of word bigrams against licence templates.

Texts and templates are normalised alike (A-Z in lower case, other characters than letters, digits
and bytes from 128 on separate words) and taken as multisets of word bigrams. A span of a document
is any run of its bigrams, up to the whole text, and is compared to a template by
2 * common / (sum of sizes). Bigrams at a span's ends that the template hasn't only lower this, so
spans from one of the template's own bigrams to another are compared, of all sizes that the size
bound 2 * min / (sum) admits. A place is looked at only if so many of the template's bigrams stand in
the longest admitted span that the threshold can be reached, so nearly every text is dropped before
any comparison. Of a template's spans that overlap the one of the highest coefficient counts, of
different templates' the one with the most common bigrams; what is left between them is searched
again, so all matches that don't overlap are found.

Defined results: null and empty texts match nothing; of equal coefficients the first template by
name wins; repeated rows give repeated results; extra columns don't matter.
"""

from __future__ import annotations

import math
from bisect import bisect
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Pieces, chunks, mix

THRESHOLD = 0.8

#: Public licence texts and notices, by SPDX name.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
    ),
}

_SPLIT = np.ones(256, bool)
_SPLIT[48:58] = _SPLIT[65:91] = _SPLIT[97:123] = _SPLIT[128:] = False
_U = np.uint64


def _bigrams(w: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(number of the first word, hash) of each pair of neighbouring words of a document."""
    at = np.flatnonzero(w.doc[:-1] == w.doc[1:]) if len(w.hash) else np.zeros(0, np.int64)
    return at, mix(w.hash[at] * _U(3) + w.hash[at + 1]).view(np.int64)


class Templates:
    """Templates as bigram counts, and the templates that have each bigram."""

    def __init__(self, texts: dict[str, tuple[str, ...]], threshold: float):
        self.threshold = threshold
        self.names, self.bags = [], []
        for name in sorted(texts):
            for text in texts[name]:
                for c in chunks(pa.array([text])):
                    self.names.append(name)
                    self.bags.append(Counter(_bigrams(Pieces(c, _SPLIT, lower=True))[1].tolist()))
        self.sizes = np.array([sum(b.values()) for b in self.bags], np.int64)
        self.known = np.unique(np.concatenate([list(b) for b in self.bags])) if self.bags else np.zeros(0, np.int64)
        #: For each template, which of the known bigrams it has.
        self.has = [np.isin(self.known, list(b)) for b in self.bags]

    def fits(self, size: int) -> np.ndarray:
        """Templates that the size bound admits for a span of so many bigrams."""
        return np.flatnonzero(2 * np.minimum(self.sizes, size) >= self.threshold * (self.sizes + size))

    def need(self, k: int) -> tuple[int, int]:
        """Bigrams of template k that a match has at least, and bigrams of any kind that it has at most."""
        s, t = int(self.sizes[k]), self.threshold
        return max(1, math.ceil(s * t / (2 - t) - 1e-9)), math.floor(s * (2 - t) / t + 1e-9)

    def starts(self, k: int, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Numbers of the places, of template k's bigrams in documents, at which a match can begin."""
        need, most = self.need(k)
        last = np.arange(need - 1, len(at))
        first = last - (need - 1)
        return first[(at[last] - at[first] < most) & (doc[last] == doc[first])]

    def spans(self, k: int, at: list[int], grams: list[int], starts: list[int]) -> list[tuple[float, int, int, int, int]]:
        """(-dice, -common, first, end, k) of matches that don't overlap, from the places of template k's bigrams in a text."""
        bag, size, most, found = self.bags[k], int(self.sizes[k]), self.need(k)[1], []
        for i in starts:
            seen, common, best = Counter(), 0, None
            for j in range(i, len(at)):
                length = at[j] - at[i] + 1
                if length > most:
                    break
                seen[grams[j]] += 1
                common += seen[grams[j]] <= bag[grams[j]]
                x = (-2 * common / (length + size), -common, at[i], at[j] + 1, k)
                if -x[0] >= self.threshold and (best is None or x < best):
                    best = x
            if best:
                found.append(best)
        return _apart(sorted(found))


def _apart(found: list[tuple]) -> list[tuple]:
    """The matches of a list that overlap none before them."""
    out, taken = [], []
    for x in found:
        i = bisect(taken, (x[2], x[3]))
        if (i == 0 or taken[i - 1][1] <= x[2]) and (i == len(taken) or x[3] <= taken[i][0]):
            taken.insert(i, (x[2], x[3]))
            out.append(x)
    return out


def _scan(t: Templates, c) -> list[tuple[int, float, int]]:
    """(row in run, dice, template) of every match."""
    w = Pieces(c, _SPLIT, lower=True)
    at, gram = _bigrams(w)
    if not len(gram):
        return []
    pos = np.searchsorted(t.known, gram)
    pos[pos == len(t.known)] = 0
    hit = np.flatnonzero(t.known[pos] == gram)
    pos, doc = pos[hit], w.doc[at][hit]
    places, out = {}, []
    # Documents, and templates that some place of theirs can match.
    likely: dict[int, list[int]] = {}
    for k in np.flatnonzero(t.sizes > 0).tolist():
        own = np.flatnonzero(t.has[k][pos])
        places[k] = hit[own]
        for d in np.unique(doc[own][t.starts(k, hit[own], doc[own])]).tolist():
            likely.setdefault(d, []).append(k)
    first = np.searchsorted(w.doc[at], np.arange(c.n + 1)).tolist()
    for d, templates in likely.items():
        stretches = [(first[d], first[d + 1])]
        while stretches:
            lo, hi = stretches.pop()
            found = []
            for k in templates:
                own = places[k][slice(*np.searchsorted(places[k], (lo, hi)))]
                starts = t.starts(k, own, np.zeros(len(own)))
                if len(starts):
                    found += t.spans(k, own.tolist(), gram[own].tolist(), starts.tolist())
            found = _apart(sorted(found, key=lambda x: (x[1], x[0], x[4], x[2])))
            out += [(d, -x[0], x[4]) for x in found]
            if found:
                ends = [lo, *[e for x in sorted(found, key=lambda x: x[2]) for e in x[2:4]], hi]
                stretches += [(a, b) for a, b in zip(ends[::2], ends[1::2]) if a < b]
    return out


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_matches, license (of the best match; null: none), dice, licenses (all names, comma-joined) of every row."""
    texts = templates or TEMPLATES

    def run(batches):
        t = Templates(texts, threshold)
        for b in batches:
            for c in chunks(b.column("text")):
                n, best = [0] * c.n, [None] * c.n
                names: list[set[str]] = [set() for _ in range(c.n)]
                for d, dice, k in _scan(t, c):
                    n[d] += 1
                    names[d].add(t.names[k])
                    if best[d] is None or (-dice, t.names[k]) < (-best[d][0], best[d][1]):
                        best[d] = (dice, t.names[k])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(c.row, c.n),
                        pa.array(n, pa.int64()),
                        pa.array([x and x[1] for x in best], pa.string()),
                        pa.array([x and x[0] for x in best], pa.float64()),
                        pa.array([",".join(sorted(x)) for x in names], pa.string()),
                    ],
                    ["doc_id", "n_matches", "license", "dice", "licenses"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_matches long, license string, dice double, licenses string")
