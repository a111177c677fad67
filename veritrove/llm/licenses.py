"""License scans: MinHash bands over text windows retrieve templates, shingle containment verifies them.

Templates are notices and whole license texts. Those of similar length form a
class; for a class whose longest has n shingles, texts are cut into blocks of
n / 2 shingles and every three neighbouring blocks are a window, so windows
overlap and any place of a template lies in one whole. A window's MinHash values
are the least products of its shingles with odd numbers, and a band of ROWS
values agrees with probability s ** ROWS, s being the similarity of window and
template. Of BANDS bands one at least agrees with probability 1 - (1 - s **
ROWS) ** BANDS. A template of which a share c is there has s of at least
c r / (1.5 + (1 - c) r), r being its length over that of its class's longest:
0.47 for c = CONTAINMENT and r = 1, found with probability over 0.999, and 0.39
for the least r = CLASS, found with probability over 0.99.
Windows are looked at only where a band agrees.

A retrieved template is verified exactly: the share of its shingles that occur
in the window must reach `CONTAINMENT`, and so must that in the densest span of
the template's length.

Defined cases: null and empty texts have no matches; a text with the notice
several times has a match for each place; of overlapping matches of templates
the one of the higher containment stays, then of the longer, then the first by
name; repeated rows are scanned each; other columns pass through `row`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import annotate
from .words import ALNUM, mix, windows, word_hashes

SHINGLE = 2
BANDS, ROWS = 32, 2
CONTAINMENT = 0.8
#: The least length of a class's templates over that of its longest.
CLASS = 0.8

#: Notices by SPDX id, as projects write them in files and pages.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def retrieval_probability(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    return 1 - (1 - similarity**rows) ** bands


class Library:
    """The templates, their shingles, and their band keys by class."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.names = sorted(templates)
        words_at, hashes = word_hashes(pa.array([templates[n] for n in self.names], pa.string()), ALNUM)
        offsets, shingles = windows(hashes, words_at, SHINGLE)
        self.words = np.diff(words_at)
        self.shingles = [np.unique(shingles[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.factors = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(BANDS, ROWS) | np.uint32(1)
        #: (shingles of a block, templates) of each class, the longest first.
        self.classes: list[tuple[int, list[int]]] = []
        longest = 0
        for t in sorted((t for t in range(len(self.names)) if len(self.shingles[t])), key=lambda t: -len(self.shingles[t])):
            n = len(self.shingles[t])
            if not self.classes or n < CLASS * longest:
                longest = n
                self.classes.append((-(-n // 2), []))
            self.classes[-1][1].append(t)
        self.keys = [[[band_key([(short(self.shingles[t]) * f).min() for f in row]) for row in self.factors] for t in members] for _, members in self.classes]


def short(shingles: np.ndarray) -> np.ndarray:
    """32 bits of each shingle, for MinHash values; verification has all 64."""
    return (shingles >> np.uint64(32)).astype(np.uint32)


def band_key(values) -> np.ndarray:
    """A band's values as one number."""
    key = np.zeros(1, np.uint64)
    for v in values:
        key = key * np.uint64(0x9E3779B97F4A7C15) + np.atleast_1d(v).astype(np.uint64)
    return key


def blocks(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first shingle, row, blocks left in the row) of each block of `size` shingles; none crosses a row's end."""
    n = -(-np.diff(offsets) // size)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return offsets[row] + at * size, row, n[row] - at


def retrieved(shingles: np.ndarray, offsets: np.ndarray, library: Library) -> list[tuple[int, int, int, int]]:
    """(template, row, first shingle, last shingle + 1) of the windows in which a band of a template agrees."""
    if not len(shingles):
        return []
    values, most = short(shingles), np.uint32(0xFFFFFFFF)
    cut = [blocks(offsets, size) for size, _ in library.classes]
    found: set[tuple[int, int, int]] = set()
    for band, row_factors in enumerate(library.factors):
        products = [values * f for f in row_factors]
        for c, (starts, _, left) in enumerate(cut):
            least = []
            for p in products:
                m = np.minimum.reduceat(p, starts)
                ahead = np.append(m, [most, most])
                least.append(np.minimum(m, np.minimum(np.where(left > 1, ahead[1:-1], most), np.where(left > 2, ahead[2:], most))))
            keys = band_key(least)
            for t, of_template in zip(library.classes[c][1], library.keys[c], strict=True):
                found.update((c, t, i) for i in np.flatnonzero(keys == of_template[band][0]).tolist())
    out = []
    for c, t, i in sorted(found):
        starts, row, _ = cut[c]
        out.append((t, int(row[i]), int(starts[i]), int(min(starts[i] + 3 * library.classes[c][0], offsets[row[i] + 1]))))
    return out


def verified(part: np.ndarray, wanted: np.ndarray) -> tuple[float, int, int] | None:
    """(containment, first shingle, last one) of a template in a window's shingles, at its densest span; None below CONTAINMENT."""
    here = np.isin(part, wanted)
    if len(np.unique(part[here])) < CONTAINMENT * len(wanted):
        return None
    places = np.flatnonzero(here)
    counts = np.searchsorted(places, places + len(wanted)) - np.arange(len(places))
    p = int(places[int(np.argmax(counts))])
    inside = places[(places >= p) & (places < p + len(wanted))]
    share = len(np.unique(part[inside])) / len(wanted)
    return (share, p, int(inside[-1])) if share >= CONTAINMENT else None


def matches(texts: pa.Array, library: Library) -> list[tuple[int, int, int, int, float]]:
    """(row, first word, last word + 1, template, containment) of verified templates, the best of overlapping ones."""
    words_at, hashes = word_hashes(texts, ALNUM)
    offsets, shingles = windows(hashes, words_at, SHINGLE)
    n_words = np.diff(words_at)
    found: dict[tuple[int, int, int], tuple[float, int]] = {}
    for t, row, begin, end in retrieved(shingles, offsets, library):
        if hit := verified(shingles[begin:end], library.shingles[t]):
            share, first, last = hit
            at = begin - int(offsets[row])
            known = found.get((row, at + first, t))
            if known is None or share > known[0]:
                found[(row, at + first, t)] = (share, min(at + last + SHINGLE, int(n_words[row])))
    kept: dict[int, list[tuple[int, int, int, int, float]]] = {}
    best_first = lambda f: (-f[1][0], -int(library.words[f[0][2]]), library.names[f[0][2]], f[0][1])
    for (row, start, t), (share, stop) in sorted(found.items(), key=best_first):
        mine = kept.setdefault(row, [])
        if all(stop <= a or b <= start for _, a, b, _, _ in mine):
            mine.append((row, start, stop, t, share))
    return sorted(m for mine in kept.values() for m in mine)


FIELDS = "matches array<struct<license:string,start:bigint,stop:bigint,containment:double>>"


def license_scan(documents: DataFrame, keep: list[str] | None = None, text_column: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """Each row: row (struct of `keep`, all columns by default) and found.matches (word ranges)."""
    templates = TEMPLATES if templates is None else templates

    def make():
        library = Library(templates)

        def f(texts):
            rows: list[list] = [[] for _ in range(len(texts))]
            for row, a, b, t, share in matches(texts, library):
                rows[row].append({"license": library.names[t], "start": a, "stop": b, "containment": share})
            return [rows]

        return f

    return annotate(documents, text_column, list(keep or documents.columns), make, FIELDS)


__all__ = ["TEMPLATES", "Library", "license_scan", "matches", "retrieval_probability", "retrieved", "verified"]
