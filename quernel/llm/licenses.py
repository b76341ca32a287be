"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Words are runs of letters and digits, lower-cased; shingles are five words.  A template of s
shingles is looked for in windows of m >= 2 s shingles (m = 8, 32, 128 and so on, as far as the
longest template needs), each starting half a window after the last, so some window holds it
whole.  Its similarity to that window is at least s / m > 1 / 8, or 1 / 10 where only the needed
share is there.  With HASHES minima, each a band of one row, the window retrieves the template
with probability 1 - (1 - 1 / 8) ** 64 = 0.9998 (0.9988 at 1 / 10) for independent hashes;
``tests/llm/test_licenses.py`` measures it.  A retrieved template counts if CONTAINED of its
shingles or more are in the document around that window, compared as 64-bit hashes.

Null texts hold nothing; repeated rows are scanned alike; an empty table gives an empty
result.  Templates of fewer than five words are refused.  Spans are code points, end exclusive,
from the first to the last shingle found.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, table

WIDTH = 5
CONTAINED = 0.8
HASHES = 64
#: The smallest window; each further one is four times as long.
LEAST = 8

# The wording of public licences.  Short statements, operative paragraphs, and the whole
# of short licences; others can be given.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "BSD-2-Clause": [
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": ["To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."],
    "BSL-1.0": [
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    ],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
}


@functools.cache
def _folded():
    """The lower-case form of each letter or digit below 65,536, 0 for what separates words."""
    import numpy as np

    out = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalnum():
            out[c] = ord(s.lower()) if len(s.lower()) == 1 else c
    return out


class Words:
    """The words of some texts: where they are and their shingles' hashes."""

    def __init__(self, texts: list[str]):
        import numpy as np

        from .quality import _mix, _powers

        u8 = np.uint64
        codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
        fold = np.where(codes < 65536, _folded()[codes & 0xFFFF], codes)
        inside = np.concatenate([[False], fold > 0])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.first, self.after = edge[::2], edge[1::2]
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.begin = np.cumsum(size) - size
        self.doc = np.searchsorted(self.begin, self.first, "right") - 1
        power, inverse = _powers(len(codes))
        sums = np.zeros(len(codes) + 1, u8)
        np.cumsum(_mix(fold.astype(u8)) * power, out=sums[1:])
        w = _mix((sums[self.after] - sums[self.first]) * inverse[self.first] + (self.after - self.first).astype(u8))
        n = max(0, len(w) - WIDTH + 1)
        h = np.zeros(n, u8)
        for k in range(WIDTH):
            h = _mix(h + w[k : k + n])
        self.hashes = h
        self.whole = self.doc[:n] == self.doc[WIDTH - 1 :][:n]


@functools.cache
def _multipliers():
    """Two odd factors for each hash function."""
    import numpy as np

    both = np.random.default_rng(7).integers(1 << 20, 1 << 32, (HASHES, 2), dtype=np.uint64)
    return [(a, b) for a, b in both.astype(np.uint32) | np.uint32(1)]


def _scattered(low, factors):
    """A hash function of 32 bits, one to one."""
    import numpy as np

    x = low * factors[0]
    x ^= x >> np.uint32(15)
    x *= factors[1]
    return x


class Templates:
    """The templates' shingles, and by window size what their minima are."""

    def __init__(self, templates: dict[str, list[str]]):
        import numpy as np

        self.names, self.sets = [], []
        for name, texts in templates.items():
            for t in texts:
                own = np.unique(Words([t]).hashes)
                if not len(own):
                    raise ValueError(f"a template of {name} has fewer than {WIDTH} words")
                self.names.append(name)
                self.sets.append(own)
        self.bands: dict[int, list] = {}
        for k, own in enumerate(self.sets):
            m = LEAST
            while m < 2 * len(own):
                m *= 4
            minima = np.array([_scattered(own.astype(np.uint32), f).min() for f in _multipliers()])
            self.bands.setdefault(m, []).append((k, minima))
        self.windows = sorted(self.bands)
        self.marks = {m: np.zeros((HASHES, 1 << 16), bool) for m in self.bands}
        for m, rows in self.bands.items():
            for _, minima in rows:
                self.marks[m][np.arange(HASHES), minima & 0xFFFF] = True

    def candidates(self, hashes) -> set[tuple[int, int, int]]:
        """(template, first shingle, window size) of windows that share a minimum with a template."""
        import numpy as np

        out, least = set(), LEAST // 2
        n = -(-len(hashes) // least)
        low = np.zeros(n * least, np.uint32)
        low[: len(hashes)] = hashes.astype(np.uint32)
        low[len(hashes) :] = low[len(hashes) - 1] if len(hashes) else 0
        rows = low.reshape(n, least).T.copy()
        for k, factors in enumerate(_multipliers()):
            block, step = np.minimum.reduce(_scattered(rows, factors), axis=0), least
            for m in self.windows:
                while step < m // 2:  # blocks of half a window
                    if len(block) % 2:
                        block = np.append(block, block[-1])
                    block, step = np.minimum(block[::2], block[1::2]), 2 * step
                window = np.minimum(block[:-1], block[1:]) if len(block) > 1 else block
                for at in np.flatnonzero(self.marks[m][k][window & 0xFFFF]).tolist():
                    out |= {(t, at * (m // 2), m) for t, minima in self.bands[m] if minima[k] == window[at]}
        return out

    def found(self, texts: list[str], contained: float) -> list[list[tuple[int, int, str]]]:
        """(start, end, name) of every template that a text contains."""
        import numpy as np

        words = Words(texts)
        out: list[set] = [set() for _ in texts]
        for t, at, m in self.candidates(words.hashes) if len(words.hashes) else ():
            own = self.sets[t]
            lo, hi = max(0, at - m), min(len(words.hashes), at + 2 * m)
            h = words.hashes[lo:hi]
            place = np.minimum(np.searchsorted(own, h), len(own) - 1)
            hit = np.flatnonzero((own[place] == h) & words.whole[lo:hi])
            for d in np.unique(words.doc[lo + hit]).tolist():
                mine = hit[words.doc[lo + hit] == d]
                if len(np.unique(place[mine])) >= contained * len(own):
                    base = words.begin[d]
                    a, b = lo + int(mine[0]), lo + int(mine[-1]) + WIDTH - 1
                    out[d].add((int(words.first[a] - base), int(words.after[b] - base), self.names[t]))
        return [_merged(x) for x in out]


def _merged(spans: set) -> list[tuple[int, int, str]]:
    """Overlapping spans of one name as one."""
    out: list[list] = []
    for a, b, name in sorted(spans):
        for x in reversed(out):
            if x[2] == name and a < x[1]:
                x[1] = max(x[1], b)
                break
        else:
            out.append([a, b, name])
    return [tuple(x) for x in out]


@functools.cache
def default_templates() -> Templates:
    return Templates(TEMPLATES)


def _scan(batches: Iterator, templates: dict | None, contained: float) -> Iterator:
    import pyarrow as pa

    from .quality import AT_ONCE

    own = default_templates() if templates is None else Templates(templates)
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        found, at = [], 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= AT_ONCE):
                size += len(texts[upto])
                upto += 1
            found += own.found(texts[at:upto], contained)
            at = upto
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([len(x) for x in found], pa.int64()),
            pa.array([",".join(sorted({n for *_, n in x})) for x in found], pa.string()),
            pa.array([",".join(f"{n}:{a}:{b}" for a, b, n in x) for x in found], pa.string()),
        ], ["doc_id", "n_notices", "licenses", "spans"])


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, contained: float = CONTAINED) -> DataFrame:
    """One row per row: doc_id, n_notices, licenses (names), spans (name:start:end); no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(lambda it: freeing(_scan(it, templates, contained)), "doc_id long, n_notices long, licenses string, spans string")


def query(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))
