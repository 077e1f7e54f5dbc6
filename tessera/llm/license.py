"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

The units of a text are its lines, its paragraphs (parted by empty lines), the whole, and windows: runs of words anywhere in
the text, across the ends of lines and paragraphs. Two texts with a and b distinct bigrams have a Dice coefficient of at most
2 min(a, b) / (a + b), so a unit is compared only with templates whose size lies within these bounds, and only if it shares a
bigram with one.

A best window begins and ends with a bigram of its template, and its first bigram does not come again in it. So each shared
bigram begins one search, over the shared bigrams that follow, which ends with the size bounds. Of windows that overlap the one
stays that agrees most: shared bigrams less all that either side has alone. A window within a reported line or paragraph, or
within a reported text of the same licence, is not reported again.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import bounded, slices

# Notices and texts by which works state their licence.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.'],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.'],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.'],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0 Universal."],
    "BSD-2-Clause": [
        "Released under the BSD 2-Clause License.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "ISC": ["Licensed under the ISC License.", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'],
}
LEAST = 0.8


def templates_in(folder: str) -> dict[str, list[str]]:
    """Templates from a folder of licence texts, one file for each, named by its licence: TEMPLATES | templates_in(path) adds full texts."""
    import pathlib

    return {p.stem: [p.read_text(encoding="utf-8")] for p in sorted(pathlib.Path(folder).glob("*.txt"))}


_WORD = re.compile(r"[^\W_]+")


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    """Distinct pairs of neighbouring words, lower-cased, without punctuation."""
    words = _WORD.findall(text.lower())
    return frozenset(zip(words, words[1:], strict=False))


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Scanner:
    """Templates by size, with their bigrams; match gives the best template of a unit."""

    def __init__(self, templates: dict[str, list[str]], least: float):
        self.least = least
        rows = sorted((len(g), name, g) for name, texts in templates.items() for t in texts for g in [bigrams(t)] if g)
        self.sizes = [n for n, _, _ in rows]
        self.rows = [(name, g) for _, name, g in rows]
        self.any = frozenset().union(*(g for _, g in self.rows))
        self.of: dict[tuple[str, str], list[int]] = {}
        for i, (_, g) in enumerate(self.rows):
            for pair in g:
                self.of.setdefault(pair, []).append(i)

    def match(self, text: str) -> tuple[float, str] | None:
        """(coefficient, name) of the best template at `least` or more; of equals, the first name."""
        g = bigrams(text)
        if g.isdisjoint(self.any):
            return None
        n, t = len(g), self.least
        # 2 min(a, b) / (a + b) >= t
        a, b = bisect.bisect_left(self.sizes, n * t / (2 - t) - 1e-9), bisect.bisect_right(self.sizes, n * (2 - t) / t + 1e-9)
        found = [(-d, name) for name, other in self.rows[a:b] if (d := dice(g, other)) >= t]
        return (-min(found)[0], min(found)[1]) if found else None

    def scan(self, text: str | None) -> list[tuple[str, float, str, int, int]]:
        """(name, coefficient, kind of unit, first line, last line) of every unit that is a template; lines count from 1."""
        if not text:
            return []
        lines = text.split("\n")
        units = [("line", i, i) for i in range(len(lines))]
        begin = None
        for i, line in enumerate([*lines, ""]):
            if line.strip() and begin is None:
                begin = i
            elif not line.strip() and begin is not None:
                if i - begin > 1:
                    units.append(("paragraph", begin, i - 1))
                begin = None
        if len(lines) > 1:
            units.append(("text", 0, len(lines) - 1))
        out = []
        for kind, a, b in units:
            if m := self.match(lines[a] if a == b else "\n".join(lines[a : b + 1])):
                out.append((m[1], m[0], kind, a + 1, b + 1))
        windows = self.windows(text)
        if windows:
            line_of = [i for i, line in enumerate(lines) for _ in _WORD.findall(line.lower())]
            units = out.copy()
            for name, d, a, b in windows:
                first, last = line_of[a] + 1, line_of[b] + 1
                if not any(u[3] <= first and last <= u[4] and (u[2] != "text" or u[0] == name) for u in units):
                    out.append((name, d, "window", first, last))
        return out

    def windows(self, text: str) -> list[tuple[str, float, int, int]]:
        """(name, coefficient, first word, last word) of the windows that are templates, in their order; none overlaps another."""
        words = _WORD.findall(text.lower())
        pairs = list(zip(words, words[1:], strict=False))
        hits: dict[int, list[int]] = {}
        for at, pair in enumerate(pairs):
            if pair in self.of:
                for i in self.of[pair]:
                    hits.setdefault(i, []).append(at)
        found = []
        for i, places in hits.items():
            name, g = self.rows[i]
            a, t = len(g), self.least
            enough = a * t / (2 - t) - 1e-9
            if len({pairs[p] for p in places}) < enough:
                continue
            most, coming = a * (2 - t) / t + 1e-9, _distinct_ahead(pairs, places, int(a * (2 - t) / t) + 1)
            for x, begin in enumerate(places):
                if coming[x] < enough:
                    continue
                shared, seen, at = set(), set(), begin
                best = None
                for end in places[x:]:
                    if end > begin and pairs[end] == pairs[begin]:
                        break
                    while at <= end and len(seen) <= most:
                        seen.add(pairs[at])
                        at += 1
                    if len(seen) > most:
                        break
                    shared.add(pairs[end])
                    s, n = len(shared), len(seen)
                    if 2 * s / (a + n) >= t and (best is None or 3 * s - n - a > best[0]):
                        best = (3 * s - n - a, 2 * s / (a + n), end + 1)
                    if s == a:
                        break
                if best:
                    found.append((-best[0], -best[1], name, begin, best[2]))
        out: list[tuple[str, float, int, int]] = []
        begins: list[int] = []
        for _, d, name, begin, end in sorted(found):
            k = bisect.bisect_left(begins, begin)
            if (k and out[k - 1][3] >= begin) or (k < len(out) and begins[k] <= end):
                continue
            begins.insert(k, begin)
            out.insert(k, (name, -d, begin, end))
        return out


def _distinct_ahead(pairs: list[tuple[str, str]], places: list[int], most: int) -> list[int]:
    """For each place, a bound on the shared bigrams of a window that begins there: the places before the first that comes again, each followed by one that is less than `most` new words away."""
    out, reach, again = [1] * len(places), len(places), {}
    for x in range(len(places) - 1, -1, -1):
        p = places[x]
        if x + 1 < len(places) and places[x + 1] - p > most and len(set(pairs[p : places[x + 1]])) > most:
            reach = x + 1
        out[x] = min(reach, again.get(pairs[p], len(places))) - x
        again[pairs[p]] = x
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, license, dice, unit, first_line, last_line): every unit of every text that is a template with a coefficient of at least `least`.

    Null and empty texts have no units; rows that repeat are reported each; a text of one line is a line only. Other columns
    of docs are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [(doc, *found) for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for found in scanner.scan(text)]
                types = (pa.int64(), pa.string(), pa.float64(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "license", "dice", "unit", "first_line", "last_line"])

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, license string, dice double, unit string, first_line int, last_line int")
