"""Licence scans by the Dice coefficient over word bigrams.

Texts and licence templates are normalised to lower-case words. The units of a text are all runs of
its lines that begin and end with a line sharing a bigram with some template; any other run scores
less than the run without its outer lines. For each template, so are all runs of words, wherever lines
break, that begin with a bigram of its head and end with one of its tail (a tenth of it, one bigram at
least): without these ends, "released under the" alone would be a notice of the Unlicense. A template is
compared with a unit only if their numbers of bigrams allow the wanted coefficient: with a and b
bigrams it is at most 2 min(a, b) / (a + b).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbatch import Chunk, bounded_batches, byte_class, chunks, pick, span_hash, spans

THRESHOLD = 0.8

#: Names by which notices call licences; a notice is one of VERBS with one of these.
NAMES = {
    "MIT": ("the MIT License", "MIT"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU GPL version 3", "the GPLv3", "GPL-3.0"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU GPL version 2", "the GPLv2", "GPL-2.0"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "the GNU LGPL version 3", "LGPL-3.0"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "the GNU AGPL version 3", "AGPL-3.0"),
    "MPL-2.0": ("the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "BSD-3-Clause"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License", "BSD-2-Clause"),
    "ISC": ("the ISC License", "ISC"),
    "Unlicense": ("the Unlicense",),
    "Zlib": ("the zlib License",),
    "BSL-1.0": ("the Boost Software License, Version 1.0", "BSL-1.0"),
    "WTFPL": ("the WTFPL",),
    "CC0-1.0": ("CC0 1.0", "the Creative Commons Zero License"),
    "CC-BY-4.0": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "the Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
}
VERBS = ("Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This software is licensed under", "This project is licensed under", "This file is licensed under", "SPDX-License-Identifier:")

#: Public licence texts, without titles and copyright lines.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}
TEXTS |= {
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "WTFPL": """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO.""",
}
#: Fixed value: what follows the Unlicense's grant in its whole text.
UNLICENSE_REST = """
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
#: The third clause, which stands before the disclaimer.
NO_ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
TEXTS["BSD-3-Clause"] = TEXTS["BSD-2-Clause"].replace("THIS SOFTWARE IS PROVIDED BY", NO_ENDORSEMENT + "THIS SOFTWARE IS PROVIDED BY", 1)

_WORD = byte_class((48, 57), (97, 122), (128, 255))


def templates() -> list[tuple[str, str]]:
    """(licence, text) of all notices and licence texts, those with one bigram at least."""
    notices = [(name, f"{verb} {called}") for name, calls in NAMES.items() for called in calls for verb in VERBS]
    return notices + list(TEXTS.items()) + [("Unlicense", TEXTS["Unlicense"] + UNLICENSE_REST)]


def normalise(data: bytes) -> bytes:
    """Lower case, and one spelling of the noun; the length stays."""
    return data.lower().replace(b"licence", b"license")


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    chunk = Chunk(0, 1, data, np.array([0, len(data)]))
    starts, ends, _ = spans(chunk, _WORD)
    return starts, ends, span_hash(data, starts, ends)


def _pairs(hashes: np.ndarray) -> np.ndarray:
    at = np.arange(max(len(hashes) - 1, 0))
    return span_hash(hashes, at, at + 2) if len(at) else np.zeros(0, np.uint64)


@dataclass
class Scanner:
    """Templates as bags of bigram hashes, ordered by size."""

    threshold: float
    names: list[str]
    bags: list[Counter]
    sizes: np.ndarray
    known: np.ndarray
    #: For each known bigram, the templates that have it in their head and those that have it in their tail.
    heads: list[list[int]]
    tails: list[list[int]]

    @classmethod
    def of(cls, items: list[tuple[str, str]], threshold: float = THRESHOLD) -> "Scanner":
        found = []
        for name, text in items:
            pairs = _pairs(_words(np.frombuffer(normalise(text.encode()), dtype=np.uint8))[2])
            if len(pairs):
                found.append((len(pairs), name, Counter(pairs.tolist()), pairs))
        found.sort(key=lambda x: (x[0], x[1]))
        known = np.unique(np.array([h for _, _, bag, _ in found for h in bag], dtype=np.uint64))
        heads, tails = [[] for _ in known], [[] for _ in known]
        for k, (size, _, _, pairs) in enumerate(found):
            ends = max(1, size // 10)
            for held, part in ((heads, pairs[:ends]), (tails, pairs[-ends:])):
                for at in np.searchsorted(known, np.unique(part)).tolist():
                    held[at].append(k)
        return cls(threshold, [n for _, n, _, _ in found], [b for _, _, b, _ in found], np.array([s for s, _, _, _ in found]), known, heads, tails)

    def scan(self, pairs: np.ndarray, known: np.ndarray, line: np.ndarray) -> dict[str, tuple[float, int, int]]:
        """(coefficient, first line, last line) of the best run of lines of each licence.

        Of one text: the hashes of its bigrams, whether a template has each, and the line of every
        word. Of equally good units the shortest counts, then the first.
        """
        hit = np.flatnonzero(known)
        lines = np.unique(np.concatenate((line[hit], line[hit + 1])))
        begin, end = np.searchsorted(line, lines, side="left").tolist(), np.searchsorted(line, lines, side="right").tolist()
        sums = np.concatenate(([0], np.cumsum(known))).tolist()
        most, least = self.sizes[-1] * (2 - self.threshold) / self.threshold, self.threshold / (2 - self.threshold)
        best: dict[str, tuple[float, int, int]] = {}
        for i, a in enumerate(begin):
            for j in range(i, len(lines)):
                size = end[j] - 1 - a
                if size > most:
                    break
                # No template shares more bigrams with the unit than the unit has known ones.
                if size > 0 and sums[end[j] - 1] - sums[a] >= least * size - 1e-9:
                    self._compare(Counter(pairs[a : end[j] - 1].tolist()), size, int(lines[i]), int(lines[j]), best)
        return best

    def windows(self, at: np.ndarray, known: np.ndarray, stops: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, first bigram, end) of the runs of words of many texts that may reach the threshold.

        ``at`` has the place of every bigram among the known ones, ``stops`` the end of its text.
        """
        hit = np.flatnonzero(known)
        sums = np.concatenate(([0], np.cumsum(known)))
        is_head, is_tail = (np.array([bool(x) for x in held]) for held in (self.heads, self.tails))
        ends: dict[int, list[int]] = {}
        for e in hit[is_tail[at[hit]]].tolist():
            for k in self.tails[at[e]]:
                ends.setdefault(k, []).append(e + 1)
        held = {k: np.array(x) for k, x in ends.items()}
        share = self.threshold / (2 - self.threshold)
        for s in hit[is_head[at[hit]]].tolist():
            for k in self.heads[at[s]]:
                if k in held:
                    size = int(self.sizes[k])
                    low, high = s + size * share - 1e-9, min(s + size / share + 1e-9, int(stops[s]))
                    # As many known bigrams as the shortest unit must have in common with the template.
                    if sums[int(high)] - sums[s] >= self.threshold * (size * share + size) / 2 - 1e-9:
                        for e in held[k][np.searchsorted(held[k], low) : np.searchsorted(held[k], high, side="right")].tolist():
                            if sums[e] - sums[s] >= self.threshold * (e - s + size) / 2 - 1e-9:
                                yield k, s, e

    def _compare(self, bag: Counter, size: int, lo: int, hi: int, best: dict[str, tuple[float, int, int]]) -> None:
        low = np.searchsorted(self.sizes, size * self.threshold / (2 - self.threshold) - 1e-9, side="left")
        high = np.searchsorted(self.sizes, size * (2 - self.threshold) / self.threshold + 1e-9, side="right")
        for k in range(int(low), int(high)):
            self.compare_with(k, bag, size, lo, hi, best)

    def compare_with(self, k: int, bag: Counter, size: int, lo: int, hi: int, best: dict[str, tuple[float, int, int]]) -> None:
        common = sum(min(n, bag.get(h, 0)) for h, n in self.bags[k].items())
        dice = 2 * common / (size + int(self.sizes[k]))
        old = best.get(self.names[k])
        if dice >= self.threshold and (old is None or (-dice, hi - lo, lo) < (-old[0], old[2] - old[1], old[1])):
            best[self.names[k]] = (dice, lo, hi)


def _promising(known: np.ndarray, row: np.ndarray, line: np.ndarray, n_rows: int, least: float) -> np.ndarray:
    """Rows with a line of which so large a share of bigrams is known; without one, no run of lines has that share.

    A bigram belongs to the line of its second word; the first of a line may be left out of a unit.
    """
    if not len(known):
        return np.zeros(0, dtype=np.int64)
    of = line[1:]
    have, all_ = np.bincount(of, weights=known), np.bincount(of)
    good = np.flatnonzero((have > 0) & (have >= least * np.maximum(all_ - 1, 1) - 1e-9))
    rows = np.zeros(n_rows, dtype=bool)
    rows[row[np.searchsorted(line, good)]] = True
    return np.flatnonzero(rows)


def licence_matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", items: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Find licences in every row.

    Returns one row for each input row: id, and matches, an array of (licence, score, first_line,
    last_line), one for each licence with a unit at the threshold or above, best first; lines count
    from 0 and blank ones count. Null, empty and wordless texts match nothing; ties between units
    fall to the shortest and then the first. An empty table gives no rows. Other columns are
    ignored. ``items`` are (licence, text) templates; they are part of the program, not of the data.
    """
    bounded_batches(docs.sparkSession)
    rows = pick(docs, id=doc_id, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(Scanner.of(items if items is not None else templates(), threshold))
    found = pa.list_(pa.struct([("licence", pa.string()), ("score", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            out: list[list[dict]] = []
            for chunk in chunks(batch):
                out += _scan_chunk(scanner, chunk)
            yield pa.record_batch([batch.column("id"), pa.array(out, found)], names=["id", "matches"])

    return rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, matches array<struct<licence:string,score:double,first_line:int,last_line:int>>")


def _scan_chunk(scanner: Scanner, chunk: Chunk) -> list[list[dict]]:
    n_rows = chunk.hi - chunk.lo
    out: list[list[dict]] = [[] for _ in range(n_rows)]
    if not len(scanner.known):
        return out
    data = np.frombuffer(normalise(chunk.data.tobytes()), dtype=np.uint8)
    chunk = Chunk(chunk.lo, chunk.hi, data, chunk.offsets)
    starts, ends, row = spans(chunk, _WORD)
    hashes = span_hash(data, starts, ends)
    pairs = _pairs(hashes)
    at = np.minimum(np.searchsorted(scanner.known, pairs), len(scanner.known) - 1)
    known = (scanner.known[at] == pairs) & (row[1:] == row[:-1])
    # Lines are numbered through the chunk: breaks before the word, and rows before it.
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    line = breaks[starts] + row
    cuts = np.searchsorted(row, np.arange(n_rows + 1))
    best: dict[int, dict[str, tuple[float, int, int]]] = {}
    for k in _promising(known, row, line, n_rows, scanner.threshold / (2 - scanner.threshold)).tolist():
        a, b = int(cuts[k]), int(cuts[k + 1])
        first = int(breaks[chunk.offsets[k]]) + k
        best[k] = scanner.scan(pairs[a : b - 1], known[a : b - 1], line[a:b] - first)
    for template, s, e in scanner.windows(at, known, cuts[row + 1] - 1):
        k = int(row[s])
        first = int(breaks[chunk.offsets[k]]) + k
        scanner.compare_with(template, Counter(pairs[s:e].tolist()), e - s, int(line[s]) - first, int(line[e]) - first, best.setdefault(k, {}))
    for k, found in best.items():
        matches = sorted(((name, *x) for name, x in found.items()), key=lambda x: (-x[1], x[0]))
        out[k] = [{"licence": name, "score": score, "first_line": lo, "last_line": hi} for name, score, lo, hi in matches]
    return out
