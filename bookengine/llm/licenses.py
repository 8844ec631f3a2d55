"""License scan: normalised text against licence templates by the Dice coefficient over word bigrams.

Each line of a text, and the text as a whole, is compared with every template whose size admits the
threshold: with a and b distinct bigrams the coefficient is at most 2 min(a, b) / (a + b). Segments that
share no hashed bigram with any template are passed over in vectorised steps; the rest are compared word by word.

A notice that wraps over lines or stands beside other words is found by windows of as many words as the
template has, which slide over the whole text across line breaks. A window counts only where no line or whole
text has given the notice already, and of windows that overlap only the best.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bookengine.llm.columns import byte_steps, doc_text, word_bounds
from bookengine.llm.shingles import BASE, mix, word_hashes

LEAST_DICE = 0.8

#: Licence notices by SPDX name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-style", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_MIT_NOTICE = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Whole licence texts, and notices of several sentences.
TEMPLATES += (
    ("Apache-2.0-notice", TEMPLATES[1][1] + """ You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD-2-Clause-text", "\n".join((_BSD_HEAD, _BSD_DISCLAIMER))),
    ("BSD-3-Clause-text", "\n".join((_BSD_HEAD, _BSD_NAMES, _BSD_DISCLAIMER))),
    ("GPL-3.0-notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("ISC-text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT-text", "\n".join((TEMPLATES[8][1][:-1] + """, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:""", _MIT_NOTICE, _MIT_DISCLAIMER))),
    ("MPL-2.0-notice", TEMPLATES[9][1] + " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("zlib-text", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
)

#: Words are runs of ASCII letters and digits or other letters beyond ASCII; all else separates.
_BREAK = np.ones(256, dtype=bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


def bigrams(text: str) -> set[tuple[bytes, bytes]]:
    found = words(text)
    return set(zip(found, found[1:], strict=False))


def _bigram_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word with the next, and where every word starts and ends."""
    starts, ends, _ = word_bounds(data, offsets, _BREAK)
    value = word_hashes(data, starts, ends)
    return (mix(value[:-1] * np.uint64(BASE) + value[1:]) if len(value) > 1 else np.zeros(0, np.uint64)), starts, ends


def _ranges(places: np.ndarray, size: int, least_hits: int) -> list[tuple[int, int]]:
    """First and last starts of windows of ``size`` words that hold the least number of bigrams at ``places``."""
    if len(places) < least_hits:
        return []
    low, high = places[least_hits - 1 :] - (size - 2), places[: len(places) - least_hits + 1]
    near = low <= high
    low, high = low[near], high[near]
    if len(low) == 0:
        return []
    apart = np.flatnonzero(low[1:] > high[:-1] + 1)
    return list(zip(low[[0, *(apart + 1)]].tolist(), high[[*apart, len(high) - 1]].tolist(), strict=True))


def best_apart(windows: list[tuple[float, int]], size: int) -> list[tuple[float, int]]:
    """Of (dice, start) those that overlap none of higher dice, or of the same dice and an earlier start."""
    taken: list[int] = []
    kept = []
    for dice, start in sorted(windows, key=lambda x: (-x[0], x[1])):
        k = bisect_left(taken, start)
        if (k == 0 or start - taken[k - 1] >= size) and (k == len(taken) or taken[k] - start >= size):
            insort(taken, start)
            kept.append((dice, start))
    return kept


def _scanner(templates: tuple[tuple[str, str], ...], least: float):
    sizes = [(name, len(words(text)), bigrams(text), text) for name, text in templates if bigrams(text)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.unique(_bigram_hashes(x, np.array([0, len(x)]))[0]) for x in (np.frombuffer(text.encode(), np.uint8) for *_, text in sizes)]
        known = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))
        for batch in batches:
            rows, ids = [], batch.column("doc_id")
            for start, _, data, offsets in byte_steps(batch):
                hashes, begin, stop = _bigram_hashes(data, offsets)
                place = np.searchsorted(known, hashes)
                near = np.flatnonzero((place < len(known)) & (known[np.minimum(place, len(known) - 1)] == hashes)) if len(known) else np.zeros(0, np.int64)
                hit = begin[near]
                spell = lambda a, b: [data[x:y].tobytes().lower() for x, y in zip(begin[a:b].tolist(), stop[a:b].tolist(), strict=True)]  # noqa: B023, E731

                def compare(a: int, b: int) -> Iterator[tuple[str, float]]:
                    """Templates that the words from ``a`` to ``b`` are: sizes first, then hashed bigrams, then the words themselves."""
                    n = len(h := np.unique(hashes[a : max(b - 1, a)]))  # noqa: B023
                    found = None
                    for (name, _, template, _), grams in zip(sizes, own, strict=True):
                        if n and 2 * min(n, len(template)) >= least * (n + len(template)) and 2 * np.isin(grams, h, assume_unique=True).sum() >= least * (n + len(template)) - 1e-9:
                            found = set(pairwise(spell(a, b))) if found is None else found
                            dice = 2.0 * len(found & template) / (len(found) + len(template))
                            if dice >= least:
                                yield name, dice

                # windows of a row that hold enough of a template's bigrams: with s shared the coefficient is at most 2 s / (s + template)
                windows: dict[int, list[tuple[str, int, float, int]]] = {}
                for (name, size, template, _), grams in zip(sizes, own, strict=True):
                    for low, high in _ranges(near[np.isin(hashes[near], grams)], size, max(1, math.ceil(least * len(template) / (2 - least) - 1e-9))):
                        # windows stay in one row
                        for row in range(np.searchsorted(offsets, begin[max(low, 0)], side="right") - 1, np.searchsorted(offsets, begin[min(high + size, len(begin)) - 1], side="right")):
                            first, last = np.searchsorted(begin, offsets[row : row + 2]).tolist()
                            if (a := max(low, first)) <= (b := min(high, last - size)):
                                pairs = list(pairwise(spell(a, b + size)))
                                for k in range(b - a + 1):
                                    g = set(pairs[k : k + size - 1])
                                    dice = 2.0 * len(g & template) / (len(g) + len(template))
                                    if dice >= least:
                                        windows.setdefault(row, []).append((name, size, dice, a + k))
                for row in np.unique(np.searchsorted(offsets, hit, side="right") - 1).tolist():
                    whole = list(compare(*np.searchsorted(begin, offsets[row : row + 2]).tolist()))
                    rows += [(start + row, 0, name, dice) for name, dice in whole]
                    newline = np.flatnonzero(data[offsets[row] : offsets[row + 1]] == 10) + offsets[row]
                    # where the words of each line begin, with a final end
                    edges = np.searchsorted(begin, np.concatenate([[offsets[row]], newline, [offsets[row + 1]]]))
                    inside = hit[(hit >= offsets[row]) & (hit < offsets[row + 1])]
                    given: dict[int, set[str]] = {}
                    for line in np.unique(np.searchsorted(newline, inside)).tolist():
                        for name, dice in compare(*edges[line : line + 2].tolist()):
                            rows.append((start + row, line + 1, name, dice))
                            given.setdefault(line, set()).add(name)
                    if whole or row not in windows:
                        continue
                    for name, size in {(name, size): None for name, size, *_ in windows[row]}:
                        for dice, k in best_apart([(d, k) for n, m, d, k in windows[row] if (n, m) == (name, size)], size):
                            first, last = np.searchsorted(newline, begin[[k, k + size - 1]]).tolist()
                            if not (first == last and first in given) and not any(name in given.get(x, ()) for x in range(first, last + 1)):
                                rows.append((start + row, first + 1, name, dice))
            where, line, name, dice = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(where, pa.int64())), pa.array(line, pa.int64()), pa.array(name, pa.string()), pa.array(dice, pa.float64())], ["doc_id", "line_no", "license", "dice"])

    return scan


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST_DICE) -> DataFrame:
    """doc_id, line_no (from 1; 0 for the whole text), license and dice for every match from ``least`` on.

    A window's line_no is the line of its first word; two notices on a line are two rows.

    Null and empty texts, and segments or templates of fewer than two words, match nothing. Rows that repeat an id give
    their matches each; a null id is allowed; ties are all returned. Empty table: empty result. Templates
    are a parameter of a few entries and travel with the function, not as a table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return doc_text(docs).mapInArrow(_scanner(templates, least), f"doc_id {kind}, line_no long, license string, dice double")
