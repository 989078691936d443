"""License scans by patience alignment.

Words that are unique to both a stretch of text and a template are anchors; the longest increasing
subsequence of their places keeps order, equal neighbours extend each anchor, and the gaps between
anchors are aligned the same way. The share of the template's words that get a partner is its
coverage; a stretch is reported where coverage reaches ``COVERAGE``.

A text is read once. A stretch is looked for in the window of ``STRETCH`` template lengths that starts
at each word; its pairs give coverage and span. Of all windows the one with the best coverage counts,
of those the one with the shortest span, of those the first; it is reported, windows that start in
its span or whose own span overlaps it take no part any more, and so on. So every copy counts, an
intact copy is reported whole with its true ends whatever stands around it, and no stretch is longer
than a window. Bounds, which hold for every window, spare most alignments: the text must hold all but
``1 - COVERAGE`` of the template's words, and a window, counting repeats, that share of its words; windows
are aligned from the best bound downward, and only while a bound is better than what was found. The count of a
window follows from that of the one before it, and findings are kept in order, so that many of them cost no more each.

Defined cases: a null or empty text has no findings; texts of any length are read whole, in time that
grows in proportion to their length and the license text that they hold; rows with a null or repeated id are scanned like others; an empty table gives an empty table; extra columns
pass through unless they are named ``licenses``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE, STRETCH = 0.8, 1.5
WORD = re.compile(r"\w+")

#: Notices and license texts that are looked for.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "rights-reserved": "All rights reserved.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License."
    ),
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or any later version. This program is distributed in the hope that it will "
        "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. "
        "If not, see <https://www.gnu.org/licenses/>."
    ),
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails, ends, before = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[k], ends[k] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience_align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs (place in a, place in b) of equal words, rising in both."""
    pairs, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: j for j, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        shared = [(i, at[w]) for i, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in at]
        anchors = [shared[k] for k in longest_increasing([j for _, j in shared])]
        if not anchors:
            continue
        pairs += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            gaps.append((i + 1, k, j + 1, m))
    return sorted(pairs)


class Scanner:
    """The templates, ready to be looked for."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = [(name, words, frozenset(words)) for name, text in templates.items() if (words := words_of(text))]

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, end word) of every stretch, by license and place."""
        words, out = words_of(text), []
        held = set(words)
        for name, template, own in self.templates:
            if len(own - held) <= (1 - self.coverage) * len(template) + 1e-9:
                out += [(name, *x) for x in self._stretches(words, template, own)]
        return out

    def _stretches(self, words: list[str], template: list[str], own: frozenset[str]) -> list[tuple[float, int, int]]:
        need = int(np.ceil(self.coverage * len(template) - 1e-9))
        width = max(int(np.ceil(STRETCH * len(template))), len(template) + 2)
        hit = np.fromiter((w in own for w in words), bool, len(words))
        total = np.concatenate(([0], np.cumsum(hit)))
        ends = np.minimum(np.arange(len(words)) + width, len(words))
        wanted, queue = Counter(template), []
        starts = np.flatnonzero(hit & (total[ends] - total[:-1] >= need)).tolist()
        for start, bound in zip(starts, self._bounds(words, wanted, np.flatnonzero(hit).tolist(), starts, width)):
            if bound >= need:
                queue.append((-bound, bound, start, -1))  # a span is never shorter than its pairs
        heapify(queue)
        begins: list[int] = []  # of the findings, which never overlap, in order
        found: dict[int, tuple[float, int, int]] = {}

        def meets(first: int, end: int) -> bool:
            """Whether a finding lies in or across this stretch: the last that begins before its end tells."""
            k = bisect_left(begins, end)
            return k > 0 and found[begins[k - 1]][2] > first

        while queue:
            pairs, span, start, first = heappop(queue)
            if meets(start, start + 1):
                continue
            if first < 0:
                aligned = patience_align(template, words[start : start + width])
                if len(aligned) >= need:
                    heappush(queue, (-len(aligned), aligned[-1][1] + 1 - aligned[0][1], start, start + aligned[0][1]))
            elif not meets(first, first + span):
                insort(begins, first)
                found[first] = (round(-pairs / len(template), 6), first, first + span)
        return [found[k] for k in begins]

    @staticmethod
    def _bounds(words: list[str], wanted: Counter, hits: list[int], starts: list[int], width: int) -> Iterator[int]:
        """For each start how many of its window's words the template has room for; the window slides, each word comes and goes once."""
        held: Counter = Counter()
        bound = ahead = behind = 0
        for start in starts:
            while ahead < len(hits) and hits[ahead] < start + width:
                held[words[hits[ahead]]] += 1
                bound += held[words[hits[ahead]]] <= wanted[words[hits[ahead]]]
                ahead += 1
            while behind < ahead and hits[behind] < start:
                bound -= held[words[hits[behind]]] <= wanted[words[hits[behind]]]
                held[words[hits[behind]]] -= 1
                behind += 1
            yield bound


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` with licenses: array of (license, coverage, first word, end word)."""
    chosen = dict(templates or TEMPLATES)
    kind = "array<struct<license string, coverage double, first long, end long>>"

    @F.arrow_udf(kind)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(chosen, coverage)
        for texts in batches:
            rows, ends = [], [0]
            for t in texts:
                rows += scanner.scan(t.as_py() or "")
                ends.append(len(rows))
            columns = zip(*rows) if rows else [()] * 4
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64()]
            flat = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["license", "coverage", "first", "end"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    return docs.withColumn("licenses", scan(F.coalesce(F.col(text_col), F.lit(""))))
