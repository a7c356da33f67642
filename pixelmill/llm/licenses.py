"""License scans by patience alignment.

A text and a template are cut into words.  Words that occur once in both are anchors; the longest increasing
subsequence of the anchors' places is kept; the gaps between kept anchors are aligned in the same way.  A gap without
common unique words falls back to anchors of word pairs and then to its equal head and tail.  Coverage is the share of
the template's words that are aligned.

A text that holds a template several times has no unique words of it, so a scan first finds windows: stretches of the
text around rare template words (those that the fewest templates hold), each as long as the template with room for
insertions.  Windows that the multiset of their words shows to be below the threshold are not aligned; that bound is
exact.  Each window of each template is aligned apart.  Copies are taken from left to right and do not overlap; words at
the edge of an alignment that a hole of more than HOLE words separates from enough others belong to another copy.  All
copies are returned, the best one per template decides on its place among the licenses.

Nothing is shuffled.  Defined cases: a null or empty text has no license; repeated rows are scanned each for itself;
templates without words are ignored; ties of coverage go to the longer, then to the first template by name; empty tables
give empty results; extra columns do not matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, extended, require_free, shelved

#: Public license notices and grants, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
}
#: Coverage from which a license counts as found, and a window's length in lengths of its template.
THRESHOLD, ROOM = 0.8, 1.5
#: Words (or a quarter of the template, if that is more) between aligned words, beyond which an edge is cut off.
HOLE = 8
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs that are sorted by their first number, a longest run whose second numbers increase (patience piles)."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        if pile == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[pile], at[pile] = j, k
        before[k] = at[pile - 1] if pile else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _anchors(a: list, b: list, a0: int, b0: int) -> list[tuple[int, int]]:
    once = {x for x, n in Counter(a).items() if n == 1}
    count = Counter(b)
    place = {x: i for i, x in enumerate(a) if x in once and count[x] == 1}
    return longest_increasing(sorted((place[x] + a0, j + b0) for j, x in enumerate(b) if x in place))


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (in a, in b) of aligned words, increasing in both."""
    out, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        i, k, j, m = stack.pop()
        while i < k and j < m and a[i] == b[j]:  # equal heads and tails need no anchor
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        kept = _anchors(a[i:k], b[j:m], i, j)
        if not kept:  # pairs of words can be unique where words are not
            kept = _anchors(list(zip(a[i:k], a[i + 1:k])), list(zip(b[j:m], b[j + 1:m])), i, j)
        if not kept:
            continue
        out += kept
        edges = [(i - 1, j - 1), *kept, (k, m)]
        stack += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(edges, edges[1:])]
    return sorted(out)


def compact(pairs: list[tuple[int, int]], least: int, hole: int) -> list[tuple[int, int]]:
    """Pairs without those at either edge that stand beyond a hole in the text, as long as `least` are left."""
    first, end = 0, len(pairs)
    for k in range(1, len(pairs)):
        if pairs[k][0] - pairs[k - 1][0] - 1 > hole:
            if k - first >= least:  # the first copy is whole before the hole
                end = k
                break
            if len(pairs) - k >= least:
                first = k
    return pairs[first:end]


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.templates = sorted((name, words_of(text)) for name, text in templates.items() if words_of(text))
        spread = Counter(w for _, words in self.templates for w in set(words))
        self.rare: list[tuple[str, list[str], Counter, set[str], int]] = []
        for name, words in self.templates:
            counts = Counter(words)
            # a copy that aligns at the threshold lacks at most this many words, so it holds one of any more of them
            lack = int(len(words) * (1 - threshold) + 1e-9)
            chosen, held = set(), 0
            for w in sorted(counts, key=lambda w: (spread[w], -len(w), w)):
                if held > lack:
                    break
                chosen.add(w)
                held += counts[w]
            self.rare.append((name, words, counts, chosen, lack))
        self.any_rare = frozenset().union(*(r[3] for r in self.rare)) if self.rare else frozenset()

    def copies(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """name, coverage, first and end word of each copy at or above the threshold, by template and place."""
        words = words_of(text)
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.any_rare:
                places.setdefault(w, []).append(i)
        out = []
        for name, template, counts, chosen, lack in self.rare if places else ():
            hits = sorted(p for w in chosen for p in places.get(w, ()))
            room, least, hole, done = int(len(template) * ROOM) + 1, len(template) - lack, max(HOLE, len(template) // 4), 0
            for p in hits:
                if p < done:  # inside a copy that is already aligned
                    continue
                low, high = max(done, p - room), min(len(words), p + room + 1)
                have = Counter(words[low:high])
                if sum(min(n, have[w]) for w, n in counts.items()) < least:
                    continue
                # the copy that covers p: aligned from each side so that another copy in the window doesn't mix in
                best = None
                for a, b in ((low, high), (p, high), (low, p + 1)):
                    pairs = compact(align(words[a:b], template), least, hole)
                    if len(pairs) >= least and (best is None or len(pairs) > best[0]):
                        best = (len(pairs), a + pairs[0][0], a + pairs[-1][0] + 1)
                if best:
                    out.append((name, best[0] / len(template), best[1], best[2]))
                    done = best[2]
        return out

    def scan(self, text: str | None) -> tuple[list[tuple[str, float, int, int]], list[tuple[str, float, int, int]]]:
        """The best (first of equal ones) copy of each template, best template first; and all copies."""
        copies = self.copies(text)
        best: dict[str, tuple[str, float, int, int]] = {}
        for copy in copies:
            if copy[0] not in best or copy[1] > best[copy[0]][1]:
                best[copy[0]] = copy
        length = dict((n, len(w)) for n, w in self.templates)
        return sorted(best.values(), key=lambda x: (-x[1], -length[x[0]], x[0])), copies


def load_templates(table: DataFrame, name_col: str = "license", text_col: str = "text", max_bytes: int = 64 << 20) -> dict[str, str]:
    """Templates from a table, for `scan`: name -> text.  They go to every task, so their size is checked; a name that is
    null or there twice, or a size beyond the bound, raises ValueError.  Rows without words are left out."""
    rows = table.select(col(name_col).cast("string").alias("name"), col(text_col).cast("string").alias("text"))
    size, count, names = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*"), F.count_distinct("name")).first()
    if size > max_bytes:
        raise ValueError(f"templates of {size} bytes; {max_bytes} at most go to every task")
    if names < count:
        raise ValueError("each template needs a name of its own")
    return {r["name"]: r["text"] for r in rows.collect() if r["text"] and r["text"].split()}


def scan(docs: DataFrame, keep: list[str], templates: dict[str, str] | None = None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs, license and coverage of the best template (null, 0), first_word, end_word, all licenses
    found (names, best first), and all copies (license, coverage, first_word, end_word; by template name and place)."""
    own = ["license", "coverage", "first_word", "end_word", "licenses", "copies"]
    require_free(keep, own)
    plain, put, back = shelved(keep)
    names = [*plain, *own]
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
    chosen = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, threshold)
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.columns[-1]]
            best = [f[0] if f else (None, 0.0, None, None) for f, _ in found]
            columns = [pa.array([b[i] for b in best], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64()))]
            columns += [pa.array([[x[0] for x in f] for f, _ in found], pa.list_(pa.string())), pa.array([[dict(zip(names[-6:-2], c)) for c in copies] for _, copies in found], kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=names)

    schema = extended(docs.select(*put), "license string, coverage double, first_word long, end_word long, licenses array<string>, copies array<struct<license: string, coverage: double, first_word: long, end_word: long>>")
    return docs.select(*put, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema).select(*back, *own)
