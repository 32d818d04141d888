"""Operator 9: licence texts found by patience alignment.

Words (A-Z lower-cased runs of letters, digits and bytes of other characters)
that occur once in the template and once in the text are anchors; their longest
increasing subsequence fixes an alignment, and the gaps between its anchors are
aligned in the same way, after equal words at either end of a gap. Coverage is
the share of the template's words that are aligned.

Only words of the templates matter to an alignment, so the text is first cut to
those. A template is tried when enough of its words occur in the text at all:
coverage can never be above that share, so the test loses nothing. Alignments are
then sought in regions: the shortest stretches that hold enough of the template's
words, with a margin for the rest. Aligned words must make up ``least_density`` of
the words between the first and the last of them, after stray matches at the ends
are cut off, so words scattered over a long text are no licence, and a word far away
does not spoil one. Every occurrence of a template is found; the whole text is tried
when no region holds one.

Templates are a parameter (name -> text) and go to the tasks as such.

Cases: a null text is empty and has no licence; a template without words is
ignored; ties go to the longer template, then to the first name; a null id is
kept; repeated rows are judged alike; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import LOWER_TABLE, blocks, buffers, prefix_sums, span_hashes, word_spans
from .shared import texts

_LICENSE_BYTE = np.zeros(256, bool)
_LICENSE_BYTE[0x30:0x3A] = _LICENSE_BYTE[0x41:0x5B] = _LICENSE_BYTE[0x61:0x7B] = _LICENSE_BYTE[0x80:] = True

#: Notices and grants of public licences, as they are published.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "CC BY-NC 4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software."),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."),
}


def license_words(data: np.ndarray, offsets: np.ndarray):
    """(hash, document) of every word."""
    start, end, doc = word_spans(data, offsets, _LICENSE_BYTE)
    return span_hashes(prefix_sums(data, LOWER_TABLE), start, end), doc


def words_of(text: str) -> list[int]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return license_words(raw, np.array([0, len(raw)]))[0].tolist() if len(raw) else []


def _increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile:
            back[i] = last[pile - 1]
        if pile == len(tops):
            tops.append(v)
            last.append(i)
        else:
            tops[pile], last[pile] = v, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i in a, j in b), ascending in both."""
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
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
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        both = [(i, at_b[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in at_b]
        chain = [both[k] for k in _increasing([j for _, j in both])]
        if not chain:
            continue
        pairs += chain
        at_a, at = a0, b0
        for i, j in [*chain, (a1, b1)]:
            gaps.append((at_a, i, at, j))
            at_a, at = i + 1, j + 1
    return sorted(pairs)


def dense_part(pairs: list[tuple[int, int]], places: list[int], density: float) -> list[tuple[int, int]]:
    """The run of pairs with the greatest surplus of aligned words over ``density`` of the words it spans."""
    best, top, total, first = (0, 0), 0.0, 0.0, 0
    for k, (_, j) in enumerate(pairs):
        step = 1 - density * (places[j] - places[pairs[k - 1][1]]) if k > first else 1 - density
        if k > first and total + step < 1 - density:
            first, total, step = k, 0.0, 1 - density
        total += step
        if total > top or k == 0:
            top, best = total, (first, k + 1)
    return pairs[best[0]:best[1]]


def occurrences(template: list[int], words: list[int], places: list[int], least_coverage: float, least_density: float):
    """Alignments (pairs as in ``patience``) of the template's occurrences in the text, which do not overlap."""
    need, wanted = least_coverage * len(template), Counter(template)
    at = [k for k, w in enumerate(words) if w in wanted]
    own, where = [words[k] for k in at], [places[k] for k in at]

    def enough(found: list[tuple[int, int]]) -> bool:
        return bool(found) and len(found) >= max(need, least_density * (where[found[-1][1]] + 1 - where[found[0][1]]))

    def grown(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The alignment with what the region cut off of the template at either end."""
        (i, j), (x, y) = found[0], found[-1]
        a = max(floor, j - 2 * i)
        return ([(k, a + n) for k, n in patience(template[:i], own[a:j])] + found
                + [(x + 1 + k, y + 1 + n) for k, n in patience(template[x + 1:], own[y + 1:y + 1 + 2 * (len(template) - x - 1)])])

    def aligned(a: int, b: int) -> list[tuple[int, int]]:
        pairs = [(i, a + j) for i, j in patience(template, own[a:b])]
        found = next((p for p in (pairs, dense_part(pairs, where, least_density)) if enough(p)), [])
        if found:
            whole = grown(found)
            found = max((p for p in (whole, dense_part(whole, where, least_density), found) if enough(p)), key=len)
        return [(i, at[j]) for i, j in found]

    out, floor = [], 0                                  # no hit below floor is used again
    margin = len(template) - int(need) + 1
    held: Counter = Counter()
    low = overlap = tried = 0                           # hits low..high are held
    for high, w in enumerate(own):
        if high < floor:
            continue
        held[w] += 1
        overlap += held[w] <= wanted[w]
        while low < high and held[own[low]] > wanted[own[low]]:
            held[own[low]] -= 1
            low += 1
        while overlap - 1 >= need and low < high:
            held[own[low]] -= 1
            overlap -= 1
            low += 1
            while low < high and held[own[low]] > wanted[own[low]]:
                held[own[low]] -= 1
                low += 1
        if overlap < need or high < tried or where[high] - where[low] >= len(template) / least_density:
            continue
        a, b = max(floor, low - margin), min(len(own), high + 1 + margin)
        pairs = next((p for x, y in ((a, b), (low, b), (a, high + 1), (low, high + 1)) if (p := aligned(x, y))), [])
        if pairs:
            out.append(pairs)
            floor = next(k for k in range(low, len(at) + 1) if k == len(at) or at[k] > pairs[-1][1])
            held.clear()
            overlap, low, tried = 0, floor, 0
            for k in range(floor, high + 1):            # what was read past the occurrence
                held[own[k]] += 1
                overlap += held[own[k]] <= wanted[own[k]]
        else:
            tried = high + 1 + margin // 2              # neighbouring stretches differ by less than their margins
    return out or ([p] if (p := aligned(0, len(own))) else [])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least_coverage: float = 0.8, least_density: float = 0.5,
                  *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, found (array of license, coverage, matched, and start and stop, the
    words of the text from the first to the last aligned one; one entry for each occurrence), best coverage first."""
    lists = {name: words_of(text) for name, text in (TEMPLATES if templates is None else templates).items()}
    lists = {name: w for name, w in lists.items() if w}
    number = {w: k for k, w in enumerate(sorted({w for ws in lists.values() for w in ws}))}
    known = np.array(sorted(number), np.uint64)
    coded = {name: [number[w] for w in ws] for name, ws in lists.items()}
    found_type = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()),
                                     ("start", pa.int32()), ("stop", pa.int32())]))

    def judge(words: list[int], places: list[int]) -> list[dict]:
        held, out = Counter(words), []
        for name, template in coded.items():
            need = least_coverage * len(template)
            if sum(min(n, held[w]) for w, n in Counter(template).items()) < need:
                continue
            for pairs in occurrences(template, words, places, least_coverage, least_density):
                out.append({"license": name, "coverage": len(pairs) / len(template), "matched": len(pairs),
                            "start": places[pairs[0][1]], "stop": places[pairs[-1][1]] + 1})
        return sorted(out, key=lambda r: (-r["coverage"], -len(coded[r["license"]]), r["license"], r["start"]))

    shortest = min((least_coverage * len(t) for t in coded.values()), default=float("inf"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(1))
            for i, j in blocks(off):
                h, doc = license_words(data[off[i]:off[j]], off[i:j + 1] - off[i])
                per_doc = np.bincount(doc, minlength=j - i)
                base = np.cumsum(per_doc) - per_doc
                code = np.searchsorted(known, h)
                hit = np.flatnonzero(known[np.minimum(code, len(known) - 1)] == h) if len(known) else np.zeros(0, np.int64)
                owner, ends = doc[hit], np.searchsorted(doc[hit], np.arange(j - i + 1))
                words, places = code[hit], hit - base[owner]
                found = [judge(words[a:b].tolist(), places[a:b].tolist()) if b - a >= shortest else []
                         for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(per_doc), pa.array(found, found_type)],
                                                 ["doc_id", "n_words", "found"])

    return texts(docs, id_col, text_col).mapInArrow(
        scan, "doc_id long, n_words long, found array<struct<license:string,coverage:double,matched:int,start:int,stop:int>>")


def best_license(found: DataFrame) -> DataFrame:
    """doc_id, n_words, license (null for none), coverage (0 for none), n_found (licences, not occurrences)."""
    top = F.get("found", F.lit(0))
    return found.select("doc_id", "n_words", top["license"].alias("license"), F.coalesce(top["coverage"], F.lit(0.0)).alias("coverage"),
                        F.size(F.array_distinct(F.col("found")["license"])).cast("long").alias("n_found"))
