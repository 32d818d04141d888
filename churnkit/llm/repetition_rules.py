"""Operator 5: quality rules on repetition, by a suffix array over each text's words.

For every document a suffix array of its words is built (prefix doubling, many
documents at once in NumPy) with the longest common prefix of neighbours. The
deepest LCP interval that holds a suffix gives the longest string that starts
there and occurs again, so the occurrences of all maximal repeated substrings
of at least ``min_words`` words are known; their spans are united. A document
is dropped when the united spans cover too large a share of its words' characters
or when its longest repeat is too long, besides the base rules (too few words,
too many words in repeated five-word windows).

Words are runs of bytes other than space, \\t, \\n, \\v, \\f and \\r, compared as
they stand (by 64-bit hashes within one document). Whole texts are used.

Cases: a null or empty text, or one without words, has no words, no lines and
fails the base rule; a null id is kept; repeated rows are judged alike; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytesops import BYTE_TABLE, WORD_BYTE, blocks, buffers, prefix_sums, span_hashes, word_spans
from .shared import texts

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_HEAD_BYTE = np.ones(256, bool)     # bytes that begin a character
_HEAD_BYTE[0x80:0xC0] = False


def suffix_array(words: np.ndarray, doc: np.ndarray):
    """(order, lcp): suffixes of all documents, each document's together, and the words in common with the
    suffix before (0 at the first of a document). ``doc`` ascends."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    new = np.ones(n, bool)
    w, d = words[order], doc[order]
    new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    slot = np.arange(n)
    end = np.searchsorted(doc, doc, side="right")
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, slot, 0))
    levels, step = [rank.copy()], 1
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if len(at) == 0:
            break
        p = order[at]
        q = p + step
        first = rank[p]
        second = np.where(q < end[p], rank[np.minimum(q, n - 1)], -1)
        sort = np.lexsort((second, first))
        order[at], first, second = p[sort], first[sort], second[sort]
        new[at[1:]] |= (first[1:] == first[:-1]) & (second[1:] != second[:-1])
        rank[order[at]] = np.maximum.accumulate(np.where(new[at], at, 0))
        levels.append(rank.copy())
        step *= 2
    lcp = np.zeros(n, np.int64)
    live = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1 if n else np.zeros(0, np.int64)
    a, b = order[live - 1], order[live]
    far = np.zeros(len(live), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + far, b + far
        ok = (x < end[a]) & (y < end[b])
        equal = ok & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        far += equal * (1 << k)
    lcp[live] = far
    return order, lcp


def longest_repeats(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word the length of the longest string that starts there and occurs again in its document."""
    order, lcp = suffix_array(words, doc)
    after = np.append(lcp[1:], 0)
    out = np.zeros(len(words), np.int64)
    out[order] = np.maximum(lcp, after)
    return out


def covered(reach: np.ndarray, at_least: int) -> np.ndarray:
    """Flag of each word that lies in a repeated string of at least ``at_least`` words."""
    n = len(reach)
    start = np.flatnonzero(reach >= at_least)
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + reach[start], -1)
    return np.cumsum(depth[:-1]) > 0


def _dup_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in raw:
        return 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


COLUMNS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "covered_chars long, longest_repeat long, spans array<struct<start:int,stop:int>>")


def repetition_statistics(docs: DataFrame, min_words: int = 8, window: int = 5, *, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """Counts of each document, with the united spans [start, stop) (in words) of its maximal repeats."""
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(1))
            for i, j in blocks(off):
                yield block(batch.column(0).slice(i, j - i), data[off[i]:off[j]], off[i:j + 1] - off[i])

    def block(ids, data, off) -> pa.RecordBatch:
        n = len(off) - 1
        start, end, doc = word_spans(data, off)
        words = span_hashes(prefix_sums(data, BYTE_TABLE), start, end)
        count = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[off])     # noqa: E731
        per_doc = np.bincount(doc, minlength=n)
        reach = longest_repeats(words, doc)
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, doc, reach)
        inside = covered(reach, min_words)
        heads = np.concatenate(([0], np.cumsum(_HEAD_BYTE[data] & WORD_BYTE[data])))
        chars = heads[end] - heads[start]
        raw = memoryview(data)
        change = np.ones(len(inside), bool)
        change[1:] = (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])
        cut = np.flatnonzero(change)
        stop = np.append(cut[1:], len(inside))
        cut, stop = cut[inside[cut]], stop[inside[cut]]
        base = np.cumsum(per_doc) - per_doc
        ends = np.searchsorted(doc[cut], np.arange(n), side="right")
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.StructArray.from_arrays(
            [pa.array((cut - base[doc[cut]]).astype(np.int32)), pa.array((stop - base[doc[cut]]).astype(np.int32))],
            fields=list(span_type.value_type)))
        return pa.RecordBatch.from_arrays([
            ids, pa.array(per_doc), pa.array(np.bincount(doc, weights=chars, minlength=n).astype(np.int64)),
            pa.array(count(_SYMBOL[data])), pa.array([_dup_lines(raw[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)], pa.int64()),
            pa.array(np.bincount(doc, weights=covered(reach, window), minlength=n).astype(np.int64)),
            pa.array(np.bincount(doc, weights=chars * inside, minlength=n).astype(np.int64)), pa.array(longest), spans],
            [c.split()[0] for c in COLUMNS.split(", ")])

    return texts(docs, id_col, text_col).mapInArrow(judge, COLUMNS)


def repetition_rules(docs: DataFrame, *, min_words: int = 8, window: int = 5, least_words: int = 10, max_window_percent: int = 20,
                     max_covered_percent: int = 15, short_covered_percent: int = 25, notice_chars: int = 200, max_longest: int = 40,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics with base_failed (too short, or too many words in repeated windows) and kept.

    kept also needs: repeats of ``min_words`` or more cover at most ``max_covered_percent`` of the words'
    characters, or in a short text, where one repeated notice is more than that, at most ``notice_chars``
    characters and ``short_covered_percent``; and no repeat is longer than ``max_longest`` words.
    """
    from pyspark.sql import functions as F
    stats = repetition_statistics(docs, min_words, window, id_col=id_col, text_col=text_col)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > max_window_percent * F.col("n_words"))
    over = lambda percent: 100 * F.col("covered_chars") > percent * F.col("word_chars")     # noqa: E731
    covers = over(max_covered_percent) & ((F.col("covered_chars") > notice_chars) | over(short_covered_percent))
    repeats = covers | (F.col("longest_repeat") > max_longest)
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & ~repeats)
