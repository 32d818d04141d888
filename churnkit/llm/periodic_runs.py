"""Operator 11: periodic runs of words, found by minimizers at several scales.

A run is a stretch of consecutive words whose smallest period is q, that is at
least max(``min_length``, ``min_repeats`` * q) words long, and that no neighbouring
word extends keeping period q. All runs of a document are found:

* periods up to ``SHORT`` are too short for windows and are scanned directly: words
  equal to the word q places on, in stretches that are long enough;
* every further scale takes the periods lo..hi, hi about 4/3 lo. Fingerprints are of
  hi words, so inside a run of such a period q equal ones lie exactly q, 2q, ... apart
  (two closer ones would give the run a smaller period); windows hold 2 lo - hi + 1
  fingerprints, so a run of three periods holds a window and the same window one
  period on. Both have their minima at equal places, hence two neighbouring equal
  minimizers lie exactly q apart. Each such pair is extended to both sides by
  binary search over prefix hashes, and what comes out is compared word by word.

Work is linear in the words for each scale, and only documents of at least three
times a scale's periods reach it; there are O(log n) scales. A document is one row
and is never split; no group is formed and nothing is shuffled.

Words are runs of bytes other than space, \\t, \\n, \\v, \\f and \\r, compared as they
stand (by 64-bit hashes within one document). Whole texts are used.

Cases: a null or empty text, or one without words, has no words, no runs and an empty
collapsed text; a null id is kept; repeated rows are judged alike; a very long text is a block
of its own, with memory in proportion to its length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import BASE, BASE_INV, BYTE_TABLE, U64, blocks, buffers, mix, powers, prefix_sums, span_hashes, word_spans
from .shared import texts

#: Periods up to this are scanned directly.
SHORT = 12


def lag_runs(ids: np.ndarray, q: int, least: int) -> np.ndarray:
    """(start, end) of every stretch of period q of at least ``least`` words that cannot be extended."""
    if len(ids) < least:
        return np.zeros((0, 2), np.int64)
    breaks = np.concatenate(([-1], np.flatnonzero(ids[:-q] != ids[q:]), [len(ids) - q]))
    long = np.flatnonzero(np.diff(breaks) - 1 + q >= least)
    return np.stack([breaks[long] + 1, breaks[long + 1] + q], axis=1)


def _sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over values[i:i + width] for every i where all of them exist."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = op(out[:len(out) - step], out[step:])
        done += step
    return out


def minimizers(prints: np.ndarray, width: int, valid: np.ndarray) -> np.ndarray:
    """Places whose fingerprint is least in some valid window; ``valid`` flags the windows by their first place."""
    least = np.where(valid, _sliding(prints, width, np.minimum), U64(0))
    pad = np.zeros(width - 1, U64)
    above = _sliding(np.concatenate((pad, least, pad)), width, np.maximum)      # greatest minimum of the windows over a place
    return np.flatnonzero((above == prints) & (above > 0))


def _common(sums: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """Words in common of the texts that begin (``back``: end) at a and b, at most ``most``; by binary search."""
    inv = powers(BASE_INV, len(sums))
    low, high = np.zeros(len(a), np.int64), most.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) >> 1
        x, y = (a - mid, b - mid) if back else (a, b)
        same = (sums[x + mid] - sums[x]) * inv[x] == (sums[y + mid] - sums[y]) * inv[y]
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)


def find_runs(ids: np.ndarray, sizes: np.ndarray, min_length: int = 24, min_repeats: int = 3):
    """(start, end, period) of all runs of documents of ``sizes`` words, in ascending order of size, that lie one
    after the other in ``ids``; words of different documents differ. ``min_repeats`` is at least 3."""
    ends = np.cumsum(sizes)
    found = []
    for q in range(1, SHORT + 1):
        spans = lag_runs(ids, q, max(min_length, min_repeats * q))
        found.append(np.column_stack([spans, np.full(len(spans), q)]))
    sums = np.zeros(len(ids) + 1, U64)
    np.cumsum(ids * powers(BASE, len(ids)), out=sums[1:])
    inv = powers(BASE_INV, len(sums))
    lo, longest = SHORT + 1, int(sizes[-1]) if len(sizes) else 0
    while min_repeats * lo <= longest:
        hi = lo * 4 // 3
        width = 2 * lo - hi + 1
        first = int(np.searchsorted(sizes, min_repeats * lo))       # only documents that can hold such a run
        base = int(ends[first] - sizes[first])
        count = len(ids) - base - hi + 1                            # fingerprints from ``base`` on
        if count >= width:
            at = slice(base, base + count)
            prints = mix((sums[base + hi:] - sums[at]) * inv[at]) | U64(1)
            doc_end = np.repeat(ends[first:], sizes[first:])[:count - width + 1]
            valid = np.arange(base, base + len(doc_end)) + (width - 1 + hi) <= doc_end
            place = minimizers(prints, width, valid)
            order = np.argsort(prints[place], kind="stable")
            a, b = place[order[:-1]], place[order[1:]]
            seed = (prints[a] == prints[b]) & (b - a >= lo) & (b - a <= hi)
            a, b = a[seed] + base, b[seed] + base
            doc = np.searchsorted(ends, a, side="right")
            start = a - _common(sums, a, b, a - (ends[doc] - sizes[doc]), True)
            end = b + _common(sums, a, b, ends[doc] - b, False)
            q = b - a
            keep = end - start >= np.maximum(min_length, min_repeats * q)
            hits = np.unique(np.stack([start[keep], end[keep], q[keep]], axis=1), axis=0)
            found.append(_exact(ids, hits, ends, sizes, min_length, min_repeats))
        lo = hi + 1
    every = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    # a stretch found with several periods is a run of the least one, which divides the others
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    new = np.ones(len(every), bool)
    new[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[new]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _exact(ids, hits, ends, sizes, min_length, min_repeats) -> np.ndarray:
    """``hits`` compared word by word; where hashes misled, the document is scanned at that lag."""
    good, again = [], set()
    for start, end, q in hits.tolist():
        doc = int(np.searchsorted(ends, start, side="right"))
        left, right = int(ends[doc] - sizes[doc]), int(ends[doc])
        if (np.array_equal(ids[start:end - q], ids[start + q:end]) and (start == left or ids[start - 1] != ids[start + q - 1])
                and (end == right or ids[end] != ids[end - q])):
            good.append((start, end, q))
        else:
            again.add((left, right, q))
    for left, right, q in again:
        good += [(left + s, left + e, q) for s, e in lag_runs(ids[left:right], q, max(min_length, min_repeats * q)).tolist()]
    return np.array(sorted(set(good)), np.int64).reshape(-1, 3)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
COLUMNS = ("doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, "
           "strongest struct<start:bigint,length:bigint,period:bigint>, collapsed string")


def _strongest(runs: list[dict]) -> dict | None:
    """The run of the greatest length / period; ties go to the smaller start, then the smaller period."""
    best = None
    for run in runs:        # ascending (start, period)
        if best is None or run["length"] * best["period"] > best["length"] * run["period"]:
            best = run
    return best


def _block(ids: pa.Array, data: np.ndarray, off: np.ndarray, min_length: int, min_repeats: int) -> pa.RecordBatch:
    n = len(off) - 1
    start, end, doc = word_spans(data, off)
    words = mix(span_hashes(prefix_sums(data, BYTE_TABLE), start, end) + doc.astype(U64) * U64(BYTE_TABLE[0]))
    per_doc = np.bincount(doc, minlength=n).astype(np.int64)
    base = np.cumsum(per_doc) - per_doc
    by_size = np.argsort(per_doc, kind="stable")
    sizes = per_doc[by_size]
    shifted = np.cumsum(sizes) - sizes
    take = np.repeat(base[by_size] - shifted, sizes) + np.arange(len(words))
    found = find_runs(words[take], sizes, min_length, min_repeats)
    owner = by_size[np.searchsorted(np.cumsum(sizes), found[:, 0], side="right")]
    move = base[owner] - shifted[np.searchsorted(np.cumsum(sizes), found[:, 0], side="right")]
    first, last, period = found[:, 0] + move, found[:, 1] + move, found[:, 2]

    depth = np.zeros(len(words) + 1, np.int64)      # words after the first period of a run go
    np.add.at(depth, first + period, 1)
    np.add.at(depth, last, -1)
    kept = np.cumsum(depth[:-1]) == 0
    edge = np.zeros(len(data) + 1, np.int8)         # bytes of kept words
    edge[start[kept]] += 1
    np.add.at(edge, end[kept], -1)
    mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
    out = data.copy()
    kept_doc = doc[kept]
    space = end[kept][:-1][kept_doc[:-1] == kept_doc[1:]]       # one space after each kept word but a document's last
    mask[space] = True
    out[space] = 32
    sizes_out = np.concatenate(([0], np.cumsum(mask)))[off]
    collapsed = pa.StringArray.from_buffers(n, pa.py_buffer(sizes_out.astype(np.int32)), pa.py_buffer(out[mask]))

    runs: list[list[dict]] = [[] for _ in range(n)]
    for i, s, e, q in sorted(zip(owner.tolist(), (first - base[owner]).tolist(), (last - base[owner]).tolist(), period.tolist(), strict=True),
                             key=lambda r: (r[0], r[1], r[3])):
        runs[i].append({"start": s, "length": e - s, "period": q})
    return pa.RecordBatch.from_arrays([ids, pa.array(per_doc), pa.array(runs, pa.list_(_RUN)),
                                       pa.array([_strongest(r) for r in runs], _RUN), collapsed],
                                      ["doc_id", "n_words", "runs", "strongest", "collapsed"])


def periodic_runs(docs: DataFrame, min_length: int = 24, min_repeats: int = 3, *, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words; by start, then period), the run of the greatest
    length / period (null without runs) and the collapsed text: the words that no run holds after its first
    period, joined by one space."""
    if min_repeats < 3:
        raise ValueError("windows of a scale need runs of three periods")

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(1))
            for i, j in blocks(off):
                yield _block(batch.column(0).slice(i, j - i), data[off[i]:off[j]], off[i:j + 1] - off[i], min_length, min_repeats)

    return texts(docs, id_col, text_col).mapInArrow(find, COLUMNS)


def words_of(text: Column) -> Column:
    """The words of a text as an array, by DataFrame functions."""
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+", -1), lambda w: w != "")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text; in documents with h = crc32(id in decimal) divisible by 10 the words from a on repeat the
    p words at a, where g = floor(h / 10), a = g mod n and p = 1 + floor((n - a) / (3 + g mod 8)). Null ids plant nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    df = texts(docs, id_col, text_col).withColumn("g", F.floor(h / 10).cast("long")).withColumn("h", h)
    words = F.when(F.col("h") % 10 == 0, words_of(F.col("text")))
    df = df.withColumn("w", words).withColumn("n", F.size("w").cast("long"))
    a = F.col("g") % F.col("n")
    rest = F.col("n") - a
    p = F.lit(1) + F.floor(rest / (3 + F.col("g") % 8))
    unit = F.slice("w", (a + 1).cast("int"), p.cast("int"))
    many = F.flatten(F.array_repeat(unit, F.ceil(rest / p).cast("int")))
    whole = F.slice(F.concat(F.slice("w", F.lit(1), a.cast("int")), many), F.lit(1), F.col("n").cast("int"))
    return df.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))
