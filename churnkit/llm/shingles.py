"""Hashed word shingles of many documents at once.

Words are runs of bytes other than space, \\t, \\n, \\v, \\f and \\r, with A-Z
lower-cased. A shingle is five neighbouring words; a text with fewer words, but
not none, has one shingle of all of them.
"""

from __future__ import annotations

import numpy as np

from .bytesops import LOWER_TABLE, U64, blocks, mix, prefix_sums, span_hashes, word_spans


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """(hash, document) of every word of data[offsets[0]:offsets[-1]], in order; offsets start at 0."""
    start, end, doc = word_spans(data, offsets)
    return span_hashes(prefix_sums(data, LOWER_TABLE), start, end), doc


def shingle_block(data: np.ndarray, offsets: np.ndarray, size: int = 5):
    """(hash, document, count) of the distinct shingles of each document, in order of document and hash."""
    words, doc = word_hashes(data, offsets)
    n_docs = len(offsets) - 1
    per_doc = np.bincount(doc, minlength=n_docs)
    short = (per_doc > 0) & (per_doc < size)
    total = np.zeros(len(words), U64)
    last = np.cumsum(per_doc)
    place = np.arange(len(words))
    left = last[doc] - place                                   # words from here to the document's end
    use = np.minimum(left, size)
    for k in range(size):
        has = use > k
        at = place[has]
        total[at] = mix(total[at] * U64(0x2545F4914F6CDD1D) + words[at + k])
    first = place == (last - per_doc)[doc]
    keep = (left >= size) | (short[doc] & first)
    h, doc = total[keep], doc[keep]
    order = np.argsort(h)
    narrow = doc.astype(np.uint16) if n_docs <= 1 << 16 else doc
    order = order[np.argsort(narrow[order], kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.append(at, len(h)))


def shingle_blocks(data: np.ndarray, offsets: np.ndarray, size: int = 5, max_docs: int = 4096):
    """(first document, end document, shingles of the block) over all documents."""
    for i, j in blocks(offsets):
        for k in range(i, j, max_docs):
            e = min(k + max_docs, j)
            base = offsets[k]
            yield k, e, shingle_block(data[base:offsets[e]], offsets[k:e + 1] - base, size)


def jaccard(data_a, off_a, data_b, off_b, size: int = 5) -> np.ndarray:
    """Similarity of the shingle sets of text i of a and text i of b; 0 where either has none."""
    n = len(off_a) - 1
    keys, sizes = [], np.zeros((2, n), np.int64)
    for side, (data, off) in enumerate(((data_a, off_a), (data_b, off_b))):
        own = [(h, d + i) for i, _, (h, d, _) in shingle_blocks(data, off, size)]
        h = np.concatenate([x for x, _ in own]) if own else np.zeros(0, U64)
        d = np.concatenate([x for _, x in own]) if own else np.zeros(0, np.int64)
        sizes[side] = np.bincount(d, minlength=n)
        keys.append((h, d))
    h = np.concatenate([keys[0][0], keys[1][0]])
    d = np.concatenate([keys[0][1], keys[1][1]])
    order = np.lexsort((h, d))
    both = (h[order][1:] == h[order][:-1]) & (d[order][1:] == d[order][:-1])
    common = np.bincount(d[order][1:][both], minlength=n)
    union = sizes.sum(axis=0) - common
    return np.where((sizes > 0).all(axis=0), common / np.maximum(union, 1), 0.0)


