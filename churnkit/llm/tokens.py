"""Token ids of whole texts by a tokenizers file, each distinct piece encoded once per task.

Both vocabularies used here cut a text into pieces (a run of letters, digits
or signs, for one vocabulary with the space before it) and encode every piece
by itself. Pieces of a block of documents are found and hashed by NumPy; only
pieces not met before go through the tokenizers library, all in one call with
a separator between them, and ids are put together by array look-up.

The pieces are cut here only for texts where the rule is plain: ASCII and
letters of U+00C0 to U+017F, single spaces and newlines, no apostrophe, no
control character, no added token, pieces of at most 64 bytes. Every other text
goes through the library whole, so ids are always the library's.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from .bytesops import BYTE_TABLE, LOWER_TABLE, blocks, prefix_sums, span_hashes

#: Pieces kept per task; a full table is emptied, so memory is bounded.
MAX_PIECES = 300_000
MAX_PIECE_BYTES = 64
_SEPARATOR = b"|"
_SPACE, _NEWLINE, _LETTER, _DIGIT, _SIGN, _ODD = range(6)


def _classes() -> np.ndarray:
    kind = np.full(256, _ODD, np.uint8)
    kind[0x21:0x7F] = _SIGN
    kind[0x27] = _ODD
    kind[0x20], kind[0x0A] = _SPACE, _NEWLINE
    kind[0x30:0x3A] = _DIGIT
    kind[0x41:0x5B] = kind[0x61:0x7B] = _LETTER
    kind[0x80:0xC0] = _LETTER   # second bytes
    kind[0xC3:0xC6] = _LETTER   # first bytes of U+00C0 to U+017F
    return kind


_KIND = _classes()


class TextEncoder:
    """``encode(data, offsets)``: ids of the documents data[offsets[i]:offsets[i + 1]], without special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path) as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.vocab_size = self.tok.get_vocab_size()
        # a byte-level vocabulary keeps white space in its pieces; the other drops it,
        # lower-cases, and takes digits one by one
        self.keeps_space = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        sep = self.whole(_SEPARATOR)
        if len(sep) != 1:
            raise ValueError("the vocabulary needs one token for the separator")
        self.sep = sep[0]
        self._empty()

    def _empty(self) -> None:
        self.at: dict[int, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.used = 0

    def whole(self, raw: bytes) -> np.ndarray:
        return np.asarray(self.tok.encode(raw.decode("utf-8"), add_special_tokens=False).ids, np.uint32)

    def _irregular(self, data, offsets, kind) -> np.ndarray:
        """Flag per document: cut by the library instead of here."""
        n = len(data)
        bad = kind == _ODD
        cross = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs among the letters
        bad[:-1] |= cross
        start = offsets[:-1]
        if self.keeps_space:
            white = kind <= _NEWLINE
            double = white[1:] & white[:-1]
            inner = np.ones(n - 1, bool)
            inner[start[(start > 0) & (start < n)] - 1] = False
            bad[1:] |= double & inner
            last = offsets[1:][offsets[1:] > start] - 1
            bad[last] |= white[last]
        flags = np.zeros(len(start), bool)
        flags[np.searchsorted(offsets, np.flatnonzero(bad), side="right") - 1] = True
        raw = data.tobytes()
        for token in self.added:
            i = raw.find(token)
            while i >= 0:
                flags[np.searchsorted(offsets, i, side="right") - 1] = True
                i = raw.find(token, i + 1)
        return flags

    def _pieces(self, data, offsets, kind):
        """Start, end and document of the pieces of regular documents."""
        n = len(data)
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        begins = offsets[:-1]
        change[begins[begins < n]] = True
        if not self.keeps_space:
            change |= kind == _DIGIT
        cut = np.flatnonzero(change)
        end = np.append(cut[1:], n)
        of = kind[cut]
        keep = (of != _SPACE) if self.keeps_space else (of > _NEWLINE)
        start, end, of = cut[keep], end[keep], of[keep]
        doc = np.searchsorted(offsets, start, side="right") - 1
        if self.keeps_space:
            spaced = (of > _NEWLINE) & (start > offsets[doc]) & (kind[start - 1] == _SPACE)
            start = start - spaced
        return start, end, doc

    def _learn(self, raw: bytes, hashes: list[int], start: list[int], end: list[int]) -> None:
        """Add new pieces: those that end in a letter in one call, cut at the separators it leaves; others singly."""
        pieces = [raw[a:b] for a, b in zip(start, end, strict=True)]
        letters = [_KIND[p[-1]] == _LETTER for p in pieces]
        joined = [i for i, ok in enumerate(letters) if ok]
        if joined:
            text = b"".join([pieces[i] + _SEPARATOR for i in joined]).decode("utf-8")
            ids = np.asarray(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            stop = np.flatnonzero(ids == self.sep)
            if len(stop) != len(joined):
                raise AssertionError("a piece of letters holds the separator's token")
            begin = np.append(0, stop[:-1] + 1)
            self._add([hashes[i] for i in joined], ids, begin, stop - begin)
        single = [(hashes[i], self.whole(pieces[i])) for i, ok in enumerate(letters) if not ok]
        if single:
            size = np.array([len(x) for _, x in single])
            self._add([h for h, _ in single], np.concatenate([x for _, x in single]), np.cumsum(size) - size, size)

    def _add(self, hashes: list[int], ids, begin, size) -> None:
        k, m = len(self.at), len(self.at) + len(hashes)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while m > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.pool[self.used:self.used + len(ids)] = ids
        self.first[k:m] = begin + self.used
        self.length[k:m] = size
        self.used += len(ids)
        self.at.update(zip(hashes, range(k, m), strict=True))

    def _block(self, data, offsets):
        kind = _KIND[data]
        whole = self._irregular(data, offsets, kind) if len(data) else np.zeros(len(offsets) - 1, bool)
        start, end, doc = self._pieces(data, offsets, kind)
        whole[doc[end - start > MAX_PIECE_BYTES]] = True
        if whole.any():
            keep = ~whole[doc]
            start, end, doc = start[keep], end[keep], doc[keep]
        sums = prefix_sums(data, BYTE_TABLE if self.keeps_space else LOWER_TABLE)
        distinct, sample, index = np.unique(span_hashes(sums, start, end), return_index=True, return_inverse=True)
        keys = distinct.tolist()
        if len(self.at) + len(keys) > MAX_PIECES:
            self._empty()
        known = self.at
        new = [i for i, h in enumerate(keys) if h not in known]
        if new:
            first = sample[new]
            self._learn(data.tobytes(), [keys[i] for i in new], start[first].tolist(), end[first].tolist())
            known = self.at
        place = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))[index]
        size = self.length[place]
        total = int(size.sum())
        before = np.cumsum(size) - size
        ids = self.pool[np.repeat(self.first[place] - before, size) + np.arange(total)]
        counts = np.bincount(doc, weights=size, minlength=len(offsets) - 1).astype(np.int64)
        if not whole.any():
            return ids, counts
        parts, at = [], 0
        for i in range(len(offsets) - 1):
            if whole[i]:
                own = self.whole(data[offsets[i]:offsets[i + 1]].tobytes())
                counts[i] = len(own)
                parts.append(own)
            else:
                parts.append(ids[at:at + counts[i]])
                at += counts[i]
        return np.concatenate(parts), counts

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None):
        """(ids as u32, offsets of documents in ids); ``end_id`` is appended to each document."""
        parts, counts = [np.zeros(0, np.uint32)], []
        for i, j in blocks(offsets, 1 << 20):
            ids, n = self._block(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(n), end_id)
                n = n + 1
            parts.append(ids)
            counts.append(n)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(n))).astype(np.int64)


@lru_cache(maxsize=4)
def encoder(path: str) -> TextEncoder:
    """One encoder per task process and file; reused Python workers keep its table."""
    return TextEncoder(path)
