"""Operator 13: fill-in-the-middle transformation, a pyarrow.compute pipeline.

A text is cut into units (a word with the blanks before it; blanks at the end are a
unit of their own). Per batch: every unit gets an end mark (a byte that UTF-8 never
holds), texts are split at the marks into list arrays, the lists are flattened with
their parents' indices, a unit's ordinal is its place less its parent's first place,
and units are filtered by role (prefix, middle, suffix: two cuts drawn from a hash of
the id), rebuilt to lists and joined to one piece a role with binary_join. Pieces are
joined with sentinels in the order prefix, suffix, middle (psm) or suffix, prefix,
middle (spm). Hashes and forms are DataFrame functions; every row stands alone, so
nothing is shuffled and a batch's memory is bounded by ``BLOCK`` bytes or one text.

Whole texts are used; ``restored`` gives the exact text back from output and form.

Cases: a null text counts as empty, an empty text is plain with no units; a text that
holds a sentinel is plain; a null id is hashed as the empty string and kept; repeated
rows come out alike; a very long text is a block of its own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import blocks, buffers
from .shared import texts

BLOCK = 1 << 22
UNIT = rb"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
END_MARK = b"\xff"
SENTINELS = ("<P>", "<S>", "<M>")
COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _checked(sentinels: Sequence[str]) -> tuple[str, str, str]:
    prefix, suffix, middle = sentinels
    if len({prefix, suffix, middle}) < 3 or any(not s or any(s[0] in other[1:] for other in sentinels) for s in sentinels):
        raise ValueError("sentinels differ, and the first character of each is found at no later place of any")
    return prefix, suffix, middle


def units(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All units of the texts (binary) and the index of the text of each."""
    lists = pc.split_pattern(pc.replace_substring_regex(text, pattern=UNIT, replacement=b"\\1" + END_MARK), pattern=END_MARK)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)        # what follows the last mark is empty
    return flat.filter(full), parent.filter(full).to_numpy(zero_copy_only=False)


def joined(flat: pa.Array, parent: np.ndarray, role: np.ndarray, n: int) -> pa.Array:
    """The units of one role, joined to one string for each of ``n`` texts."""
    count = np.bincount(parent[role], minlength=n)
    offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), flat.filter(pa.array(role))), pa.scalar(b"", flat.type))


def _block(ids: pa.Array, text: pa.Array, form: pa.Array, h1: np.ndarray, h2: np.ndarray,
           sentinels: tuple[str, str, str]) -> pa.RecordBatch:
    raw, rows = text.cast(pa.binary()), len(text)
    flat, parent = units(raw)
    n = np.bincount(parent, minlength=rows)
    ordinal = np.arange(len(parent)) - (np.cumsum(n) - n)[parent]
    one, two = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(one, two)[parent], np.maximum(one, two)[parent]
    prefix, middle, suffix = (joined(flat, parent, role, rows) for role in
                              (ordinal < low, (ordinal >= low) & (ordinal < high), ordinal >= high))
    p, s, m = (pa.scalar(x.encode(), pa.binary()) for x in sentinels)
    sep = pa.scalar(b"", pa.binary())
    plain, psm = pc.equal(form, "plain"), pc.equal(form, "psm")
    output = pc.if_else(plain, raw, pc.if_else(psm, pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, sep),
                                               pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, sep)))
    chars = lambda piece: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(piece.cast(pa.string())).cast(pa.int64()))
    return pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), form, chars(prefix), chars(middle), output.cast(pa.string())],
                                      [c.split()[0] for c in COLUMNS.split(", ")])


def fill_in_middle(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, *,
                   sentinels: Sequence[str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars and middle_chars (code points; null if plain), output.

    The four numbers of a document are the first groups of eight digits of sha256("seed:id"): two cuts,
    whether it is transformed, and in which order.
    """
    marks = _checked(sentinels)
    df = texts(docs, id_col, text_col)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    number = lambda k: F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long")     # noqa: E731
    df = df.withColumn("digest", digest).select("doc_id", "text", *[number(k).alias(f"h{k + 1}") for k in range(4)])
    plain = (F.col("text") == "") | (F.col("h3") % 100 >= fim_percent)
    for mark in marks:
        plain = plain | F.col("text").contains(mark)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    df = df.select("doc_id", "text", form.alias("form"), "h1", "h2")

    def transform(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = buffers(batch.column(1))
            for i, j in blocks(off, BLOCK):
                ids, text, form, h1, h2 = (batch.column(k).slice(i, j - i) for k in range(5))
                yield _block(ids, text, form, h1.to_numpy(), h2.to_numpy(), marks)

    return df.mapInArrow(transform, COLUMNS)


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that gave this output: each sentinel stands in it once, so the pieces lie between them."""
    p, s, m = _checked(sentinels)
    body, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    left = lambda first, second: F.substring_index(F.substring_index(body, second, 1), first, -1)       # noqa: E731
    psm = F.concat(left(p, s), middle, F.substring_index(body, s, -1))
    spm = F.concat(F.substring_index(body, p, -1), middle, left(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
