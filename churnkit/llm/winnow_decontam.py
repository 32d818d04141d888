"""Operator 6: benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``span`` (13) consecutive words of a benchmark item; an item of
fewer words, but not none, is one window. A document word is hit when it lies in
any occurrence of a window.

*Fingerprints.* Of every ``span`` consecutive words the k-gram (k = ``gram``)
with the least hash is kept, in documents and items alike, so every shared span
of 13 words shares a fingerprint at the same place in it. Documents' fingerprints
are looked up in the set of the items'; the items' side is broadcast only when it has at most
``BROADCAST_ROWS`` rows, else both sides are shuffled.
*Extension.* The windows that hold a fingerprint found are cut from the document, each
different text once with its starts, and meet the items' different windows in a join on the
text itself, so hash collisions cannot count. A repeated k-gram is never paired place by place:
work is linear in the words around fingerprints found, and rows joined are those of the result
(a document's different windows, by the items that hold them).
Items shorter than a window are looked up by their first words among all of the
documents' k-grams, in a pass that is made only when there are such items.

Words: A-Z lower-cased, then runs of characters other than U+0000-2F, U+003A-60
and U+007B-7F.

Cases: a null text has no words; n_hit is 0 then, and the document is not
contaminated; an item without words is never found; an item with a null id can
hit words but is not listed; rows with the same id are judged one by one; empty
tables give no rows, or no hits; a very long text costs in proportion to its words; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged

#: Rows of an items' table (fingerprints, or windows of at most 13 words) up to this number are broadcast.
BROADCAST_ROWS = 100_000
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLACE_BITS = 30        # a text has fewer than 2**30 words


def words_of(text: Column) -> Column:
    """Array of words; ASCII texts take the fast lower()."""
    whole = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def _grams(words: Column, gram: int, least: int) -> Column:
    """(hash << 30) | place of every k-gram, places from 1; null for fewer than ``least`` (>= gram) words.

    A condition here, and not a filter above, has the words computed once.
    """
    return F.when(F.size(words) >= least, F.transform(F.sequence(F.lit(1), F.size(words) - (gram - 1)), lambda i: F.shiftleft(
        F.shiftrightunsigned(F.xxhash64(F.slice(words, i, gram)), 64 - 33), _PLACE_BITS).bitwiseOR(i.cast("long"))))


def _winnowed(grams: Column, width: int) -> Column:
    """The least of every ``width`` neighbouring k-grams, each once; null for null."""
    places = F.when(grams.isNotNull(), F.sequence(F.lit(1), F.size(grams) - (width - 1)))
    return F.array_distinct(F.transform(places, lambda i: F.array_min(F.slice(grams, i, width))))


def _place(code: str) -> list[Column]:
    return [F.shiftright(code, _PLACE_BITS).alias("print"), F.col(code).bitwiseAND((1 << _PLACE_BITS) - 1).cast("int").alias("place")]


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast only what has been counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _candidates(texts: DataFrame, items: DataFrame, span: int, gram: int) -> DataFrame:
    """(did, seen, size, place): where a fingerprint of documents is one of the items', once each.

    size is the length of the windows to look at: ``span`` around the place, or that of short items that begin so.
    Items enter as sets of fingerprints, so no place is paired with a place.
    """
    width = span - gram + 1
    code = F.explode(_winnowed(F.col("grams"), width)).alias("code")
    prints = (items.withColumn("grams", _grams(F.col("words"), gram, span)).select(code).select(F.shiftright("code", _PLACE_BITS).alias("print")).distinct())
    own = texts.withColumn("grams", _grams(F.col("words"), gram, span)).select("did", "seen", code).select("did", "seen", *_place("code"))
    found = own.join(_sized(prints), "print", "left_semi").select("did", "seen", F.lit(span).alias("size"), "place")
    short = staged(items.where((F.size("words") > 0) & (F.size("words") < span)).select("words"), "short-items")
    for k in sorted({r[0] for r in short.select(F.least(F.size("words"), F.lit(gram))).distinct().collect()}):   # at most ``gram`` numbers
        lead = F.shiftright(F.element_at(_grams(F.col("words"), k, k), 1), _PLACE_BITS)
        starts = (short.where(F.least(F.size("words"), F.lit(gram)) == k).select(lead.alias("print"), F.size("words").alias("size")).distinct())
        every = texts.select("did", "seen", F.explode(_grams(F.col("words"), k, k)).alias("code")).select("did", "seen", *_place("code"))
        found = found.union(every.join(_sized(starts), "print").select("did", "seen", "size", "place"))
    return found.distinct()


_SIZE_BITS = 32


def _document_windows(base: DataFrame, found: DataFrame, span: int, gram: int) -> DataFrame:
    """(did, seen, size, window, starts): the different texts of the windows around the places ``found``, with their starts."""
    per_doc = found.groupBy("did", "seen").agg(F.collect_list(F.struct("size", "place")).alias("found"))
    texts = base.select("did", "seen", "text").join(per_doc.hint("merge"), ["did", "seen"])
    texts = texts.withColumn("words", words_of(F.col("text"))).withColumn("n", F.size("words"))

    def around(m: Column) -> Column:
        """(size << 32) | start of the windows that hold the k-gram at the place."""
        low = F.when(m["size"] == span, F.greatest(m["place"] - (span - gram), F.lit(1))).otherwise(m["place"])
        high = F.least(m["place"], F.col("n") - m["size"] + 1)
        starts = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.shiftleft(m["size"].cast("long"), _SIZE_BITS).bitwiseOR(i.cast("long")))

    texts = texts.select("did", "seen", "words", F.array_distinct(F.flatten(F.transform("found", around))).alias("codes"))
    size = lambda c: F.shiftright(c, _SIZE_BITS).cast("int")                        # noqa: E731
    start = lambda c: c.bitwiseAND((1 << _SIZE_BITS) - 1).cast("int")               # noqa: E731
    windows = F.transform("codes", lambda c: F.struct(size(c).alias("size"), start(c).alias("start"),
                                                      F.array_join(F.slice("words", start(c), size(c)), " ").alias("window")))
    rows = texts.select("did", "seen", F.explode(windows).alias("w")).select("did", "seen", "w.*")
    return rows.groupBy("did", "seen", "size", "window").agg(F.collect_set("start").alias("starts"))


def _item_windows(items: DataFrame, span: int) -> DataFrame:
    """(size, window, item_id): every different window of every item."""
    size = F.least(F.size("words"), F.lit(span))
    texts = F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.array_join(F.slice("words", i, size), " "))
    every = F.when(F.size("words") > 0, texts)
    return items.select("item_id", size.alias("size"), F.explode(every).alias("window")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 13, gram: int = 5, *, least_share: int = 20,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted ids as strings), hits (windows found, as
    structs of start and length), contaminated (n_hit > 0 and least_share * n_hit >= n_words), and
    ``extra`` (struct of the ``carry`` columns)."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       *([F.struct(*carry).alias("extra")] if carry else []))
    # the same words under the same id are found again by these two numbers; windows are compared as texts
    base = base.withColumns({"did": F.coalesce("doc_id", F.lit(-1)), "seen": F.xxhash64("text")})
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words_of(F.col(item_text)).alias("words"))
    texts = base.select("did", "seen", words_of(F.col("text")).alias("words"))
    found = staged(_candidates(texts, items, span, gram), "candidates")
    windows = staged(_document_windows(base, found, span, gram), "windows")
    of_items = staged(_item_windows(items, span), "item-windows")
    key = ["size", "window"]
    hit = (windows.join(_sized(of_items.select(*key).distinct()), key, "left_semi")
           .select("did", "seen", F.transform("starts", lambda s: F.struct(s.alias("start"), F.col("size").alias("length"))).alias("hits"))
           .groupBy("did", "seen").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits")))
    named = (windows.select("did", "seen", *key).join(_sized(of_items.where("item_id IS NOT NULL")), key)
             .groupBy("did", "seen").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    per_doc = hit.join(named, ["did", "seen"], "left")
    zero = F.struct(F.lit(1).alias("until"), F.lit(0).cast("long").alias("total"))

    def add(done: Column, h: Column) -> Column:
        end = h["start"] + h["length"]
        return F.struct(F.greatest(done["until"], end).alias("until"),
                        (done["total"] + F.greatest(end - F.greatest(done["until"], h["start"]), F.lit(0))).alias("total"))

    # hits can be as many as documents, so they are never broadcast; the texts, not their words, are shuffled
    return (base.join(per_doc.hint("merge"), ["did", "seen"], "left").withColumn("n_words", F.size(words_of(F.col("text"))).cast("long"))
            .withColumn("n_hit", F.coalesce(F.aggregate("hits", zero, add)["total"], F.lit(0).cast("long")))
            .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
            .withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<start:int,length:int>>")))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (least_share * F.col("n_hit") >= F.col("n_words")))
            .select("doc_id", "n_words", "n_hit", "items", "hits", "contaminated", *(["extra"] if carry else [])))
