"""Benchmark passages in documents, by winnowed fingerprints.

Texts are cut into words, ASCII letters lower-cased. A window is SPAN consecutive words of an item; an item of fewer words, but
not none, is one window. Each window of SPAN words keeps the least hash of its GRAM-word grams (of equal ones the last) as
its fingerprint; documents and items choose alike, so a passage that both have has its fingerprint in both, wherever it
lies. A document's fingerprints are the places so chosen, about two for each SPAN - GRAM + 2 words. Those that no item can have
are left out by a bitmap of fixed size, and the others are extended: the windows around them get 128-bit keys, another bitmap
takes most of what does not match, and a join by fingerprint and key with the items' distinct windows leaves the
windows that occur. Windows are met once each, however many items share them, so a frequent passage does not multiply rows.
Short windows, whose lengths are SPAN - 1 at most, are their own fingerprints, looked up at every place.

Items that hold a window are known by a hash of their set, and documents by a hash of the sets that they meet. So the list of
items is made once for each different list, not for each document.

Null and empty texts have no words. Very long texts are read whole, one at a time. Repeated documents get a row each, and rows
without a doc_id too. Rows of one item_id are one item; those without one are the item named by the empty text. Without
documents the result is empty, and without items nothing is hit. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import Shelf, lean_session, text_or_empty

SPAN, GRAM = 10, 5
#: Bits of each bitmap, which is all that is sent to the tasks: 8 MB each at most.
BITS = 1 << 26
NOT_WORD = np.array([b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])
OTHER_STEP = K.U(0x2545F4914F6CDD1D)
HIT = pa.struct([("m", pa.int32()), ("start", pa.int64()), ("fp", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])

Words = tuple[np.ndarray, np.ndarray]


def words_of(data: np.ndarray, off: np.ndarray) -> Words:
    """The 64-bit key and the text number of each word."""
    lower = K.LOWER[data]
    start, end, of = K.spans(lower, off, NOT_WORD)
    return K.keys(lower, start, end), of


def places(of: np.ndarray, size: int) -> np.ndarray:
    """Where size words lie in one text."""
    return np.flatnonzero(of[: max(0, len(of) - size + 1)] == of[size - 1 :]) if len(of) >= size else np.zeros(0, np.int64)


def gram(word: np.ndarray, at: np.ndarray, size: int, step: np.uint64 = K.STEP) -> np.ndarray:
    """Keys of the size words from each place on."""
    key = np.full(len(at), K.U(size))
    for k in range(size):
        key = key * step + word[at + k]
    return K.mix(key)


def winnowed(word: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of SPAN words, the place of each one's least gram, and the grams' hashes by place."""
    at = places(of, SPAN)
    here = places(of, GRAM)
    hashes = np.zeros(len(word), K.U)
    hashes[here] = gram(word, here, GRAM)
    chosen = at.copy()
    for j in range(1, SPAN - GRAM + 1):
        chosen = np.where(hashes[at + j] <= hashes[chosen], at + j, chosen)
    return at, chosen, hashes


def present(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    place = key & K.U(BITS - 1)
    return (bits[(place >> K.U(3)).astype(np.int64)] >> (place & K.U(7)).astype(np.uint8) & 1).astype(bool)


def document_hits(words: Words, lengths: list[int], fingerprints: np.ndarray, known: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, places, fingerprints, keys, other keys) of the windows that may be an item's."""
    word, of = words
    at, chosen, hashes = winnowed(word, of)
    own = np.unique(chosen)  # the document's fingerprints
    own = own[present(fingerprints, hashes[own])]
    place = np.searchsorted(own, chosen)
    near = place < len(own)
    near[near] = own[place[near]] == chosen[near]
    found = [(SPAN, at[near], hashes[chosen[near]])]
    for m in lengths:
        here = places(of, m)
        h = gram(word, here, m)
        near = present(fingerprints, h)
        found.append((m, here[near], h[near]))
    out = []
    for m, a, h in found:
        k1, k2 = gram(word, a, m), gram(word, a, m, OTHER_STEP)
        near = present(known, k2)
        out.append((m, a[near], h[near], k1[near], k2[near]))
    return out


def item_windows(words: Words) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The same of all windows of items."""
    word, of = words
    at, chosen, hashes = winnowed(word, of)
    found = [(SPAN, at, hashes[chosen])]
    texts, first, n = np.unique(of, return_index=True, return_counts=True)
    for m in range(1, SPAN):
        a = first[n == m]
        found.append((m, a, gram(word, a, m)))
    return [(m, a, h, gram(word, a, m), gram(word, a, m, OTHER_STEP)) for m, a, h in found]


def listed(found: list, of: np.ndarray, n_texts: int) -> pa.Array:
    """The windows as a list for each text, with places inside the text."""
    m, at, fp, k1, k2 = (np.concatenate(x) for x in zip(*((np.full(len(f[1]), f[0], np.int32), *f[1:]) for f in found)))
    text = of[at]
    order = np.argsort(text, kind="stable")
    first = np.searchsorted(of, np.arange(n_texts))
    arrays = [pa.array(m[order]), pa.array((at - first[text])[order]), *(pa.array(x[order].view(np.int64)) for x in (fp, k1, k2))]
    offsets = np.searchsorted(text[order], np.arange(n_texts + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(arrays, fields=list(HIT)))


def bitmap(keys: DataFrame) -> np.ndarray:
    """The bits of keys (key). What is collected is BITS / 8 bytes at most."""
    place = F.col("key").bitwiseAND(BITS - 1) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((BITS >> 15, 1 << 12), np.uint8)
    for r in parts.collect():
        out[r.part - 1] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.reshape(-1)


def windows_table(texts: DataFrame, find, key: str, kind: str) -> DataFrame:
    """(key, n_words, hits) for each of texts (key, text); hits: what find gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in K.slices(batch.column(1)):
                words = words_of(data, off)
                n = np.bincount(words[1], minlength=b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n, pa.int64()), listed(find(words), words[1], b - a)], [key, "n_words", "hits"])

    return texts.mapInArrow(run, f"{key} {kind}, n_words long, hits array<struct<m: int, start: long, fp: long, k1: long, k2: long>>")


def set_key(x: Column) -> list[Column]:
    """A hash of a set of different texts that needs no list of them."""
    return [F.count(F.lit(1)).alias("s0"), F.bit_xor(F.xxhash64(x)).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), x)).alias("s2")]


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans, items) for each document: spans (start, end) of the words that windows cover, in order and apart, and the sorted item_ids, as texts, of the windows. items: (item_id, text)."""
    spark = docs.sparkSession
    lean_session(spark)
    shelf = Shelf(spark, "winnow")
    key = ["fp", "k1", "k2", "m"]
    name = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")
    own = windows_table(items.select(name, text_or_empty().alias("text")), item_windows, "item_id", "string")
    own = shelf.put(own.select("item_id", F.explode("hits").alias("h")).select("item_id", *[f"h.{c}" for c in key]).distinct(), "item-windows")
    windows = shelf.put(own.groupBy(*key).agg(*set_key(F.col("item_id"))), "windows")
    lengths = [r.m for r in windows.where(F.col("m") < SPAN).select("m").distinct().collect()]  # SPAN - 1 at most
    bits = [spark.sparkContext.broadcast(bitmap(windows.select(F.col(c).alias("key")))) for c in ("fp", "k2")]

    def find(words: Words) -> list:
        return document_hits(words, lengths, bits[0].value, bits[1].value)

    texts = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id")).alias("id"), text_or_empty().alias("text"))
    seen = shelf.put(windows_table(texts, find, "id", "struct<row: long, doc_id: long>").select("id.row", "id.doc_id", "n_words", "hits"), "fingerprints")
    met = seen.select("row", F.explode("hits").alias("h")).select("row", "h.start", *[f"h.{c}" for c in key])
    met = shelf.put(met.join(windows, key).select("row", "start", (F.col("start") + F.col("m")).alias("end"), "s0", "s1", "s2"), "met")

    by_start = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    run = met.select("row", "start", "end", F.coalesce(F.col("start") > before, F.lit(True)).cast("long").alias("new"))
    run = run.withColumn("span", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.groupBy("row", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = run.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))

    # A document meets fewer sets than it has words.
    sets = met.select("row", F.struct("s0", "s1", "s2").alias("s")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("sets"))
    sets = shelf.put(sets.select("row", "sets", F.xxhash64("sets").alias("c1"), F.xxhash64(F.lit(1), "sets").alias("c2")), "sets")
    different = sets.groupBy("c1", "c2").agg(F.first("sets").alias("sets")).select("c1", "c2", F.explode("sets").alias("s")).select("c1", "c2", "s.*")
    members = own.join(windows, key).select("s0", "s1", "s2", "item_id").distinct()
    lists = different.join(members, ["s0", "s1", "s2"]).groupBy("c1", "c2").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hit = sets.select("row", "c1", "c2").join(lists, ["c1", "c2"]).select("row", "items").join(spans, "row")
    nothing = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    return seen.select("row", "doc_id", "n_words").join(hit, "row", "left").select("doc_id", "n_words", nothing("spans", "array<struct<start: bigint, end: bigint>>"), nothing("items", "array<string>"))


def digests(found: DataFrame) -> DataFrame:
    """Counts and a hash of what contaminated() gives."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
