"""Near-duplicate classes: ProbMinHash sketches, banding, and exact verification.

A document's shingles are its runs of five words (all its words, if it has one to four), as 64-bit keys. A shingle
that occurs c times weighs 1 + ln c. Each shingle sends arrivals of a Poisson process with its weight as rate, each to
a random register; a register keeps the shingle of its first arrival. A shingle's process ends early, once its next
arrival comes after the last register's. Two documents then agree in a register with the probability Jaccard
similarity of their weighted shingles. Documents that agree in a band of registers are candidates; a link needs a
Jaccard similarity of the plain shingle sets of at least SIMILARITY, computed exactly. Texts with repeated shingles are
also sketched with unit weights, so that pairs that differ in repeats only are candidates as surely as others.

Documents with equal sets are one representative, told apart by a 128-bit fingerprint of the set. A band's bucket has a pivot, the
member that meets most others over all bands, and every member is compared with it. Two members that these links bring into the pivot's class need no link of their own; all other pairs of the
pivot's members are searched with an exact prefix filter on what sets them apart from the pivot. With E the symmetric
difference of a member's set and the pivot's, members x and y are linked only if
|E(x) & E(y)| >= (|E(x)| + |E(y)| - c (n(x) + n(y))) / 2, where c = (1 - s) / (1 + s). That is above 0 unless both are
in the pivot's class, so they share an element in the first few of E, rarest first. Members far from the pivot are
searched in the same way by their whole sets. The triangle inequality of the Jaccard distance says which members can be
linked at all. So a group of many near copies needs comparisons for what its copies share beyond the pivot, not for
each of its pairs, and no link between classes is lost.

Classes are the connected components of the links, named by their least doc_id (null if none of theirs has one). Rows
are told apart by doc_id and a 128-bit key of the text, so rows of one doc_id with different texts are judged each.
Null, empty or blank texts have no shingles and are classes of their own. Repeated rows share a class. Very long texts
are sketched whole. Without documents the result is empty. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import Shelf, doc_id, id_kind, lean_session, text_or_empty

SIZE, BANDS, ROWS, SIMILARITY = 5, 16, 4, 0.8
#: Rows that are broadcast at most (32 bytes each), and pairs that one part of a hot pivot has.
SENT, SPLIT = 1 << 20, 256
U = np.uint64


def shingles(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """For each text, the keys of its shingles in order."""
    n = len(off) - 1
    start, end, of = K.spans(data, off, K.SPACE)
    word = K.keys(data, start, end)
    at, key = K.windows(word, of, SIZE)
    count = np.bincount(of[at], minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    words = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n))))
    return [key[first[i] : first[i + 1]] if count[i] else K.mix(np.array([np.bitwise_xor.reduce(K.mix(word[words[i] : words[i + 1]] + np.arange(words[i + 1] - words[i], dtype=U)))], U)) if words[i + 1] > words[i] else key[:0] for i in range(n)]


def prob_minhash(shingle: np.ndarray, weight: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """The shingle that arrives first at each register. shingle: distinct keys."""
    first = np.full(registers, np.inf)
    who = np.zeros(registers, U)
    time = np.zeros(len(shingle))
    k = 0
    while len(shingle):
        rounds = max(1, -(-2 * registers // len(shingle)))
        seed = K.mix(shingle[None, :] + (np.arange(k + 1, k + 1 + rounds, dtype=U) * U(0x9E3779B97F4A7C15))[:, None])
        wait = -np.log(((seed >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        arrival = time + np.cumsum(wait, axis=0)
        time = arrival[-1]
        at = (K.mix(seed ^ U(0xA0761D6478BD642F)) % U(registers)).astype(np.int64).ravel()
        flat, own = arrival.ravel(), np.broadcast_to(shingle, arrival.shape).ravel()
        early = np.flatnonzero(flat < first[at])
        early = early[np.argsort(-flat[early], kind="stable")]  # the earliest is written last
        first[at[early]] = flat[early]
        who[at[early]] = own[early]
        k += rounds
        on = time < first.max()
        shingle, weight, time = shingle[on], weight[on], time[on]
    return who


def bands(who: np.ndarray) -> np.ndarray:
    key = np.zeros(BANDS, U)
    for r in range(ROWS):
        key = K.mix(key * K.STEP + who.reshape(BANDS, ROWS)[:, r])
    return K.mix(key + np.arange(BANDS, dtype=U)).view(np.int64)


def band_keys(shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Bands of the weighted sketch, and of that with unit weights where a shingle is repeated."""
    own = bands(prob_minhash(shingle, 1 + np.log(count)))
    return own if count.max() == 1 else np.concatenate((own, bands(prob_minhash(shingle, np.ones(len(shingle))))))


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, text): t1 and t2 are a 128-bit key of the text."""
    text = text_or_empty()
    return docs.select(doc_id(docs), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, fp1, fp2, n, bands): a fingerprint of the shingle set, its size, and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in K.slices(batch.column(3)):
                out: list[tuple] = []
                for s in shingles(data, off):
                    u, c = np.unique(s, return_counts=True)
                    own = K.mix(u)
                    fp = [int(x.sum(dtype=U).view(np.int64)) if len(x) else 0 for x in (own, K.mix(own))]
                    out.append((*fp, len(u), band_keys(u, c) if len(u) else None))
                one, two, n, keys = zip(*out)
                yield pa.RecordBatch.from_arrays([*(x[a:b] for x in batch.columns[:3]), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "t1", "t2", "fp1", "fp2", "n", "bands"])

    texts = texts_of(docs)
    return texts.mapInArrow(run, f"doc_id {id_kind(texts)}, t1 long, t2 long, fp1 long, fp2 long, n long, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(id, shingles): the distinct shingles of each text. texts: (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in K.slices(batch.column(1)):
                sets = [np.unique(s).view(np.int64) for s in shingles(data, off)]
                yield pa.RecordBatch.from_pydict({"id": batch.column(0)[a:b], "shingles": pa.array(sets, pa.list_(pa.int64()))})

    return texts.mapInArrow(run, "id long, shingles array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, shingles) of the texts of wanted: (id, doc_id, t1, t2).

    Up to SENT rows of wanted, of 32 bytes each, are broadcast, so that only their texts are shuffled; beyond, all are.
    """
    few = wanted.select("id", F.col("doc_id").alias("_d"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"))
    if wanted.count() <= SENT:
        few = F.broadcast(few)
    own = texts_of(docs).join(few, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")))
    return shingle_sets(own.groupBy("id").agg(F.first("text").alias("text")))  # a row can be repeated


def components(links: DataFrame, shelf: Shelf) -> DataFrame:
    """(id, class): the least id of each id's connected component. links: (a, b)."""
    both = shelf.put(links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select("b", "a")).distinct(), "both")
    old = shelf.put(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("class")), "labels")
    label = old
    while True:
        near = both.join(label.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("class").alias("near"))
        hop = label.select(F.col("id").alias("class"), F.col("class").alias("hop"))
        new = shelf.put(label.join(near, "id").join(hop, "class", "left").select("id", F.least("class", "near", "hop").alias("class"), (F.least("class", "near", "hop") < F.col("class")).alias("moved")), "labels")
        shelf.drop(old)
        old, label = new, new.select("id", "class")
        if new.where("moved").isEmpty():
            shelf.drop(both)
            return label


def faced_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with their sets x and y. An id b of many pairs has them dealt by a to parts of about SPLIT pairs, each with a copy of y."""
    many = F.broadcast(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("parts")).where("parts > 1").orderBy(F.desc("parts"), "b").limit(SENT))
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    dealt = pairs.join(many, "b", "left").withColumn("part", F.pmod(F.hash("a"), F.coalesce("parts", F.lit(1)))).drop("parts")
    copies = right.join(many, "b", "left").select("b", "y", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    return dealt.join(left, "a").join(copies, ["b", "part"]).drop("part")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) of ids with similarity, the sizes n and pivot_n, and what is in one set only (apart). sets: (id, shingles)."""
    n, m, left = F.size("x"), F.size("y"), F.array_except("x", "y")
    rows = faced_sets(pairs, sets).select("*", n.alias("n"), m.alias("pivot_n"), left.alias("own"))
    shared = F.col("n") - F.size("own")
    rows = rows.withColumn("similarity", shared / (F.col("n") + F.col("pivot_n") - shared))
    return rows.withColumn("apart", F.when(F.col("similarity") >= 0.5, F.concat("own", F.array_except("y", "x")))).drop("x", "y", "own")


def prefixes(members: DataFrame, similarity: float) -> DataFrame:
    """The rarest elements of each member's set, as far as a linked partner must share one of them.

    members: (a, b, linked, far, n, pivot_n, e) of a member a, its pivot b, and whether they are in one class already; e is the difference to
    the pivot if far is 0, the whole set if it is 1. short is for partners that are not in the pivot's class; the rest of a prefix is for those that are.
    """
    c = (1 - similarity) / (1 + similarity)
    e = members.withColumn("size", F.size("e"))
    to_open = F.when(F.col("far") == 0, (F.col("size") - c * (F.col("n") - F.col("pivot_n"))) / 2).otherwise(similarity * F.col("n"))
    to_linked = F.when(F.col("far") == 0, F.col("size") - c * (1 + 1 / similarity) * F.col("n")).otherwise(similarity * F.col("n"))
    length = lambda least: F.col("size") - F.greatest(F.ceil(least - 1e-6), F.lit(1)) + 1
    e = e.withColumns({"upto_open": length(to_open), "upto_linked": F.when(F.col("linked"), length(to_open)).otherwise(F.greatest(length(to_open), length(to_linked)))})
    items = e.select("far", "b", "a", "linked", "n", "size", "upto_open", "upto_linked", F.explode("e").alias("item"))
    often = items.groupBy("far", "b", "item").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(Window.partitionBy("far", "b", "a").orderBy("often", "item"))
    ranked = items.join(often, ["far", "b", "item"]).withColumn("place", place)
    return ranked.where("place <= upto_linked AND often > 1").select("far", "b", "item", "a", "linked", "n", "size", "place", (F.col("place") <= F.col("upto_open")).alias("short"))


def partners(prefix: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: the pairs of members of a pivot, not both in its class, that may be linked."""
    c = (1 - similarity) / (1 + similarity)
    x, y = prefix.where("short").alias("x"), prefix.where("NOT linked").alias("y")
    same = (F.col("x.far") == F.col("y.far")) & (F.col("x.b") == F.col("y.b")) & (F.col("x.item") == F.col("y.item"))
    once = F.col("x.linked") | (F.col("y.short") & (F.col("x.a") < F.col("y.a")))
    alike = F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-6
    rest = 1 + F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    enough = 2 * rest >= F.col("x.size") + F.col("y.size") - c * (F.col("x.n") + F.col("y.n")) - 1e-6
    return x.join(y, same & once & alike & enough).select(F.least("x.a", "y.a").alias("a"), F.greatest("x.a", "y.a").alias("b")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, n_shingles) for each row of docs."""
    lean_session(docs.sparkSession)
    shelf = Shelf(docs.sparkSession, "minhash")
    reach = 1 - similarity
    seen = shelf.put(sketches(docs), "sketches")
    owners = seen.where("n > 0").groupBy("fp1", "fp2", "n").agg(F.min(F.struct("doc_id", "t1", "t2", "bands")).alias("m"), F.min("doc_id").alias("least"))
    reps = shelf.put(owners.select("fp1", "fp2", "n", "least", F.monotonically_increasing_id().alias("rep"), "m.doc_id", "m.t1", "m.t2", F.array_distinct("m.bands").alias("bands")), "representatives")
    entries = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    met = shelf.put(entries.join(shared, "bucket"), "met")
    # A pivot is the bucket's representative that meets most others over all buckets: the original of copies, if it is there.
    central = met.groupBy("rep").agg(F.sum("k").alias("degree"))
    pivots = met.join(central, "rep").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("rep")).alias("r"))).alias("m")).select("bucket", (-F.col("m.r")).alias("pivot"))
    faced = shelf.put(met.join(pivots, "bucket").where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), "faced")
    named_in = faced.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = shelf.put(named_in.join(reps.select(F.col("rep").alias("id"), "doc_id", "t1", "t2"), "id"), "wanted")
    sets = shelf.put(sets_of(docs, wanted), "shingles")
    known = shelf.put(verified(faced, sets), "verified")
    shelf.drop(met, faced, wanted)
    linked = known.where(F.col("similarity") >= similarity).select("a", "b")
    label = None if linked.isEmpty() else components(linked, shelf)
    if label is None:
        placed = known.withColumn("linked", F.lit(False))
    else:
        of = lambda key: label.select(F.col("id").alias(key), F.col("class").alias(f"class_{key}"))
        placed = known.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumn("linked", F.coalesce(F.col("class_a") == F.col("class_b"), F.lit(False))).drop("class_a", "class_b")
    group = placed.groupBy("b").agg(F.count(F.lit(1)).alias("k"), F.max(F.when(~F.col("linked"), F.col("similarity"))).alias("nearest"), F.min("similarity").alias("farthest")).where("k > 1 AND nearest IS NOT NULL")
    # A member of the pivot's class matters only if it is far enough from the pivot to reach the nearest other one.
    member = placed.join(group, "b").where(~F.col("linked") | (F.col("similarity") <= F.col("nearest") + reach + 1e-9))
    columns = ("a", "b", "linked", "n", "pivot_n")
    near = member.where("similarity >= 0.5").select(*columns, F.lit(0).alias("far"), F.col("apart").alias("e"))
    low = member.where((F.col("similarity") < 0.5 + reach + 1e-9) & (F.col("farthest") < 0.5))
    whole = low.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("e")), "a").select(*columns, F.lit(1).alias("far"), "e")
    prefix = shelf.put(prefixes(near.union(whole), similarity), "prefixes")
    more = shelf.put(verified(partners(prefix, similarity), sets).where(F.col("similarity") >= similarity).select("a", "b"), "links")
    if not more.isEmpty():
        label = components(linked.union(more), shelf)
    shelf.drop(sets, known, prefix, more)
    named = reps.select("fp1", "fp2", "n", "rep", "least")
    if label is None:
        named = named.withColumnRenamed("least", "class_id")
    else:
        of_class = label.join(named.select(F.col("rep").alias("id"), "least"), "id").groupBy("class").agg(F.min("least").alias("class_least"))
        in_class = label.join(of_class, "class").select(F.col("id").alias("rep"), F.lit(True).alias("in_class"), "class_least")
        named = named.join(in_class, "rep", "left").select("fp1", "fp2", "n", F.when(F.col("in_class"), F.col("class_least")).otherwise(F.col("least")).alias("class_id"))
    some = seen.where("n > 0").select("doc_id", "fp1", "fp2", "n").join(named, ["fp1", "fp2", "n"]).select("doc_id", "class_id", F.col("n").alias("n_shingles"))
    return some.unionByName(seen.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("n").alias("n_shingles")))
