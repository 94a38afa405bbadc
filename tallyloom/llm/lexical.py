"""Ranked lexical search for a set of queries: impact vectors in buckets by length, pruned by bounds, rescored in integers.

A document is a vector of impacts: the weight of each of its terms times how often it has the term, damped by its length. The score of a
query is the sum of the impacts of its terms, so the product with a vector of ones. Vectors are dealt to ranges of their
Euclidean length, longest first, and each range is read in buckets. For each query:

- a bucket is left out if the length of its longest vector times the root of the query's terms is below the query's
  k-th best score so far (Cauchy-Schwarz), as are all buckets after it;
- else the query's terms are taken by their greatest impact in the bucket, until what the others can add at most is below
  that score. Only documents with one of the terms so taken can reach it. The sum of these coordinates and the
  least bound of the others (their greatest impacts, or the rest of the vector's length) leave out most of these documents;
- the others are scored exactly, in 64-bit integers.

Each range keeps its k best of each query, and these are merged in two steps. Bounds have a margin, and documents that can
only tie are scored, so results are exact. Queries are the small side: they are taken in blocks of BLOCK rows and
BLOCK_TERMS terms on average, and a block's terms are sent to all tasks. Each block reads the documents once.

Null and empty texts have no terms: such documents count nowhere, such queries have no rows. Very long texts are read
whole. Repeated rows are ranked one by one, and documents without a doc_id come last among equal scores. Each
row of queries has its own ranks, also if item_ids repeat or are missing. Without documents or queries the result is
empty. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import Shelf, lean_session, text_or_empty

TOP, BLOCK, BLOCK_TERMS, PARTS = 10, 4096, 1_000_000, 1024
MARGIN = 1e-9
NOT_TERM = np.array([b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])
I = np.int64  # noqa: E741


def terms_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit key and the text number of each term, ASCII letters lower-cased."""
    lower = K.LOWER[data]
    start, end, of = K.spans(lower, off, NOT_TERM)
    return K.keys(lower, start, end), of


def query_terms(items: DataFrame) -> DataFrame:
    """(query, terms): the sorted keys of each item's different terms. items: (query, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in K.slices(batch.column(1)):
                key, of = terms_of(data, off)
                own = [np.unique(key[x:y]).view(I) for x, y in zip(*(np.searchsorted(of, np.arange(b - a) + i) for i in (0, 1)))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(own, pa.list_(pa.int64()))], ["query", "terms"])

    return items.select("query", text_or_empty().alias("text")).mapInArrow(run, "query long, terms array<long>")


def term_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(row, doc_id, n, ids, tf): all terms of each document, and places in the sorted vocabulary and counts of those that are in it."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for a, b, data, off in K.slices(batch.column(2)):
                key, of = terms_of(data, off)
                place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[place] == key
                both, tf = np.unique(of[hit].astype(I) * len(known) + place[hit], return_counts=True)
                text, ids = np.divmod(both, len(known))
                offsets = pa.array(np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (ids, tf)]
                n = np.bincount(of, minlength=b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n, pa.int64()), *lists], ["row", "doc_id", "n", "ids", "tf"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, n long, ids array<int>, tf array<int>")


def impacts(n: np.ndarray, ids: np.ndarray, tf: np.ndarray, of: np.ndarray, weight: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """weight * ((10**9 tf) div (1000 tf + 8 m)) of each entry; m is 10 + (90 n n_docs) div total."""
    m = 10 + (90 * n.astype(I) * n_docs) // total
    tf = tf.astype(I)
    return weight[ids] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[of]))


def lists_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, tf and row numbers of a batch's entries."""
    ids, tf = batch.column("ids"), batch.column("tf")
    of = np.repeat(np.arange(len(ids)), np.diff(ids.offsets.to_numpy()))
    return ids.flatten().to_numpy(), tf.flatten().to_numpy(), of


class Best:
    """The k best (score, doc_id) of a query so far."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.none = k, np.zeros(0, I), np.zeros(0, I), np.zeros(0, bool)

    def least(self) -> int:
        """What a score must reach to be among them."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        s, i, x = np.concatenate((self.score, score)), np.concatenate((self.id, ids)), np.concatenate((self.none, none))
        first = np.lexsort((i, x, -s))[: self.k]
        self.score, self.id, self.none = s[first], i[first], x[first]


class Bucket:
    """Documents of near lengths, with a list of documents and impacts for each term."""

    def __init__(self, length: np.ndarray, ids: np.ndarray, impact: np.ndarray, of: np.ndarray, n_terms: int):
        order = np.argsort(ids, kind="stable")
        self.length, self.longest = length, float(length.max(initial=0.0))
        self.doc, self.impact = of[order], impact[order]
        self.first = np.searchsorted(ids[order], np.arange(n_terms + 1))
        held = np.flatnonzero(np.diff(self.first))
        self.peak = np.zeros(n_terms, I)
        self.peak[held] = np.maximum.reduceat(self.impact, self.first[held]) if len(held) else 0
        self.sums = np.zeros(len(length), I)

    def scores(self, terms: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents whose score is least or more, and their scores."""
        nothing = np.zeros(0, I), np.zeros(0, I)
        if sqrt(len(terms)) * self.longest * (1 + MARGIN) < least:
            return nothing
        peak = self.peak[terms]
        order = np.argsort(-peak, kind="stable")[: int((peak > 0).sum())]
        terms, peak = terms[order], peak[order]
        left = len(terms) - np.arange(len(terms) + 1)
        after = np.append(np.cumsum(peak[::-1])[::-1], 0)  # what the terms from here on add at most
        rest = np.minimum(after, np.sqrt(left) * self.longest) * (1 + MARGIN)
        n = int(np.argmax(rest < least))  # the last is 0, so there is one
        entries = [slice(self.first[t], self.first[t + 1]) for t in terms.tolist()]
        if not n:
            return nothing
        doc, impact = (np.concatenate([x[e] for e in entries[:n]]) for x in (self.doc, self.impact))
        sums = np.bincount(doc, impact, len(self.length))
        squares = np.bincount(doc, impact.astype(float) ** 2, len(self.length))
        found = np.flatnonzero(sums)
        own = np.sqrt(np.maximum(0.0, self.length[found] ** 2 * (1 + MARGIN) - squares[found]) * left[n])
        found = found[(sums[found] + np.minimum(after[n], own)) * (1 + MARGIN) >= least]
        for e in entries:
            self.sums[self.doc[e]] += self.impact[e]
        score = self.sums[found]
        for e in entries:
            self.sums[self.doc[e]] = 0
        good = score >= least
        return found[good], score[good]


def best_of_ranges(vectors: DataFrame, queries: list[tuple[int, np.ndarray]], weight: np.ndarray, n_docs: int, total: int, k: int) -> DataFrame:
    """(query, doc_id, score): the k best of each query in each range. vectors: (length, doc_id, n, ids, tf), longest first in each partition."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries, weight))  # one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w = shared.value
        best = {q: Best(k) for q, _ in asked}
        for batch in batches:
            ids, tf, of = lists_of(batch)
            bucket = Bucket(batch.column("length").to_numpy(), ids, impacts(batch.column("n").to_numpy(), ids, tf, of, w, n_docs, total), of, len(w))
            doc_id = batch.column("doc_id")
            none = np.asarray(doc_id.is_null())
            doc_id = doc_id.fill_null(0).to_numpy()
            for q, terms in asked:
                doc, score = bucket.scores(terms, best[q].least())
                if len(doc):
                    best[q].add(score, doc_id[doc], none[doc])
        for q, b in best.items():
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), q, I)), pa.array(b.id, pa.int64(), mask=b.none), pa.array(b.score)], ["query", "doc_id", "score"])

    return vectors.mapInArrow(run, "query long, doc_id long, score long")


def best_rows(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best of each group, with their rank."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def block_results(docs: DataFrame, queries: list[tuple[int, np.ndarray]], k: int, shelf: Shelf) -> DataFrame:
    """(query, doc_id, score): the best of each range for a block of queries."""
    vocabulary = np.unique(np.concatenate([t for _, t in queries]))
    table = shelf.put(term_counts(docs, vocabulary), "terms")
    n_docs, total = table.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    df = np.zeros(len(vocabulary), I)
    for r in table.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # of the block's terms
        df[r["id"]] = r["count"]
    weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], I)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tf, of = lists_of(batch)
            p = impacts(batch.column("n").to_numpy(), ids, tf, of, weight, n_docs, total)
            yield batch.append_column("length", pa.array(np.sqrt(np.bincount(of, p.astype(float) ** 2, len(batch)))))

    vectors = table.where(F.size("ids") > 0).mapInArrow(measured, "row long, doc_id long, n long, ids array<int>, tf array<int>, length double")
    vectors = vectors.repartitionByRange(F.desc("length"), "row").sortWithinPartitions(F.desc("length"), "row")  # rows: many vectors may be alike
    asked = [(q, np.searchsorted(vocabulary, t)) for q, t in queries]
    return shelf.put(best_of_ranges(vectors, asked, weight, n_docs, total, k).withColumn("part", F.spark_partition_id() % PARTS), "found")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 for each of items (item_id, text)."""
    lean_session(docs.sparkSession)
    shelf = Shelf(docs.sparkSession, "lexical")
    named = shelf.put(items.select("item_id", "text").withColumn("query", F.monotonically_increasing_id()), "items")
    asked = shelf.put(query_terms(named).where(F.size("terms") > 0), "queries")
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK), -(-size // BLOCK_TERMS))
    found = []
    for b in range(blocks if n else 0):
        own = [(r["query"], np.array(r["terms"], I).view(K.U)) for r in asked.where(F.pmod("query", F.lit(blocks)) == b).collect()]  # one block
        if own:
            found.append(block_results(docs, own, k, shelf))
    if not found:
        return named.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where(F.lit(False))
    rows = found[0]
    for x in found[1:]:
        rows = rows.union(x)
    best = best_rows(best_rows(rows, k, "query", "part").drop("rank", "part"), k, "query")
    return named.select("item_id", "query").join(best, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
