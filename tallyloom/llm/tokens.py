"""Token counts: each distinct pre-token is tokenised once, and documents sum the counts of theirs.

One pass over the texts gives each document's pre-tokens and how often it has each, which are stored. The distinct ones of
all documents get their number of tokens. Frequent ones (in at least one of HEAD of all document's entries, so HEAD of them
at most, known by 16-byte keys) are broadcast; the others are joined by a shuffle, where no pre-token can be hot any more.
Both joins' counts are summed for each document before they are shuffled. No token ids are kept.

Null and empty texts have no tokens. Special strings in a text are one token each, as the library's default has it.
Rows are told apart by a number of their own, so repeated rows, missing and repeated doc_ids get a row each. Very long
texts are cut whole, one at a time. Without documents the result is empty. Other columns are not read.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import cutter, specials, text_runs
from .common import Shelf, lean_session, text_or_empty

HEAD = 2_000_000


def pretoken_table(docs: DataFrame, special: list[str]) -> DataFrame:
    """(row, doc_id, n_bytes, shown, pieces, times): each row's distinct pre-tokens and their counts; shown: its special strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, marks = cutter(special), set(special)
        for batch in batches:
            for a, b in text_runs(batch.column(3)):
                pieces, times, shown = [], [], []
                for text in batch.column(3)[a:b].to_pylist():
                    count = Counter(cut(text))
                    shown.append(sum(count.pop(m, 0) for m in marks))
                    pieces.append(list(count))
                    times.append(list(count.values()))
                yield pa.RecordBatch.from_arrays([*(x[a:b] for x in batch.columns[:3]), pa.array(shown, pa.int64()), pa.array(pieces, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))], ["row", "doc_id", "n_bytes", "shown", "pieces", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, n_bytes long, shown long, pieces array<string>, times array<int>")


def token_numbers(pieces: DataFrame, described: str) -> DataFrame:
    """(piece, entries, n): the number of tokens of each piece. pieces: (piece, entries)."""
    shared = pieces.sparkSession.sparkContext.broadcast(described)  # a tokenizer's file, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(shared.value)
        tok.no_padding()
        tok.no_truncation()
        for batch in batches:
            for a, b in text_runs(batch.column(0), 20_000):  # the library makes a large object of each piece
                own = batch.column(0)[a:b]
                n = [len(x) for x in tok.encode_batch_fast(own.to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([own, batch.column(1)[a:b], pa.array(n, pa.int64())], ["piece", "entries", "n"])

    return pieces.mapInArrow(run, "piece string, entries long, n long")


def keyed(piece: str) -> list[Column]:
    """A 16-byte key of a pre-token."""
    return [F.xxhash64(F.col(piece)).alias("k1"), F.xxhash64(F.lit(1), F.col(piece)).alias("k2")]


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each document."""
    spark = docs.sparkSession
    lean_session(spark)
    shelf = Shelf(spark, "tokens")
    with open(tokenizer_file, encoding="utf-8") as f:
        described = f.read()
    table = shelf.put(pretoken_table(docs, list(specials(json.loads(described)))), "pre-tokens")
    entries = table.select("row", F.explode(F.arrays_zip(F.col("pieces").alias("piece"), F.col("times").alias("times"))).alias("x")).select("row", "x.piece", "x.times")
    numbers = shelf.put(token_numbers(entries.groupBy("piece").agg(F.count(F.lit(1)).alias("entries")), described), "numbers")
    total = numbers.agg(F.sum("entries")).first()[0] or 0
    frequent = F.col("entries") * HEAD >= total
    known = entries.select("row", *keyed("piece"), "times", "piece")
    head = F.broadcast(numbers.where(frequent).select(*keyed("piece"), "n"))
    by_head = known.join(head, ["k1", "k2"]).groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("n"))
    tail = numbers.where(~frequent).select("piece", "n")  # most are shorter than a key
    by_tail = known.join(head, ["k1", "k2"], "left_anti").select("row", "piece", "times").join(tail, "piece").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("n"))
    own = table.select("row", "doc_id", "n_bytes", F.col("shown").alias("n"))
    parts = own.unionByName(by_head.union(by_tail), allowMissingColumns=True)
    one = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return one.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
