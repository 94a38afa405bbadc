"""Memory of one chunk of the language model: bounded for each token, whatever the texts are."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tallyloom.llm import katz
from tallyloom.llm import kernels as K


def test_chunk_in_few_bytes_a_token(monkeypatch):
    monkeypatch.setattr(K, "SLICE", 1 << 16)
    rng = np.random.default_rng(5)
    names = np.array([f"w{i}" for i in range(20_000)])
    docs = [names[np.minimum(19_999, rng.zipf(1.3, 400))] for _ in range(1000)] + [names[:0]]
    table = pa.table({"text": [" ".join(x) for x in docs[:-1]] + [None], "held_out": [i % 7 == 2 for i in range(len(docs))]})
    tracemalloc.start()
    chunk = katz.Chunk(table, 4)
    n = len(chunk.words)
    pairs = katz.Pairs(chunk, np.arange(n), np.arange(n) % 3, 1000, 5, 8, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(chunk.word) == 401_001 and n == len({w for x in docs for w in x}) + 1
    seen = {(h, w) for x in docs for h, w in zip(["", *x], [*x, ""])}
    assert len(pairs.h) == len(seen)
    assert peak < 45 * len(chunk.word), peak / len(chunk.word)


def test_sums_of_hot_histories_stay_in_the_buckets(spark, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK", 20_000)
    rows = [(i, " ".join([*"abcdefghij"[i % 10 :], f"only{i}", *"abcdefghij"[: i % 10]])) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, at = katz.fitted(docs)
    assert at["chunks"] > 1 and len(at["hot"][0]) == 11  # ten words and the start: all histories but the words of one document
    lists = at["pairs"].selectExpr("kind", "coalesce(size(histories), 0) AS h", "coalesce(size(stats), 0) AS s").groupBy("kind").sum("h", "s").collect()
    sums = {r.kind: (r["sum(h)"], r["sum(s)"]) for r in lists}
    assert sums["answer"][1] == 0 and sums["history"][0] <= 11 * at["buckets"]
    assert sums["history"][1] == 7 * sums["history"][0]
    assert katz.scored(docs, model, at).where("score < 0").count() == 1000
