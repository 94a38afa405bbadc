"""Ranks against a plain score of every document for every item."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from tallyloom.llm import lexical, queries


def terms_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def expected(docs, items, k=10):
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked, found = set(terms_of(text)), []
        for i, b in bags:
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * (10 + 90 * sum(b.values()) * n_docs // total))) for t in asked & set(b))
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(map(repr, out))


def rows(df):
    return sorted(repr((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in df.collect())


def test_query_equals_sql_and_plain_scores(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        got = rows(queries.op11_lexical_search(spark, sf))
        c = duckdb.connect()
        for t in ("documents", "benchmark"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        assert got == sorted(map(repr, c.sql(queries.oracle_sql()["op11_lexical_search"]).fetchall()))
    docs, items = ([(r[0], r["text"]) for r in f(spark, "/root/testdata/sf0.001").collect()] for f in (queries.documents, queries.benchmark))
    assert rows(queries.op11_lexical_search(spark, "/root/testdata/sf0.001")) == expected(docs, items)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_ties_and_bounds(spark, k, monkeypatch):
    rng = random.Random(k)
    say = lambda n: " ".join(str(int(rng.paretovariate(0.7))) for _ in range(n))
    docs = [(i, say(rng.randrange(0, 60))) for i in range(300)]
    docs += [(1000 - i, docs[i % 7][1]) for i in range(60)]
    items = [(i, say(rng.randrange(0, 25))) for i in range(40)]
    monkeypatch.setattr(lexical, "BLOCK", 16)  # three blocks
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")  # many buckets
    try:
        got = rows(lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == expected(docs, items, k)


def test_odd_rows(spark):
    docs = [(None, "a b c"), (None, "a b c"), (5, "a b c"), (4, "a b c"), (4, "A, b!"), (1, None), (2, ""), (3, "é É x " * 3000), (6, "\x00a\x00")]
    items = [(1, "a"), (1, "a"), (None, "É b"), (2, None), (3, "..."), (4, "zzz"), (5, "b a c x é")]
    make = lambda x, k: spark.createDataFrame([(t, i, 1, t) for i, t in x], f"text string, {k} long, query int, `a.n` string")
    assert rows(lexical.search(make(docs, "doc_id"), make(items, "item_id"))) == expected(docs, items)
    assert rows(lexical.search(make(docs, "doc_id"), make(items, "item_id").limit(0))) == []
    assert rows(lexical.search(make(docs, "doc_id").limit(0), make(items, "item_id"))) == []
    assert rows(lexical.search(make(docs[5:7], "doc_id"), make(items, "item_id"))) == []
