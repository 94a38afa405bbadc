"""Ids, keys and column names: 64-bit ids beside nulls, equal short keys, clashing names, empty tables, long texts."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import bpe, katz, mixing, pii, quality, tokens, warc

FILE = public_tokenizers.path("byte_bpe_50k.json")
BIG = 2**53 + 1
TEXTS = [(BIG, "one two, a1@mail.example.com"), (None, "t17991"), (None, "t189284"), (BIG, "another text of this id"), (None, None), (BIG + 1, "=" * 4000 + " x"), (BIG + 1, "=" * 4000 + " x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", BIG + 2 if i else None) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("head", [1, 2_000_000])
def test_token_counts_by_row(docs, monkeypatch, head):
    monkeypatch.setattr(tokens, "HEAD", head)
    t = Tokenizer.from_file(FILE)
    want = [(i, len((x or "").encode()), len(t.encode(x or "").ids), len(t.encode(x or "").ids) > 1024) for i, x in TEXTS]
    assert rows_of(tokens.token_counts(docs, FILE)) == sorted(want, key=repr)


def test_bpe_keeps_ids_and_other_columns(docs):
    t = Tokenizer.from_file(FILE)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in bpe.round_trip(docs, FILE).collect()) == sorted((i or 0, len(t.encode(x or "").ids)) for i, x in TEXTS)
    out = bpe.encode_documents(docs.withColumnRenamed("lang", "Token_IDs"), FILE)
    assert out.columns == ["doc_id", "source", "n_chars", "text", "token_ids", "n_tokens"]
    assert sorted((r.doc_id or 0, r.n_chars or 0, r.text) for r in out.collect()) == sorted((i or 0, BIG + 2 if i else 0, x or "") for i, x in TEXTS)


def test_pii_keeps_ids_and_other_columns(docs, spark):
    out = pii.pseudonymised(docs.withColumnRenamed("lang", "PII"), "key")
    assert out.columns == ["doc_id", "text", "source", "n_chars", "pii"]
    got = out.collect()
    assert sorted((r.doc_id or 0, r.n_chars or 0, len(r.text or "")) for r in got) == sorted((i or 0, BIG + 2 if i else 0, len(x or "")) for i, x in TEXTS)
    assert sum(sum(r.pii.values()) for r in got) == 1 and {r.text for r in got if not r.pii} == {x for i, x in TEXTS if "@" not in (x or "")}
    assert rows_of(pii.pseudonymised(docs, "key")) != rows_of(pii.pseudonymised(docs, "other key"))
    with pytest.raises(ValueError):
        pii.pseudonymised(docs, "")


def test_quality_tells_null_from_empty(spark):
    rows = [(1, "a b c", None), (2, "a b c", ""), (3, "a b c", "en")]
    assert {(r.doc_id, r.lang) for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()} == {(1, None), (2, ""), (3, "en")}


def test_warc_frequent_payload(spark, monkeypatch):
    from tallyloom.llm import warc as w

    monkeypatch.setattr(w, "SPLIT", 3)
    page = "z" * 1500
    rows = [(i, f"u{i}", page) for i in range(40)] + [(100 + i, "v", "y" * 1000) for i in range(2)] + [(200, "x", "q" * 999), (201, "x", "q" * 999)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].record_type == "revisit" and got[i].refers_to == 39 and got[i].payload_bytes == 1500 for i in range(39)) and got[39].record_type == "response"
    assert (got[100].refers_to, got[101].refers_to, got[200].refers_to, got[201].record_type) == (101, None, None, "response")
    assert got[5].payload_digest == hashlib.sha1(page.encode()).hexdigest()
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("sf_dir, least", [("/root/testdata/sf0.01", 0.99)])
def test_mixing_meets_its_targets(spark, sf_dir, least):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mixing.mixture(docs, 7).collect()
    taken, target, shards = {}, {}, [0] * 7
    for r in got:
        key = (r.source_size, r.target)
        taken[key] = taken.get(key, 0) + r.taken
        target[key] = r.target
        for s in r.shards:
            shards[s] += r["size"]
    assert all(abs(taken[k] - target[k]) <= max((1 - least) * target[k], 70) for k in target), {k: (taken[k], target[k]) for k in target}
    assert sum(shards) == sum(taken.values()) and max(shards) < 2.5 * sum(shards) / 7
    mixed = mixing.mixed(docs, 7)
    assert mixed.rdd.getNumPartitions() == 7 and mixed.count() == sum(len(r.shards) for r in got)


def test_mixing_parts_and_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 4)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 20)
    rows = [(None, " ".join([f"w{i}"] * (1 + i % 7)), "a" if i % 3 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(docs, 5).collect()
    sums = {}
    for r in got:
        a = sums.setdefault(r.source_size, [0, r.target, r.source_size])
        a[0] += r.taken
        assert r.taken <= 3 * r["size"]
    assert len(got) == 400 and all(abs(t - want) <= 8 for t, want, _ in sums.values()), sums
    assert rows_of(mixing.mixed(docs, 5)) == rows_of(mixing.mixed(docs.repartition(3), 5))


def test_katz_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b a b"), (None, "a b c"), (BIG, "a"), (BIG, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in katz.katz_scores(docs).collect()) == [(0, 4), (0, 5), (BIG, 1), (BIG, 2)]
