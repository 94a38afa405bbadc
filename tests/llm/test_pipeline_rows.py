"""The pipeline decides by row, also where doc_ids are missing or repeated; whole rows are compared with brute force."""

import hashlib
import random

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import pii, quality

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{DIR}/documents.parquet")
    rng = random.Random(3)
    rows = []
    for i, r in enumerate(real.orderBy("doc_id").collect()):
        rows.append((rng.choice([None, i % 40, r.doc_id]), r.text, r.lang, r.source, r.n_chars))
    rows += [rows[0], rows[1], (None, *rows[2][1:]), (0, *rows[3][1:]), (None, "", "en", "s", 0), (None, None, "en", "s", 0)]
    return spark.createDataFrame(rows, real.schema).cache()


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_quality_rules_by_row(spark, docs):
    rows = docs.collect()
    numbered = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], docs.schema)
    kept = {r.doc_id for r in quality.quality(numbered).where("kept").collect()}
    want = [r for i, r in enumerate(rows) if i in kept]
    assert 0 < len(want) < len(rows)
    assert ordered(corpus_pipeline.quality_rules(spark, docs, DIR).collect()) == ordered(want)


def test_near_dedup_by_row(spark, docs):
    rows = list({tuple(r) for r in docs.collect()})
    split = [(r[1] or "").encode().split() for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in split]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    classes = {}
    for i, r in enumerate(rows):
        classes.setdefault(top(i), []).append(r)
    got = ordered(corpus_pipeline.near_dedup(spark, docs, DIR).collect())
    of = {r: top(i) for i, r in enumerate(rows)}
    assert sorted(of[r] for r in got) == sorted(classes)  # one whole row of each class
    rank = lambda r: (r[0] is None, r[0] or 0)
    assert all(rank(r) == min(map(rank, classes[of[r]])) for r in got)


def test_private_data_by_row(spark, docs):
    key = hashlib.blake2b(pii.session_key(spark).encode(), digest_size=32).digest()
    want = [(r[0], r[1] if r[1] is None else pii.replaced(r[1], key)[0], *r[2:]) for r in docs.collect()]
    got = corpus_pipeline.private_data(spark, docs, DIR)
    assert got.columns == docs.columns and ordered(got.collect()) == ordered(want) and ordered(want) != ordered(docs.collect())


def test_source_mix_by_row(spark, docs):
    rows = [tuple(r) for r in docs.collect()]
    got = [tuple(r) for r in corpus_pipeline.source_mix(spark, docs, DIR).collect()]
    assert set(got) <= set(rows) and all(got.count(r) <= 3 * rows.count(r) for r in set(got))
    words = lambda r: len((r[1] or "").encode().split())
    size, taken = {}, {}
    for side, some in ((size, rows), (taken, got)):
        for r in some:
            side[r[3]] = side.get(r[3], 0) + words(r)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, total, full = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(size.values()), set()
    while True:
        unit = (total - sum(3 * size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        new = {s for s in order if s not in full and unit * weight[s] > 3 * size[s]}
        if not new:
            break
        full |= new
    for s in order:
        target = 3 * size[s] if s in full else unit * weight[s]
        largest = max(words(r) for r in rows if r[3] == s)
        assert abs(taken.get(s, 0) - target) <= max(0.02 * target, largest / 2), (s, taken.get(s), target)


def test_encoding_by_row(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = corpus_pipeline.encoding(spark, docs, DIR)
    assert set(docs.columns) < set(got.columns)
    want = [(r.doc_id, r.lang, r.source, r.n_chars, r.text or "", t.encode(r.text or "").ids) for r in docs.collect()]
    assert ordered(tuple(r) for r in got.select("doc_id", "lang", "source", "n_chars", "text", "token_ids").collect()) == ordered(want)


CHECKS = (test_quality_rules_by_row, test_near_dedup_by_row, test_private_data_by_row, test_source_mix_by_row, test_encoding_by_row)


def test_the_chain_stage_by_stage(spark, tmp_path):
    """Each stage on what the one before it gave, against its plain version, and run() gives the same rows."""
    d = spark.read.parquet(f"{DIR}/documents.parquet")
    for i, (check, (_, stage)) in enumerate(zip(CHECKS, corpus_pipeline.STAGES, strict=True)):
        check(spark, d)
        stage(spark, d, DIR).write.parquet(f"{tmp_path}/{i}")
        d = spark.read.parquet(f"{tmp_path}/{i}")
    assert ordered(corpus_pipeline.run(spark, DIR).collect()) == ordered(d.collect())


def test_other_columns_of_any_name(spark, docs):
    more = docs.withColumn("_key", corpus_pipeline.F.col("n_chars") * 7).withColumn("_KEY_", corpus_pipeline.F.lit("x")).withColumn("a.b", corpus_pipeline.F.lit(None).cast("int")).withColumn("class_id", corpus_pipeline.F.lit(1)).withColumn("last", corpus_pipeline.F.lit(True))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, DIR)
        assert out.columns == more.columns
        got = out.collect()
        assert got and all(r["_key"] is None or r["_key"] == 7 * r["n_chars"] for r in got) and {r["a.b"] for r in got} == {None}
        if stage in (corpus_pipeline.quality_rules, corpus_pipeline.near_dedup):
            assert ordered(r[:5] for r in got) == ordered(stage(spark, docs, DIR).collect()) or stage is corpus_pipeline.near_dedup
    assert set(more.columns) < set(corpus_pipeline.encoding(spark, more, DIR).columns)


def test_no_documents(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DIR).count() == 0
