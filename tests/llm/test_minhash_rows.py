"""Near-duplicates by row: doc_ids that are missing or have several texts, repeated shingles, hot pivots."""

import random

import pytest

from tallyloom.llm import minhash

SCHEMA = "doc_id long, text string, class_id string, n int"


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def classes(spark, rows):
    got = minhash.near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA))
    assert got.columns == ["doc_id", "class_id", "n_shingles"]
    out = [(r.doc_id, r.class_id, r.n_shingles) for r in got.collect()]
    assert len(out) == len(rows)
    return out


def test_one_id_with_two_texts(spark):
    w = " ".join(words(1, 60))
    got = classes(spark, [(1, "a b c d e f"), (1, w), (2, w + " x"), (3, "g h i j k l m")])
    assert sorted((i, c) for i, c, n in got if n >= 50) == [(1, 1), (2, 1)]
    assert sorted((i, c) for i, c, n in got if n < 50) == [(1, 1), (3, 3)]


def test_rows_without_an_id(spark):
    w = " ".join(words(2, 60))
    got = classes(spark, [(None, w), (7, w + " x"), (None, "a b c d e f"), (None, ""), (2**53 + 1, w), (None, None), (None, w)])
    assert sorted(got, key=repr) == sorted([(None, 7, 56), (7, 7, 57), (None, None, 2), (None, None, 0), (2**53 + 1, 7, 56), (None, None, 0), (None, 7, 56)], key=repr)


def test_repeats_do_not_hide_a_link(spark):
    rows = []
    for k in range(12):  # plain similarity 0.81 and more, probability Jaccard about 0.5
        w = words(100 + k, 64)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w + words(200 + k, 9) * 50))]
    got = {i: c for i, c, _ in classes(spark, rows)}
    assert all(got[2 * k + 1] == 2 * k for k in range(12))


@pytest.mark.parametrize("sent, split", [(0, 4), (1 << 20, 7)])
def test_hot_pivots_and_both_ways_to_fetch_texts(spark, monkeypatch, sent, split):
    monkeypatch.setattr(minhash, "SENT", max(sent, 1))
    monkeypatch.setattr(minhash, "SPLIT", split)
    base, rng, rows = words(5, 80), random.Random(5), []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(80)] = f"e{rng.randrange(12)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(76)} for _, t in rows]
    up = list(range(60))
    for i in range(60):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = up[i], up[j]
                up = [min(x, y) if u in (x, y) else u for u in up]
    assert {i: c for i, c, _ in classes(spark, rows)} == dict(enumerate(up))
