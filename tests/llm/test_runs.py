"""Periodic runs against a plain search, and what the registered query makes of them."""

import hashlib
import random
import re
import zlib

import pytest

from tallyloom.llm import queries, runs


def plain_runs(words, least=6, times=4):
    """All maximal stretches with their smallest period, by trying every lag at every place."""
    n, found = len(words), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    drop = {i for s, m, p in found for i in range(s + p, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(listed), sha(kept))


def test_runs_equal_a_plain_search():
    rng = random.Random(7)
    for _ in range(400):
        words = []
        while len(words) < rng.randrange(1, 160):
            unit = [rng.choice("abcdefgh"[: rng.randrange(1, 9)]) for _ in range(rng.randrange(1, 9))]
            words += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit))]
        raw = [w.encode() for w in words]
        assert runs.runs_of(raw) == plain_runs(raw), words


def test_long_and_hostile_texts():
    assert runs.runs_of([b"a"] * 200_000) == [(0, 200_000, 1)]
    unit = [str(i).encode() for i in range(30_000)]
    assert runs.runs_of(unit * 4) == [(0, 120_000, 30_000)]
    assert runs.runs_of(unit * 3 + unit[:-1]) == []
    pair = [b"a", b"b"] * 50_000 + [b"c"] + [b"b", b"a"] * 4
    assert runs.runs_of(pair) == [(0, 100_000, 2), (100_001, 8, 2)]


def test_words_that_are_too_rare_split_until_stable():
    code = runs.np.array([0, 1, 0, 1, 0, 1, 2, 0, 1, 0, 1, 0, 1, 0, 1])
    assert runs.segments(code) == [(7, 15)]


def test_query_equals_brute_force(spark):
    docs = queries.documents(spark, "/root/testdata/sf0.001")
    texts = {r.doc_id: r.text for r in docs.collect()}
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r.doc_id: tuple(r[c] for c in cols) for r in queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(texts) and sum(x[1] for x in got.values()) > 3
    for i, text in texts.items():
        if len(text.split()) < 1500:
            assert got[i] == expected(i, text)


def test_odd_rows(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    rows = [(None, "a a a a a a"), (1, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, "a\xa0a " * 6), (3, "a\xa0a " * 6), *((i, " ".join(map(str, range(40 + i)))) for i in ids), (ids[0], None)]
    docs = spark.createDataFrame([(t, i, 7, t) for i, t in rows], "text string, doc_id long, n_words int, `runs.start` string")
    got = runs.digests(runs.periodic_runs(runs.planted(docs))).collect()
    want = [expected(i, t) for i, t in rows]
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in got))) == sorted(map(repr, want))
    assert runs.digests(runs.periodic_runs(docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, times=2)
