"""Benchmark passages against a plain search for every window."""

import hashlib
import random
import re

from tallyloom.llm import queries, winnow


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def expected(docs, items):
    """docs: (doc_id, text); items: (item_id, text)."""
    windows = {}
    for i, text in items:
        w = words_of(text)
        for k in range(len(w) - 9) if len(w) >= 10 else [0] * bool(w):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if own := windows.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    found |= own
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


def rows(df):
    return sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in df.collect())


def test_query_equals_brute_force(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        docs, items = queries.documents(spark, sf), queries.benchmark(spark, sf)
        want = expected([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
        assert rows(queries.op13_decontamination(spark, sf)) == want and any("True" in x for x in want)


def test_random_texts_of_few_words(spark):
    rng = random.Random(3)
    say = lambda n, k: " ".join(rng.choice("abcdefghijkl"[:k]) for _ in range(n))
    items = [(i, say(rng.randrange(0, 30), 12)) for i in range(60)] + [(100 + i, say(rng.randrange(0, 14), 2)) for i in range(20)]
    docs = [(i, say(rng.randrange(0, 200), rng.choice((2, 3, 12)))) for i in range(80)]
    docs += [(200 + i, say(9, 12) + " " + items[i][1] + ", " + items[i + 1][1].upper()) for i in range(50)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(winnow.digests(winnow.contaminated(d, b))) == expected(docs, items)


def test_odd_rows(spark):
    passage = "Ein Satz, den es zweimal gibt: äöü ÄÖÜ 東京 1 2 3 4 5"
    docs = [(None, passage), (None, passage), (1, None), (1, ""), (2, "x " * 5000 + passage), (3, passage.replace(",", "\x00;")), (4, passage.replace("ä", "a")), (5, passage.lower())]
    items = [(7, passage), (7, passage), (10, passage + " 6"), (9, None), (8, ""), (None, "zweimal gibt"), (11, "...")]
    make = lambda x, k: spark.createDataFrame([(t, i, 1, t) for i, t in x], f"text string, {k} long, n_words int, `hits.m` string")
    assert rows(winnow.digests(winnow.contaminated(make(docs, "doc_id"), make(items, "item_id")))) == expected(docs, items)
    assert rows(winnow.digests(winnow.contaminated(make(docs, "doc_id"), make(items, "item_id").limit(0)))) == expected(docs, [])
    assert winnow.contaminated(make(docs, "doc_id").limit(0), make(items, "item_id")).count() == 0


def test_each_shared_span_shares_a_fingerprint():
    rng = random.Random(1)
    shared = [rng.randrange(50) for _ in range(winnow.SPAN)]
    for _ in range(50):
        chosen = []
        for _ in range(2):
            before, after = ([rng.randrange(50) for _ in range(rng.randrange(20))] for _ in range(2))
            word = winnow.K.mix(winnow.np.array(before + shared + after, winnow.K.U))
            at, place, hashes = winnow.winnowed(word, winnow.np.zeros(len(word), winnow.np.int64))
            chosen.append((set(hashes[place].tolist()), hashes[place[at == len(before)]].tolist()))
        assert chosen[0][1] == chosen[1][1] and chosen[0][0] & chosen[1][0]
