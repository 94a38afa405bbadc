"""op3's distances and verdicts against plain Python, for languages with and without a reference of their own."""

import collections
import math
import re

import pytest

from tallyloom.llm import quality

DIR = "/root/testdata/sf0.001"


def kind(c):
    b = ord(c)
    if b >= 128:
        return 7
    for k, found in ((0, "a" <= c <= "z"), (1, "A" <= c <= "Z"), (2, "0" <= c <= "9"), (3, c in " \t\n\v\f\r"), (4, c in ".,;:?'\"()-"), (6, c in "#*$%&|<>")):
        if found:
            return k
    return 5


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    return [w for w in re.split(r"[\x00-@\[-`{-\x7f]+", low) if w]


def distance(a, b):
    p, q = ([x / max(sum(v), 1e-300) for x in v] for v in (a, b))
    part = lambda x, y: x * math.log2(2 * x / (x + y)) if x > 0 else 0.0
    return math.sqrt(max(0.0, sum(part(x, y) + part(y, x) for x, y in zip(p, q)) / 2))


def common(counts):
    total = sum(counts.values())
    keys = sorted(w for w, n in counts.items() if n >= max(quality.LEAST, quality.COMMON * total))
    return keys, [counts[k] / total for k in keys] + [1 - sum(counts[k] for k in keys) / max(1, total)]


def hist(own, keys):
    n = collections.Counter(own)
    out = [n[k] for k in keys]
    return [*out, len(own) - sum(out)]


def test_distances(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r.doc_id, r.text or "", r.lang) for r in docs.collect()] + [(9001, "the and " * 60 + "words of a language that is too small for its own reference.", "zz"), (9002, "#$% " * 90, "zz"), (9003, "short", None)]
    by_lang, chars, n_docs = collections.defaultdict(collections.Counter), collections.defaultdict(lambda: [0] * 8), collections.Counter()
    for _, t, lang in rows:
        by_lang[lang].update(words(t))
        n_docs[lang] += 1
        for c in t:
            chars[lang][kind(c)] += 1
    pool, everything = sum(by_lang.values(), collections.Counter()), [sum(v) for v in zip(*chars.values())]
    total = {k: sum(by_lang[k].values()) for k in n_docs}
    blend = lambda a, b, w: ({k: w * a[0].get(k, 0) + (1 - w) * b[0].get(k, 0) for k in {*a[0], *b[0]}}, w * a[1] + (1 - w) * b[1])
    as_shares = lambda c: (lambda keys, share: (dict(zip(keys, share)), share[-1]))(*common(c))
    weight = lambda k: total[k] / (total[k] + quality.EVIDENCE)
    whole = as_shares(pool)
    largest = sorted((k for k in total if total[k]), key=lambda k: (-total[k], k or ""))[: quality.NEAREST]
    others = [(None, whole), *((k, blend(as_shares(by_lang[k]), whole, weight(k))) for k in largest)]

    def reference(w, lang):
        near = [r for i, (k, r) in enumerate(others) if i == 0 or k != lang]
        best = near[0] if len(w) < quality.MIN_WORDS else min(near, key=lambda r: distance(hist(w, sorted(r[0])), [r[0][k] for k in sorted(r[0])] + [r[1]]))
        found = blend(as_shares(by_lang[lang]) if total[lang] else ({}, 0.0), best, weight(lang))
        keys = sorted(found[0])
        share = [found[0][k] for k in keys]
        own, all_ = ([x / max(1, sum(v)) for x in v] for v in (chars[lang], everything))
        return keys, [*share, 1 - sum(share)], [weight(lang) * a + (1 - weight(lang)) * b for a, b in zip(own, all_)]

    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert max(total.values()) < quality.SURE and len(got) == len(rows)
    for i, t, lang in rows:
        w, c = words(t), [0] * 8
        for x in t:
            c[kind(x)] += 1
        keys, share, classes = reference(w, lang)
        by_class = distance(c, classes) if len(t) >= quality.MIN_CHARS else None
        by_word = distance(hist(w, keys), share) if len(w) >= quality.MIN_WORDS else None
        r = got[i]
        assert r.class_distance == (None if by_class is None else pytest.approx(by_class, abs=1e-9)) and r.word_distance == (None if by_word is None else pytest.approx(by_word, abs=1e-9)), (i, lang)
        far = (by_class or 0) > quality.MAX_CLASS + quality.ALLOW / math.sqrt(max(len(t), 1)) or (by_word or 0) > quality.MAX_WORD + quality.ALLOW / math.sqrt(max(len(w), 1))
        assert r.kept == (not r.base_failed and not far), i
    assert {r.kept for r in got.values()} == {True, False}
