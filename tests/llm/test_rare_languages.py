"""op3 judges documents of languages of any size, whatever else is in the corpus."""

import random

import pytest

from tallyloom.llm import quality

SCHEMA = "doc_id long, text string, lang string"
WORDS = {"en": "the of and to in is that it was for on with as his they be at one have this".split(), "ga": "agus an na is ar le do ag go bhi si se mar ach nach ina leis faoi gan ata".split()}


def text(lang, seed, n=150):
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(WORDS[lang]) if rng.random() < 0.5 else "".join(rng.choices("abcdefghilmnoprstu", k=6)) for _ in range(n)) + "."


def junk(seed, n=150):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("#$%&*|<>0123456789XQZ", k=6)) for _ in range(n))


def rows(n_en):
    """20 Irish documents and one junk one, each language of one document, and n_en English ones."""
    out = [(i, text("ga", i), "ga") for i in range(20)] + [(50, junk(50), "ga")]
    out += [(60, junk(60), "zz"), (61, junk(61), None), (62, text("en", 62), "eng"), (63, text("ga", 63), "gle"), (64, "12345 67890 " * 3 + " ".join(map(str, range(1000, 1100))), "no")]
    return out + [(1000 + i, text("en", i), "en") for i in range(n_en)] + [(999, junk(999), "en")]


@pytest.mark.parametrize("share, nearest, far", [(0.001, 16, set()), (0.6, 1, {63})])
def test_small_languages_are_judged(spark, monkeypatch, share, nearest, far):
    """The second case joins Irish by language; its code mistyped is then compared with English only."""
    monkeypatch.setattr(quality, "LANGUAGE_SHARE", share)
    monkeypatch.setattr(quality, "NEAREST", nearest)
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows(60), SCHEMA)).collect()}
    assert len(got) == len(rows(60))
    assert {i for i, r in got.items() if not r.kept} == {50, 60, 61, 64, 999} | far
    assert all(r.class_distance is not None for r in got.values())


def test_other_languages_do_not_change_the_verdict(spark, monkeypatch):
    monkeypatch.setattr(quality, "LANGUAGE_SHARE", 0.2)
    monkeypatch.setattr(quality, "NEAREST", 1)
    small, large = ({r.doc_id: r for r in quality.quality(spark.createDataFrame(rows(n), SCHEMA)).collect()} for n in (30, 300))
    assert 0.2 < 21 / 56 and 21 / 326 < 0.2
    for i in [*range(20), 50]:
        assert small[i].kept == large[i].kept
        assert (small[i].class_distance, small[i].word_distance) == pytest.approx((large[i].class_distance, large[i].word_distance), abs=0.02)  # the rest of the blend differs
    assert not large[50].kept


def test_languages_without_common_words_are_judged_by_classes(spark):
    uncommon = [(i, " ".join("".join(random.Random(f"{i} {k}").choices("abcdefghijkl", k=9)) for k in range(300)), "xx") for i in range(20)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame([*uncommon, (50, junk(50).translate(dict.fromkeys(b"XQZ")), "xx")], SCHEMA)).collect()}
    assert {i for i, r in got.items() if not r.kept} == {50}


def test_verdicts_change_by_degrees_with_evidence(spark):
    """The same sound documents of a language that is like no other, in growing numbers: the first one's distance falls with them, and no single document more changes all verdicts."""
    seen = []
    for n in (1, 5, 8, 9, 10, 11, 40):
        docs = [(i, text("ga", i), "ga") for i in range(n)] + [(1000 + i, text("en", i), "en") for i in range(60)]
        got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(docs, SCHEMA)).collect() if r.doc_id < 1000}
        seen.append((n, sum(r.kept for r in got.values()) / n, got[0].word_distance))
    assert seen[0][1] == 0 and all(k == 1 for n, k, _ in seen if n >= 8)
    assert all(b < a + 0.01 for (_, _, a), (_, _, b) in zip(seen, seen[1:])), seen
    assert all(abs(a - b) < 0.03 for (n, _, a), (_, _, b) in zip(seen, seen[1:]) if 8 <= n <= 10)
