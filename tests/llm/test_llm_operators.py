"""Each operator against brute force, with nulls, empty and long texts, repeated rows and clashing columns."""

import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import audio, bpe, html, katz, minhash, mixing, pii, quality, tokens, warc

FILE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "  a  b   <|endoftext|>  x\n\n y<|endoftext|>", "½ x² ⅷ don't I'LL 'll    z\x1cq\x85", "ab" * 5000, "日本語テキスト😀😀 👩‍👩‍👧", "=" * 3000 + "\t\t  ", "\r\n\r\n x", "one two three four five six seven eight nine ten " * 9, "same words here", "same words here"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, n_tokens string, pii int"


@pytest.fixture(scope="module")
def docs(spark):
    real = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    odd = [(10_000 + i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}") for i, t in enumerate(TEXTS)]
    rows = real + odd + [odd[4]] + [(None, "no id", "xx", "s1")]
    return spark.createDataFrame([(*r, len(r[1] or ""), 5, "x", 1) for r in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_token_counts(docs, empty, monkeypatch):
    monkeypatch.setattr(tokens, "HEAD", 500)
    t = Tokenizer.from_file(FILE)
    n = lambda s: len(t.encode(s or "", add_special_tokens=False).ids)
    assert rows_of(tokens.token_counts(docs, FILE)) == sorted([(r.doc_id, len((r.text or "").encode()), n(r.text), n(r.text) > 1024) for r in docs.collect()], key=repr)
    assert tokens.token_counts(empty, FILE).count() == 0


def test_bpe(docs, empty):
    t = Tokenizer.from_file(FILE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def want(r):
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        return r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))

    assert rows_of(bpe.round_trip(docs, FILE)) == sorted([want(r) for r in docs.collect()], key=repr)
    assert bpe.round_trip(empty, FILE).count() == 0


def test_quality_base(docs, empty):
    def base(r):
        t, w = r.text or "", words(r.text)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        at = collections.defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        again = {i + k for x in at.values() if len(x) > 1 for i in x for k in range(8)}
        return r.doc_id, len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), dup, len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)

    got = quality.quality(docs)
    assert rows_of(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == sorted([base(r) for r in docs.collect()], key=repr)
    assert got.where("kept AND base_failed").isEmpty()
    assert quality.quality(empty).count() == 0


def test_katz(docs, empty, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK", 60_000)
    all_ = [(r.doc_id, [w.lower() for w in words(r.text)] + [b"\0end"]) for r in docs.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    uni, bi, hist = collections.Counter(), collections.Counter(), collections.Counter()
    for i, x in all_:
        if not held(i):
            uni.update(x)
            for h, w in zip([b"\0start", *x], x):
                bi[h, w] += 1
                hist[h] += 1
    n, v = sum(uni.values()), len(uni)
    cc = collections.Counter(bi.values())
    d = katz.discounts([float(cc[r]) for r in range(1, katz.CUT + 2)])
    lost = lambda r: d[r - 1] * r if r <= katz.CUT else r - katz.HALF
    p1 = lambda w: (uni[w] + 1) / (n + v + 1)
    used, mass = collections.Counter(), collections.Counter()
    for (h, w), r in bi.items():
        used[h] += lost(r)
        mass[h] += p1(w)
    alpha = {h: (1 - used[h] / hist[h]) / (1 - mass[h]) for h in hist}
    for h in list(hist)[:20]:  # each history's distribution sums to one, the unknown words' share included
        seen = [w for (a, w) in bi if a == h]
        total = sum(lost(bi[h, w]) / hist[h] for w in seen) + alpha[h] * (1 - sum(p1(w) for w in seen))
        assert abs(total - 1) < 1e-9
    want = collections.defaultdict(list)
    for i, x in all_:
        p = [lost(bi[h, w]) / hist[h] if bi[h, w] else alpha.get(h, 1.0) * p1(w) for h, w in zip([b"\0start", *x], x)]
        want[i].append((len(x), sum(uni[w] > 0 for w in x), sum(math.log10(p1(w)) for w in x), sum(map(math.log10, p))))
    got = collections.defaultdict(list)
    for r in katz.katz_scores(docs).collect():
        assert r.held_out == held(r.doc_id) and r.train_tokens == n
        got[r.doc_id].append((r.n_tokens, r.n_known, r.base_score, r.score))
    assert {k: sorted(x) for k, x in want.items()} == {k: [pytest.approx(y, rel=1e-9, abs=1e-9) for y in sorted(x)] for k, x in got.items()}
    assert katz.katz_scores(empty).count() == 0


def test_minhash(docs, empty):
    sets = {}
    for r in docs.where("doc_id IS NOT NULL").collect():
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(docs)
    assert {r.doc_id: r.class_id for r in got.collect() if r.doc_id is not None} == {k: top(k) for k in sets}
    assert got.count() == docs.count() and minhash.near_duplicates(empty).count() == 0


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 2**63, 60).astype(np.uint64)
    a, b = rng.uniform(0.5, 3, 60), rng.uniform(0.5, 3, 60)
    a[40:], b[:10] = 0, 0
    own = lambda w: minhash.prob_minhash(keys[w > 0], w[w > 0], 4096)
    union = (a > 0) | (b > 0)
    want = sum(1 / sum(max(x / a[i], y / b[i]) if a[i] and b[i] else 0 for x, y in zip(a[union], b[union])) for i in range(60) if a[i] and b[i])
    assert abs((own(a) == own(b)).mean() - want) < 0.04


def test_pii():
    key = b"k" * 32
    text = "card 4539 1488 0343 6467 and 4539148803436467, no 4539148803436468; 1987-03-12 or 12.03.1987; 10.0.255.7; +1 (743) 555-3824; a.b1@mail.example.com; token = \"7c72db563d7f6e50\"; 123-45-6789; GB82 WEST 1234 5698 7654 32"
    out, found = pii.replaced(text, key)
    assert len(out) == len(text) and found == {"card": 2, "date": 2, "ip": 1, "phone": 1, "email": 1, "secret": 1, "ssn": 1, "iban": 1}
    assert "4539148803436468" in out and "4539148803436467" not in out and (out, found) == pii.replaced(text, key)
    a, b = out[5:24].replace(" ", ""), out[29:45]
    assert a == b and pii.luhn(a[:-1]) == int(a[-1])
    assert pii.replaced("nothing 12 here v1.2", key) == ("nothing 12 here v1.2", {})
    assert sorted(pii.permuted(x, 1000, key, "t") for x in range(1000)) == list(range(1000))


def test_pii_frame(docs, empty):
    got = pii.pseudonymised(docs, "key")
    assert got.columns == docs.columns[:-1] + ["pii"] and got.count() == docs.count()
    assert got.where("text IS NULL").count() == docs.where("text IS NULL").count() and pii.pseudonymised(empty, "key").count() == 0


def test_mixing(docs, empty):
    got = mixing.mixture(docs).collect()
    assert len(got) == docs.count() and all(r.taken <= 3 * r["size"] for r in got)
    size = {k: 0 for k in {r.source for r in docs.collect()}}
    for r in docs.collect():
        size[r.source] += len(words(r.text))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, total, full = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in full)
        unit = rest / sum(weight[s] for s in order if s not in full)
        new = {s for s in order if s not in full and unit * weight[s] > 3 * size[s]}
        if not new:
            break
        full |= new
    target = {s: 3 * size[s] if s in full else unit * weight[s] for s in order}
    by_size = {(r.source_size, round(r.target, 6)) for r in got}
    assert by_size == {(size[s], round(float(target[s]), 6)) for s in order}
    assert rows_of(mixing.mixture(docs)) == rows_of(mixing.mixture(docs))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(len(r.shards) for r in got) and mixing.mixture(empty).count() == 0


def test_splitting_tree_is_hypergeometric(spark):
    quotas = spark.createDataFrame([(0, 30), (1, 10), (2, 0)], "place int, blocks long")
    draws = [{(r.shard, r.place): r.blocks for r in mixing.splitting_tree(quotas, 3, seed).collect()} for seed in range(30)]
    for d in draws:
        assert [sum(d[s, p] for s in range(3)) for p in range(3)] == [30, 10, 0]
    assert abs(np.mean([d[0, 0] for d in draws]) - 9.75) < 1.2


def test_html():
    page = "<html><body><header>Site <a href=/>Home</a></header><nav><a href=a>One</a></nav><div id='cookie-notice'>We use cookies, please accept them all now.</div><article><h1>A &amp; B</h1><p>First  part, which is\nlong enough.<p>Second<b>bold</b> part.<script>x='</p>'</script></article><div class='sidebar'><p>Other things that are not part of it, really.</p></div><section id=comments><p>I liked it a lot, thank you for this.</p></section><footer>&copy; x</footer></body></html>"
    assert html.main_text(page) == "A & B First part, which is long enough. Secondbold part."
    assert [html.main_text(x) for x in (None, "", "<div>", "plain", "<p>a < b")] == ["", "", "", "plain", "a < b"]


def test_max_flow():
    edges = [(0, 1, 3.0, 0.0), (0, 2, 2.0, 0.0), (1, 2, 1.0, 1.0), (1, 3, 2.0, 0.0), (2, 3, 4.0, 0.0)]
    side = html.source_side(4, edges, 0, 3)
    assert sum(c for u, v, c, _ in edges if side[u] and not side[v]) == 5.0 and side[0] and not side[3]


def test_audio(docs, empty):
    stored = audio.media(docs)
    text = collections.defaultdict(list)
    for r in docs.collect():
        text[r.doc_id].append((r.text or "").encode())
    for r in audio.digests(stored).collect():
        raw = text[r.doc_id][0]
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload) + 44)
    t = audio.tensors(stored).first()
    assert len(t.log_mel) == audio.FRAMES * audio.MELS and audio.as_tensor(t.log_mel).to_numpy_ndarray().shape == (1, audio.FRAMES, audio.MELS)
    assert audio.digests(audio.media(empty)).count() == 0


def test_resampling():
    x = np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000).astype(np.float32)
    for rate in (8_000, 12_000, 22_050):
        assert np.abs(audio.resampled(x, 16_000, rate) - np.sin(2 * np.pi * 440 * np.arange(rate) / rate))[50:-50].max() < 1e-3


def test_warc(spark):
    rows = [(1, "u\nx", None), (2, "v", "é" * 40_000), (3, "w", "y" * 70_000), (4, "w", "y" * 70_000), (4, "w", "y" * 70_000), (None, "w", "y" * 70_000), (6, None, "\r\n\r\nWARC/1.1\r\n"), (7, "z", "\r\n\r\nWARC/1.1\r\n"), (8, "", "")]
    got = rows_of(warc.round_trip(spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, type string")))
    last = {"y" * 70_000: 4, "é" * 40_000: 2}
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = i is not None and last.get(h, i) != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[h] if again else None))
    assert got == sorted(want, key=repr)


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, d)
        assert at.columns == docs.columns
    out = corpus_pipeline.run(spark, d)
    t = Tokenizer.from_file(FILE)
    kept = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    for r in out.collect():
        assert r.doc_id in kept and list(r.token_ids) == t.encode(r.text, add_special_tokens=False).ids
