"""Quality rules: how far a document's characters and common words lie from its language's reference.

References are taken from the whole corpus, for each language: the shares of eight character classes, and the shares
of its common words (those that make up at least COMMON of its words, so 1 / COMMON at most, and occur LEAST times). A document is compared
with both by Jensen-Shannon distance (base 2, from 0 to 1). Short documents say little, so each distance counts only
from a minimum length on, and gets an allowance that shrinks with the square root of the length.

Words are the runs between the bytes space and \\t to \\r; keys of words, lines and windows have 64 bits.
Null or empty texts have no words and fail the base rule. A null language is a language of its own, and so is an empty one. Very long
texts are counted whole; without documents the result is empty. Repeated rows are judged alike; other columns are not read.

What a language's own reference says counts by its evidence: with W words of the language, it weighs W / (W + EVIDENCE), and
the rest is the reference of what the document resembles most by words, out of the NEAREST largest other languages and the whole
corpus. So a code that is seldom used is judged almost by what it resembles, and a language that resembles no other comes to be its own measure by degrees, some
thousand words on. From SURE words on, where the rest weighs a thousandth at most, it is left out. References of languages with SURE
words and LANGUAGE_SHARE of all words (1 / LANGUAGE_SHARE at most), or of the NEAREST largest, are sent to all tasks; those of other languages
are joined by language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import doc_id, id_kind, lean_session, stored, text_or_empty

COMMON, LANGUAGE_SHARE = 0.005, 0.001
LEAST, EVIDENCE, SURE, NEAREST = 5, 100, 100_000, 16
MIN_CHARS, MIN_WORDS = 200, 40
#: A distance may reach MAX + ALLOW / sqrt(characters or words of letters).
MAX_CLASS, MAX_WORD, ALLOW = 0.19, 0.14, 1.8

#: Classes 0 lower-case, 1 upper-case, 2 digit, 3 white space, 4 stop mark, 5 other mark, 6 symbol, 7 beyond ASCII.
CLASS = np.array([7 if b >= 128 else 0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if K.SPACE[b] else 4 if chr(b) in ".,;:?'\"()-" else 6 if chr(b) in "#*$%&|<>" else 5 for b in range(256)], np.uint8)
SYMBOL = CLASS == 6
CONTINUES = (np.arange(256) & 0xC0) == 0x80

FEATURES = "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, common array<long>, n_letter_words long, word_ref array<double>"
#: The language that a reference is of (None: the whole corpus), sorted keys of its common words, and their shares and that of the other words.
Reference = tuple[str | None, np.ndarray, np.ndarray]


def counted(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """How often each of the common keys is among own, and at the end how often none."""
    own = own.view(common.dtype)
    if not len(common):
        return np.array([len(own)])
    place = np.minimum(np.searchsorted(common, own), len(common) - 1)
    hit = common[place] == own
    return np.append(np.bincount(place[hit], minlength=len(common)), len(own) - hit.sum())


def apart(counts: np.ndarray, shares: np.ndarray) -> float:
    """The square of divergence(), to find the nearest reference."""
    p = counts / max(1, counts.sum())
    both = p + shares
    return float(sum((x[x > 0] * np.log2(2 * x[x > 0] / both[x > 0])).sum() for x in (p, shares)))


def blended(own: Reference, other: Reference, weight: float) -> Reference:
    """own by its weight, and other for the rest; what is no common word of one is among its other words."""
    keys = np.union1d(own[1].view(np.uint64), other[1].view(np.uint64))
    shares = np.zeros(len(keys))
    for r, w in ((own, weight), (other, 1 - weight)):
        shares[np.searchsorted(keys, r[1].view(np.uint64))] += w * r[2][:-1]
    return own[0], keys, np.append(shares, 1 - shares.sum())


def features(data: np.ndarray, off: np.ndarray, refs: list[Reference | tuple[Reference, float, list[Reference]]]) -> dict[str, object]:
    """Counts of a slice of texts, as columns. refs: for each text its reference, or one, its weight, and the others that it is blended with one of, the first for short texts."""
    n = len(off) - 1
    code_point = ~CONTINUES[data]
    start, end, of = K.spans(data, off, K.SPACE)
    word = K.keys(data, start, end)
    at, window = K.windows(word, of, 8)
    again, _ = K.repeated(of[at], window)
    covered = np.zeros(len(word) + 1, np.int64)
    np.add.at(covered, at[again], 1)
    np.add.at(covered, at[again] + 8, -1)
    ls, le, lo = K.spans(data, off, K.NEWLINE)
    has_word = np.add.reduceat(~K.SPACE[np.append(data, 32)], ls) > 0 if len(ls) else np.zeros(0, bool)
    ls, le, lo = ls[has_word], le[has_word], lo[has_word]
    _, earlier = K.repeated(lo, K.keys(data, ls, le))
    counts = np.stack([K.per_text((CLASS[data] == c) & code_point, off) for c in range(8)], axis=1)
    lower = K.LOWER[data]
    s, e, letters_of = K.spans(lower, off, K.NOT_LETTER)
    letters = K.keys(lower, s, e)
    n_letters = np.bincount(letters_of, minlength=n)
    first = np.concatenate(([0], np.cumsum(n_letters)))
    hist: list[np.ndarray] = []
    shares: list[np.ndarray | None] = []
    for i, ref in enumerate(refs):
        words = letters[first[i] : first[i + 1]]
        if len(ref) == 3 and isinstance(ref[1], float):
            own, weight, near = ref
            best = near[0]
            if len(words) >= MIN_WORDS and len(near) > 1:
                best = min(near, key=lambda r: apart(counted(words, r[1]), r[2]))
            ref = blended(own, best, weight)
            shares.append(ref[2])
        else:
            shares.append(None)
        hist.append(counted(words, ref[1]))
    return {
        "n_words": np.bincount(of, minlength=n), "word_chars": K.per_text(code_point & ~K.SPACE[data], off), "n_symbols": K.per_text(SYMBOL[data], off), "n_dup_lines": np.bincount(lo[earlier], minlength=n),
        "n_repeat_words": np.bincount(of[np.cumsum(covered[:-1]) > 0], minlength=n), "classes": list(counts), "common": hist, "n_letter_words": n_letters, "word_ref": shares,
    }


def featured(texts: DataFrame, sent: dict[str, Reference], others: list[Reference]) -> DataFrame:
    """A row of FEATURES for each of texts (doc_id, lang, text), by the reference of its language; or (..., keys, shares, total), by its own reference blended with one of others."""
    blend = "keys" in texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs = batch.column(0), batch.column(1).to_pylist()
            refs: list = []
            if blend:
                for lang, keys, shares, total in zip(langs, *(batch.column(k).to_pylist() for k in (3, 4, 5))):
                    near = [r for r in others if r[0] != lang]
                    refs.append(((lang, np.array(keys or [], np.int64), np.array(shares or [0.0])), (total or 0) / ((total or 0) + EVIDENCE), near))
            else:
                refs = [sent[lang] for lang in langs]
            for a, b, data, off in K.slices(batch.column(2)):
                x = features(data, off, refs[a:b])
                kinds = {"classes": pa.list_(pa.int64()), "common": pa.list_(pa.int64()), "word_ref": pa.list_(pa.float64())}
                yield pa.RecordBatch.from_pydict({"doc_id": ids[a:b], "lang": pa.array(langs[a:b], pa.string())} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in x.items()})

    return texts.mapInArrow(run, f"doc_id {id_kind(texts)}, {FEATURES}")


def language() -> Column:
    """A language's name with a letter before it; the empty string is for null."""
    return F.coalesce(F.concat(F.lit("l"), F.col("lang").cast("string")), F.lit(""))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n): the words of letters of each language, ASCII lower-cased."""
    text = F.translate(text_or_empty(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select(language().alias("lang"), F.explode(F.split(text, r"[\x00-@\[-`{-\x7f]+")).alias("word")).where("word <> ''")
    return stored(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "word-counts")


def languages(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, total): each language and its words."""
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    found = docs.select(language().alias("lang")).distinct().join(totals, "lang", "left")
    return stored(found.select("lang", F.coalesce(F.col("total"), F.lit(0).cast("long")).alias("total")), "languages")


def keyed(words: DataFrame) -> DataFrame:
    """(lang, n, total, key) of (lang, n, total, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in K.slices(batch.column(3)):
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[:3]), pa.array(K.keys(data, off[:-1], off[1:]).view(np.int64))], ["lang", "n", "total", "key"])

    return words.select("lang", "n", "total", "word").mapInArrow(run, "lang string, n long, total long, key long")


def reference(name: str | None, found: list[tuple[str, int]], total: int) -> Reference:
    """found: the common words and their counts."""
    raw = [w.encode() for w, _ in found]
    off = np.cumsum([0, *map(len, raw)])
    found = sorted(zip(K.keys(np.frombuffer(b"".join(raw), np.uint8), off[:-1], off[1:]).tolist(), (n for _, n in found))) if found else []
    return name, np.array([k for k, _ in found], np.uint64), np.array([n / total for _, n in found] + [1 - sum(n for _, n in found) / max(1, total)])


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts or shares of one length; 0 if either is empty."""

    def shares(x: Column) -> Column:
        total = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
        return F.transform(x, lambda v: F.when(total > 0, v / total).otherwise(0.0))

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0) / 2

    each = F.zip_with(shares(p), shares(q), lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))))


def judged(both: DataFrame) -> DataFrame:
    """The result of features with word_ref and class_ref."""
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda acc, v: acc + v)
    rows = both.withColumns({
        "class_distance": F.when(chars >= MIN_CHARS, divergence(F.col("classes"), F.col("class_ref"))),
        "word_distance": F.when(F.col("n_letter_words") >= MIN_WORDS, divergence(F.col("common"), F.col("word_ref"))),
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    })
    far = (F.coalesce(F.col("class_distance"), F.lit(0.0)) > MAX_CLASS + ALLOW / F.sqrt(chars)) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > MAX_WORD + ALLOW / F.sqrt(F.col("n_letter_words")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance", "n_letter_words", F.when(F.col("lang") != "", F.expr("substring(lang, 2)")).alias("lang"))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, the two distances and kept, for each document."""
    lean_session(docs.sparkSession)
    texts = docs.select(doc_id(docs), language().alias("lang"), text_or_empty().alias("text"))
    counts = word_counts(docs)
    langs = languages(docs, counts)
    n_langs, n_all = (x or 0 for x in langs.agg(F.count(F.lit(1)), F.sum("total")).first())
    largest = [r.lang for r in langs.where("total > 0").orderBy(F.desc("total"), "lang").limit(NEAREST).collect()]
    sure = (F.col("total") >= SURE) & ((F.col("total") >= LANGUAGE_SHARE * n_all) | F.col("lang").isin(largest))
    known = langs.where(sure | F.col("lang").isin(largest))  # at most 1 / LANGUAGE_SHARE + NEAREST
    totals = {r.lang: r.total for r in known.collect()}

    def common(some: DataFrame) -> DataFrame:
        return counts.join(some.select("lang", "total"), "lang").where((F.col("n") >= COMMON * F.col("total")) & (F.col("n") >= LEAST))

    words: dict[str, list[tuple[str, int]]] = {k: [] for k in totals}
    for r in common(known).collect():  # at most 1 / COMMON for each language
        words[r.lang].append((r.word, r.n))
    own = {k: reference(k, v, totals[k]) for k, v in words.items()}
    sent = {r.lang: own[r.lang] for r in langs.where(sure).select("lang").collect()}
    sums = F.array(*[F.sum(F.col("classes")[c]) for c in range(8)]).alias("class_ref")
    few = len(sent) < n_langs  # languages whose reference is blended, or joined
    first = texts.where(F.col("lang").isin(list(sent))) if few else texts
    seen = stored(featured(first, sent, []), "features")
    refs = docs.sparkSession.createDataFrame([(k, r[2].tolist()) for k, r in sent.items()], "of string, shares array<double>").join(seen.groupBy(F.col("lang").alias("of")).agg(sums), "of")
    out = judged(seen.join(F.broadcast(refs), F.col("lang") == F.col("of")).withColumn("word_ref", F.col("shares")))
    if not few:
        return out
    pool = reference(None, [(r.word, r.n) for r in counts.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= COMMON * n_all) & (F.col("n") >= LEAST)).collect()], n_all)
    others = [pool, *(blended(own[k], pool, totals[k] / (totals[k] + EVIDENCE)) for k in largest)]
    rare = langs.where(~F.col("lang").isin(list(sent)))
    listed = F.sort_array(F.collect_list(F.struct("key", "n")))
    found = rare.join(keyed(common(rare)).groupBy("lang").agg(listed.alias("found")), "lang", "left").withColumn("found", F.coalesce("found", F.expr("CAST(array() AS array<struct<key: bigint, n: bigint>>)")))
    share = F.transform("found", lambda x: x["n"] / F.col("total"))
    rest = 1 - F.aggregate(share, F.lit(0.0), lambda acc, x: acc + x)
    rare_refs = stored(found.select("lang", F.col("found.key").alias("keys"), F.concat(share, F.array(rest)).alias("shares"), "total"), "references")
    rare_seen = stored(featured(texts.join(rare_refs, "lang").select(*texts.columns, "keys", "shares", "total"), sent, others), "rare-features")
    everything = seen.select("classes").unionByName(rare_seen.select("classes")).agg(sums.alias("all"))
    shares = lambda c: F.transform(c, lambda v: v / F.greatest(F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x), F.lit(1)))
    weight = F.col("total") / (F.col("total") + EVIDENCE)
    classes = rare_refs.select("lang", "total").join(rare_seen.groupBy("lang").agg(sums), "lang").crossJoin(F.broadcast(everything))  # a single row
    classes = classes.select("lang", F.zip_with(shares(F.col("class_ref")), shares(F.col("all")), lambda a, b: weight * a + (1 - weight) * b).alias("class_ref"))
    return out.unionByName(judged(rare_seen.join(classes, "lang", "left")))
