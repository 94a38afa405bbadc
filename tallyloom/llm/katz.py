"""Katz backoff: Good-Turing discounted bigrams with exactly normalised backoff weights, in partitioned tables.

Tokens are the words of the ASCII lower-cased text and one end. Training documents are those whose crc32(doc_id as
text) mod FOLDS is not HELD_OUT. The unigram level is (c + 1) / (N + V + 1), with one share for all unknown words. A
bigram seen r times has its count multiplied by the Good-Turing discount d_r up to r = CUT; above, counts lose HALF, so
that every history keeps some mass for words that it was never seen with. The backoff weight of a history is that mass
over the unigram mass of the words not seen after it, so each history's distribution sums to one. A token is evaluated
recursively: the bigram if it was seen, else the weight times the unigram, which is all there is for a new history.

Documents are dealt to chunks of about CHUNK bytes by a hash of doc_id and text. A chunk asks for the counts of its distinct
words, then of its distinct pairs: the requests, sorted arrays, are shuffled by word or pair to buckets, which add them
up, write the tables (partitions kind=word and kind=pair) and send each chunk the sums it asked for. Nothing but distinct
entries leaves a chunk, so a hot word or line costs one entry for each chunk. Histories with at least N / share tokens,
where share is 4 * buckets or HOT if that is less, are spread over all buckets. There are share of them at most, so HOT;
their sums, of about 80 bytes each, pass through the driver, so that buckets send a chunk those of the others alone. Words are known by 64-bit keys, and by ids of 32 bits as long
as these suffice.

Null texts are empty: one end. A null doc_id counts as the empty text in the fold rule. Repeated rows count each time and
get a row each; they are dealt to one chunk. A text that is longer than a chunk is in one chunk as a whole. Equal counts
rank words by their keys. Without documents the result is empty. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import lean_session, shared_dir, text_or_empty

FOLDS, HELD_OUT, CUT, HALF, CHUNK, HOT = 7, 2, 5, 0.5, 13 << 20, 1 << 16
NEEDED, IS_HOT = 1, 2  # of a history that a chunk asks about: its weight is needed in any case; its sums come from elsewhere
U = np.uint64
END, START = np.uint64(0x0123456789ABCDEF), -1
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


@dataclass
class Model:
    """Tables of counts, and the few numbers that turn them into probabilities."""

    path: str
    train_tokens: int
    vocabulary: int
    discounts: list[float]

    def words(self, spark: SparkSession) -> DataFrame:
        """(bucket, key, n)"""
        rows = spark.read.parquet(f"{self.path}/words/kind=word")
        return rows.select("bucket", F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("counts").alias("n"))).alias("x")).select("bucket", "x.key", "x.n")

    def pairs(self, spark: SparkSession) -> DataFrame:
        """(bucket, history, word, n): ids as the word answers give them; the history of a first word is -1."""
        rows = spark.read.parquet(f"{self.path}/pairs/kind=pair")
        return rows.select("bucket", F.explode(F.arrays_zip(F.col("histories").alias("history"), F.col("ids").alias("word"), F.col("counts").alias("n"))).alias("x")).select("bucket", "x.*")


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each value's number among them. As np.unique, but in less memory: values are sorted in place."""
    order = np.argsort(values).astype(np.int32)
    values[:] = values[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    inverse = np.empty(len(values), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return values[new], inverse


class Chunk:
    """The tokens of a chunk of documents: local numbers of words, and where each document begins."""

    def __init__(self, table: pa.Table, buckets: int):
        self.rows = table.num_rows
        found, numbers, sizes = [], [], [np.zeros(0, np.int64)]
        for text in table["text"].chunks:
            for _, _, data, off in K.slices(text):
                lower = K.LOWER[data]
                start, end, of = K.spans(lower, off, K.SPACE)
                n = len(off) - 1
                key = np.empty(len(start) + n, U)
                key[np.arange(len(start)) + of] = K.keys(lower, start, end)  # each document's end comes after its words
                size = np.bincount(of, minlength=n) + 1
                key[np.cumsum(size) - 1] = END
                word, number = numbered(key)
                found.append(word)
                numbers.append(number)
                sizes.append(size)
        word, number = numbered(np.concatenate(found))
        part = (word % U(buckets)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        number = place[number]
        self.words, self.part = word[order], part[order]
        self.size = np.concatenate(sizes)
        self.first = np.cumsum(self.size) - self.size
        self.word = np.empty(int(self.size.sum()), np.int32)
        at = seen = 0
        for own, x in zip(found, numbers):
            self.word[at : at + len(x)] = number[seen : seen + len(own)][x]
            at, seen = at + len(x), seen + len(own)
        self.train = ~table["held_out"].to_numpy()

    def trained(self, number: np.ndarray, n: int) -> np.ndarray:
        """How often each of n numbers occurs in training documents, from the numbers of all tokens."""
        return np.bincount(number[np.repeat(self.train, self.size)], minlength=n)

    def by_document(self, value: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Each document's sum of value[number] over its tokens."""
        return np.add.reduceat(value[number], self.first, dtype=np.float64 if value.dtype == np.float64 else np.int64)

    def cuts(self, part: np.ndarray, buckets: int) -> np.ndarray:
        return np.searchsorted(part, np.arange(buckets + 1))


class Pairs:
    """A chunk's distinct pairs, as local numbers of history and word, in the order of its requests; those that can have no count come last.

    Whatever depends on one word alone is kept by word; a history of START is the last entry.
    """

    def __init__(self, chunk: Chunk, ids: np.ndarray, counts: np.ndarray, train_tokens: int, end_count: int, buckets: int, share: int):
        n = len(chunk.words) + 1
        code = np.empty(len(chunk.word), np.int64)
        code[1:] = chunk.word[:-1]
        code[chunk.first] = START
        code += 1
        code *= n
        code += chunk.word
        code, self.inverse = numbered(code)
        self.h, self.w = (code // n - 1).astype(np.int32), (code % n).astype(np.int32)
        del code
        self.id, self.count = np.append(ids, START), np.append(counts, end_count)
        self.hot = self.count * share >= train_tokens
        own = np.where(self.count > 0, (K.mix((self.id + 1).astype(U)) % U(buckets)).astype(np.int32), np.int32(buckets))
        bucket = own[self.h]
        hot = np.flatnonzero((self.hot & (self.count > 0))[self.h])
        bucket[hot] = K.mix((self.id[self.h[hot]] + 1).astype(U) + self.id[self.w[hot]].astype(U) * K.STEP) % U(buckets)
        # A known history with an unknown word asks for no count, but for the history's weight.
        self.order = np.argsort(bucket.astype(np.uint16) if buckets < 65_535 else bucket, kind="stable").astype(np.int32)
        self.cut = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets + 1))))

    def of(self, bucket: int) -> np.ndarray:
        """The pairs of a bucket; those of unknown histories are those of the bucket after the last."""
        return self.order[self.cut[bucket] : self.cut[bucket + 1]]


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    off = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat).cast(kind))


def stats_of(h_of_pair: np.ndarray, n: int, counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """For each history: how many pairs it has with count 1 to CUT, the discounted sum above, and the unigram mass of its words."""
    out = np.zeros((n, CUT + 2))
    for r in range(1, CUT + 1):
        out[:, r - 1] = np.bincount(h_of_pair[counts == r], minlength=n)
    big = counts > CUT
    out[:, CUT] = np.bincount(h_of_pair[big], weights=counts[big] - HALF, minlength=n)
    seen = counts > 0
    out[:, CUT + 1] = np.bincount(h_of_pair[seen], weights=share[seen], minlength=n)
    return out


def discounts(count_of_counts: list[float]) -> list[float]:
    """d_1 to d_CUT from the numbers of pairs seen once to CUT + 1 times; where Good-Turing gives none in (0, 1), 1 - HALF / r."""
    n = [0.0, *count_of_counts]
    out = []
    tail = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 0.0
    for r in range(1, CUT + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        out.append(d if 0 < d < 1 else 1 - HALF / r)
    return out


def weights(stats: np.ndarray, h_count: np.ndarray, d: list[float]) -> np.ndarray:
    """Backoff weights of histories."""
    used = stats[:, :CUT] @ (np.array(d) * np.arange(1, CUT + 1)) + stats[:, CUT]
    return (1 - used / h_count) / (1 - stats[:, CUT + 1])


def katz_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    return scored(docs, *fitted(docs))


def chunked(docs: DataFrame, chunks: int) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    return docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), text_or_empty()), F.lit(chunks)).cast("int").alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), (fold == HELD_OUT).alias("held_out"))


def fitted(docs: DataFrame) -> tuple[Model, dict]:
    """The model, and what scored() needs to ask for its counts."""
    spark = docs.sparkSession
    lean_session(spark)
    path = shared_dir(spark, "katz")
    size = docs.agg(F.sum(F.octet_length(text_or_empty()) + 64)).first()[0] or 0
    chunks = max(1, -(-size // CHUNK))
    buckets = 2 * chunks
    share = min(4 * buckets, HOT)

    def ask_words(table: pa.Table) -> pa.Table:
        c = Chunk(table, chunks)
        n = c.trained(c.word, len(c.words))
        cut = c.cuts(c.part, chunks)
        own = [slice(cut[b], cut[b + 1]) for b in range(chunks) if cut[b + 1] > cut[b]]
        return pa.table({"chunk": pa.array([table["chunk"][0].as_py()] * len(own), pa.int32()), "bucket": pa.array([int(c.part[s.start]) for s in own], pa.int32()), "keys": lists([c.words[s].view(np.int64) for s in own], pa.int64()), "counts": lists([n[s] for s in own], pa.int64())})

    def add_words(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        keys = table["keys"].combine_chunks().flatten().to_numpy().view(U)
        n = table["counts"].combine_chunks().flatten().to_numpy()
        word, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, weights=n, minlength=len(word)).astype(np.int64)
        order = np.argsort(-total, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        length = table["keys"].combine_chunks().value_lengths().to_numpy()
        cut = np.concatenate(([0], np.cumsum(length)))
        own = [inverse[cut[i] : cut[i + 1]] for i in range(len(length))]
        order = order[total[order] > 0]
        return pa.table({
            "kind": ["answer"] * len(own) + ["word"], "bucket": pa.array([bucket] * (len(own) + 1), pa.int32()), "chunk": pa.array([*table["chunk"].to_pylist(), -1], pa.int32()), "keys": lists([*[np.zeros(0, np.int64)] * len(own), word[order].view(np.int64)], pa.int64()),
            "ids": lists([*[rank[x] * chunks + bucket for x in own], np.zeros(0, np.int64)], pa.int64()), "counts": lists([*[total[x] for x in own], total[order]], pa.int64()),
        })

    dealt = chunked(docs, chunks)
    asked = dealt.groupBy("chunk").applyInArrow(ask_words, "chunk int, bucket int, keys array<long>, counts array<long>")
    word_schema = "kind string, bucket int, chunk int, keys array<long>, ids array<long>, counts array<long>"
    asked.groupBy("bucket").applyInArrow(add_words, word_schema).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/words")
    words = spark.read.schema(word_schema).parquet(f"{path}/words")
    n, v, end, most = words.where("kind = 'word'").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)), F.sum(F.size("counts")), F.sum(F.element_at("counts", F.when(F.array_position("keys", int(END.view(np.int64))) > 0, F.array_position("keys", int(END.view(np.int64)))).cast("int"))), F.max(F.size("counts"))).first()
    n, v, end = n or 0, v or 0, end or 0
    id_type, slim = ("int", pa.int32()) if ((most or 0) + 1) * chunks < 2**31 else ("long", pa.int64())
    count_type = "int" if n < 2**31 else "long"
    narrow = pa.int32() if count_type == "int" else pa.int64()

    def ask_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        c, p = asked_pairs(left, by_bucket(right), chunks, buckets, n, end, share)
        ids, counts = p.id.astype(slim.to_pandas_dtype()), p.count.astype(narrow.to_pandas_dtype())
        n_train = c.trained(p.inverse, len(p.h)).astype(narrow.to_pandas_dtype())
        rows: dict[str, list] = {k: [] for k in ("bucket", "h", "need", "length", "w", "wc", "n")}
        for b in range(buckets):
            at = p.of(b)
            if not len(at):
                continue
            first, length, need = histories(p, at)
            live = at[p.count[p.w[at]] > 0]
            for k, x in zip(rows, (b, ids[p.h[at[first]]], np.where(p.hot[p.h[at[first]]], IS_HOT, need * NEEDED).astype(np.int8), length.astype(np.int32), ids[p.w[live]], counts[p.w[live]], n_train[live])):
                rows[k].append(x)
        return pa.table({"chunk": pa.array([left["chunk"][0].as_py()] * len(rows["bucket"]), pa.int32()), "bucket": pa.array(rows["bucket"], pa.int32()), "h": lists(rows["h"], slim), "need": lists(rows["need"], pa.int8()), "length": lists(rows["length"], pa.int32()), "w": lists(rows["w"], slim), "wc": lists(rows["wc"], narrow), "n": lists(rows["n"], narrow)})

    def add_pairs(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        col = {k: table[k].combine_chunks() for k in ("h", "need", "length", "w", "wc", "n")}
        h, need, length = col["h"].flatten().to_numpy().astype(np.int64), col["need"].flatten().to_numpy(), col["length"].flatten().to_numpy()
        word, of_word = np.unique(col["w"].flatten().to_numpy(), return_inverse=True)
        history, of_history = np.unique(h, return_inverse=True)
        code, inverse = np.unique(np.repeat(of_history, length) * max(1, len(word)) + of_word, return_inverse=True)
        total = np.bincount(inverse, weights=col["n"].flatten().to_numpy(), minlength=len(code)).astype(np.int64)
        word_count = np.zeros(len(code), np.int64)
        word_count[inverse] = col["wc"].flatten().to_numpy()
        at_h = code // max(1, len(word))
        pair_h, pair_w = history[at_h], word[code % max(1, len(word))]
        stats = stats_of(at_h, len(history), total, (word_count + 1) / (n + v + 1))
        answers, sent = [], []
        h_at = w_at = 0
        for rows, pairs in zip(col["h"].value_lengths().to_numpy(), col["w"].value_lengths().to_numpy()):
            own = total[inverse[w_at : w_at + pairs]]
            zero = np.bincount(np.repeat(np.arange(rows), length[h_at : h_at + rows])[own == 0], minlength=rows) > 0
            own_need = need[h_at : h_at + rows]
            lack = (zero | (own_need == NEEDED)) & (own_need != IS_HOT)
            answers.append(own)
            sent.append(stats[of_history[h_at : h_at + rows][lack]].ravel())
            h_at, w_at = h_at + rows, w_at + pairs
        seen = total > 0
        numbers = np.bincount(np.minimum(total[seen], CUT + 2), minlength=CUT + 3)[1 : CUT + 2].astype(float)
        hot = np.unique(of_history[need == IS_HOT])
        none, m = np.zeros(0, np.int64), len(answers)
        return pa.table({
            "kind": ["answer"] * m + ["pair", "history"], "bucket": pa.array([bucket] * (m + 2), pa.int32()), "chunk": pa.array([*table["chunk"].to_pylist(), -1, -1], pa.int32()), "histories": lists([*[none] * m, pair_h[seen], history[hot]], slim), "ids": lists([*[none] * m, pair_w[seen], none], slim),
            "counts": lists([*answers, total[seen], none], narrow), "stats": lists([*sent, numbers, stats[hot].ravel()], pa.float64()),
        })

    requests = dealt.groupBy("chunk").cogroup(words.where("kind = 'answer'").select("chunk", "bucket", "ids", F.col("counts").cast(f"array<{count_type}>").alias("counts")).groupBy("chunk")).applyInArrow(ask_pairs, f"chunk int, bucket int, h array<{id_type}>, need array<byte>, length array<int>, w array<{id_type}>, wc array<{count_type}>, n array<{count_type}>")
    pair_schema = f"kind string, bucket int, chunk int, histories array<{id_type}>, ids array<{id_type}>, counts array<{count_type}>, stats array<double>"
    requests.groupBy("bucket").applyInArrow(add_pairs, pair_schema).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/pairs")
    pairs = spark.read.schema(pair_schema).parquet(f"{path}/pairs")
    numbers = pairs.where("kind = 'pair'").agg(*[F.sum(F.col("stats")[r]) for r in range(CUT + 1)]).first()
    d = discounts([x or 0.0 for x in numbers])
    # Sums of the hot histories, share + 1 at most; a history is hot for all chunks or for none.
    hot = hot_histories(pairs)
    return Model(path, n, v, d), {"chunks": chunks, "buckets": buckets, "share": share, "end": end, "hot": hot, "words": words, "pairs": pairs, "counts": f"array<{count_type}>"}


def hot_histories(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the hot histories, in order, and their sums over all buckets."""

    def split(batches):
        for batch in batches:
            for h, x in zip(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_pydict({"h": h.values.cast(pa.int64()), "s": pa.array(list(x.values.to_numpy().reshape(-1, CUT + 2)), pa.list_(pa.float64()))})

    parts = pairs.where("kind = 'history'").select("histories", "stats").mapInArrow(split, "h long, s array<double>")
    sums = sorted((r.h, r.s) for r in parts.groupBy("h").agg(F.array(*[F.sum(F.col("s")[k]) for k in range(CUT + 2)]).alias("s")).collect())
    return np.array([h for h, _ in sums], np.int64), np.array([x for _, x in sums]).reshape(-1, CUT + 2)


def by_bucket(table: pa.Table) -> dict[int, dict[str, np.ndarray]]:
    """The lists of each bucket's answer, as views of its columns."""
    names = [x for x in ("ids", "counts", "stats") if x in table.column_names]
    out = {}
    for batch in table.to_batches():
        for i, b in enumerate(batch.column("bucket").to_pylist()):
            lists_of = {x: batch.column(x)[i].values for x in names}
            out[b] = {k: x.to_numpy() for k, x in lists_of.items() if x is not None}
    return out


def asked_pairs(left: pa.Table, answers: dict[int, dict[str, np.ndarray]], chunks: int, buckets: int, n: int, end: int, share: int) -> tuple[Chunk, Pairs]:
    """A chunk's tokens and pairs, from its documents and the answers about its words."""
    c = Chunk(left, chunks)
    ids, counts = (np.concatenate([answers[b][k] for b in sorted(answers)], dtype=np.int64) for k in ("ids", "counts"))
    return c, Pairs(c, ids, counts, n, end, buckets, share)


def histories(p: Pairs, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of a bucket, which are in runs of one history: where each run begins, its requests, and whether it has an unknown word."""
    h = p.h[at]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    live = (p.count[p.w[at]] > 0).astype(np.int64)
    length = np.add.reduceat(live, first)
    return first, length, np.add.reduceat(1 - live, first) > 0


def pair_logs(p: Pairs, answers: dict[int, dict[str, np.ndarray]], buckets: int, hot: tuple[np.ndarray, np.ndarray], size: int, d: list[float]) -> np.ndarray:
    """The log10 probability of each pair, from the buckets' answers; size is N + V + 1."""
    lost = np.array([0.0, *d])
    out = np.empty(len(p.h))
    for b in range(buckets + 1):
        own = p.of(b)
        if not len(own):
            continue
        w_count = p.count[p.w[own]]
        prob = (w_count + 1) / size
        if b < buckets:
            first, length, need = histories(p, own)
            head = p.h[own[first]]
            counts, stats = answers[b]["counts"], answers[b]["stats"]
            pair = np.zeros(len(own), np.int64)
            pair[w_count > 0] = counts
            lack = need | (np.bincount(np.repeat(np.arange(len(head)), length)[counts == 0], minlength=len(head)) > 0)
            lacking = head[lack]
            s = np.empty((len(lacking), CUT + 2))
            s[~p.hot[lacking]] = stats.reshape(-1, CUT + 2)
            s[p.hot[lacking]] = hot[1][np.searchsorted(hot[0], p.id[lacking[p.hot[lacking]]])]
            weight = np.ones(len(head))
            weight[lack] = weights(s, p.count[lacking], d)
            prob *= np.repeat(weight, np.diff(np.append(first, len(own))))
            kept = np.where(pair > CUT, pair - HALF, lost[np.minimum(pair, CUT)] * pair)
            prob = np.where(pair > 0, kept / p.count[p.h[own]], prob)
        out[own] = np.log10(prob)
    return out


def scored(docs: DataFrame, model: Model, at: dict) -> DataFrame:
    chunks, buckets, share, end, hot, n, v, d = at["chunks"], at["buckets"], at["share"], at["end"], at["hot"], model.train_tokens, model.vocabulary, model.discounts

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        of = lambda kind: by_bucket(right.filter(pc.field("kind") == kind))
        c, p = asked_pairs(left, of("word"), chunks, buckets, n, end, share)
        log = pair_logs(p, of("pair"), buckets, hot, n + v + 1, d)
        count = p.count[:-1]
        base = np.log10((count + 1) / (n + v + 1))
        return pa.table({"doc_id": left["doc_id"], "held_out": left["held_out"], "n_tokens": c.size, "n_known": c.by_document(count > 0, c.word), "base_score": c.by_document(base, c.word), "score": c.by_document(log, p.inverse)})

    to_chunk = at["words"].where("kind = 'answer'").select("chunk", F.lit("word").alias("kind"), "bucket", "ids", F.col("counts").cast(at["counts"]).alias("counts"), F.lit(None).cast("array<double>").alias("stats"))
    to_chunk = to_chunk.union(at["pairs"].where("kind = 'answer'").select("chunk", F.lit("pair"), "bucket", F.lit(None).cast("array<long>"), "counts", "stats"))
    out = chunked(docs, chunks).groupBy("chunk").cogroup(to_chunk.groupBy("chunk")).applyInArrow(score, RESULT)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
