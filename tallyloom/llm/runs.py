"""Periodic runs of words: segments split by rare words until none is rare, then a scan of lags in what survives.

A run is a stretch of consecutive words with smallest period q and at least max(least, times * q) words that no neighbouring
word extends with that period. Each of its words occurs times or more often in it. So a word that occurs less often in a
segment is in none of the segment's runs, and its places split the segment; the parts are counted anew, until no
part has such a word or it is too short. In a part that survives, a lag p can be a period only if three multiples of p
that follow each other meet their words p places later, since a run's pairs at lag p span 3 p places or more. So a lag
looks at every p-th word alone, and what is found is extended to both sides. A stretch that was found for a divisor of
its lag is that run. Time is about n log n for n words, beside the lengths of the runs.

Null and empty texts have no words and no runs. Words are runs of bytes between white space (the bytes space and \\t to \\r),
compared by all their bytes. Very long texts are read whole, in one task, as one value has to be. Runs that overlap are runs each. Repeated rows get
a row each, and so do rows without a doc_id. Without documents the result is empty. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean_session, text_or_empty

LEAST, TIMES = 6, 4
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: Bytes of texts that one result batch is made of, or one text.
BATCH = 4 << 20

Run = tuple[int, int, int]


def parts(inside: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The stretches of true values that are least long or longer."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return [(int(a), int(b)) for a, b in edge.reshape(-1, 2) if b - a >= least]


def segments(code: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Stretches of word numbers that hold all runs, and in which each word occurs times or more often. -1 is in no run."""
    todo, stable = parts(code >= 0, least), []
    while todo:
        a, b = todo.pop()
        _, own, n = np.unique(code[a:b], return_inverse=True, return_counts=True)
        if n.min() >= times:
            stable.append((a, b))
        else:
            todo += [(a + x, a + y) for x, y in parts(n[own] >= times, least)]
    return stable


def stretch(x: np.ndarray, lag: int, at: int) -> tuple[int, int]:
    """The places around at, from the first to beyond the last, whose words come again lag places later."""
    end, step = at + 1, 16
    while end < len(x) - lag:
        stop = min(len(x) - lag, end + step)
        other = x[end:stop] != x[end + lag : stop + lag]
        if other.any():
            end += int(other.argmax())
            break
        end, step = stop, step * 4
    start, step = at, 16
    while start > 0:
        stop = max(0, start - step)
        other = (x[stop:start] != x[stop + lag : start + lag])[::-1]
        if other.any():
            start -= int(other.argmax())
            break
        start, step = stop, step * 4
    return start, end


def lag_scan(x: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """The runs (start, length, period) of a segment."""
    found: dict[tuple[int, int], int] = {}
    period, until = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)  # of the first run that was found at a place
    for lag in range(1, len(x) // times + 1):
        every = x[::lag]
        same = every[1:] == every[:-1]
        for at in (lag * np.flatnonzero(same[2:] & same[1:-1] & same[:-2])).tolist():
            if period[at] and lag % period[at] == 0 and until[at] > at + 3 * lag:
                continue
            start, end = stretch(x, lag, at)
            end += lag
            if end - start >= max(least, times * lag) and (start, end) not in found:
                found[start, end] = lag
                new = period[start:end] == 0
                period[start:end][new], until[start:end][new] = lag, end
    return [(a, b - a, p) for (a, b), p in found.items()]


def runs_of(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs, by start and period. times is 3 or more, so that three multiples of a lag are inside its pairs."""
    number = {w: i for i, w in enumerate(w for w, n in Counter(words).items() if n >= times)}
    if not number:
        return []
    code = np.fromiter((number.get(w, -1) for w in words), np.int64, len(words))
    found = [(a + s, n, p) for a, b in segments(code, least, times) for s, n, p in lag_scan(code[a:b], least, times)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[Run]) -> bytes:
    """The words without repeats: a run keeps its first period."""
    if not found:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep).tolist())


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each document. runs: (start, length, period), by start and period; collapsed: the words that stay, joined by one space."""
    if times < 4:
        raise ValueError("times is 4 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            first, size, out = 0, 0, []
            for i, text in enumerate(texts):
                raw = text.as_py()
                words = raw.split()
                found = runs_of(words, least, times)
                out.append((len(words), [{"start": s, "length": n, "period": p} for s, n, p in found], collapsed(words, found).decode()))
                size += len(raw)
                if size >= BATCH or i + 1 == len(texts):
                    n, r, c = zip(*out)
                    yield pa.RecordBatch.from_arrays([ids[first : i + 1], pa.array(n, pa.int64()), pa.array(r, RUNS), pa.array(c, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
                    first, size, out = i + 1, 0, []

    lean_session(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equals that with the least start, then period. Null without runs."""
    nothing = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, nothing, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def digests(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and hashes of what periodic_runs() gives."""
    x = found.withColumn("_best", strongest(F.col("runs")))
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(said, F.lit("\n"))).otherwise("")
    return x.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period", F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where every tenth text, by a hash of its doc_id, repeats itself from some word on, as the contract of the registered query has it. Rows without a doc_id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    x = docs.select("doc_id", text_or_empty().alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    x = x.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    x = x.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    x = x.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    cycle = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    again = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(cycle, F.lit(1), rest)), " ")
    return x.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))
