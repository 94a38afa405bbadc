"""Streams: the best-known registry, replays in event order, and running counts of result shards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tallyloom.sources.files import RESULT, condition_of


def stream_best_known(results: DataFrame) -> DataFrame:
    """(instance_id, best_cost, first_cost) of verified results (instance_id, ts, cost, verified); for update or complete mode.

    The state is one row for each instance. first_cost is the cost of the earliest ts, the least cost among ties.
    """
    ok = results.where("verified AND cost IS NOT NULL")
    first = F.min(F.struct("ts", "cost"))
    return ok.groupBy("instance_id").agg(F.min("cost").alias("best_cost"), first.getField("cost").alias("first_cost"))


def unique_results(results: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Results (condition, instance_id, arrived) without repeats of a pair that arrive within the delay; state is dropped after it."""
    return results.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["condition", "instance_id"])


def running_counts(results: DataFrame) -> DataFrame:
    """Rows, sum of scores and valid rows by condition, for update or complete mode."""
    return results.groupBy("condition").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("score").alias("total_score"), F.count_if(F.col("score") > 0).alias("n_valid"))


def stream_results(spark: SparkSession, path: str, delay: str = "1 hour", files_each: int = 1000) -> DataFrame:
    """Rows of new shard files <condition>__shardNNofMM/<file>.json, each pair once; the arrival time is the file's."""
    shards = spark.readStream.schema(f"test struct<results: array<struct<{RESULT}>>>").option("multiLine", True).option("maxFilesPerTrigger", files_each).json(f"{path}/*/*.json")
    x = shards.select(condition_of(F.col("_metadata.file_path")).alias("condition"), F.col("_metadata.file_modification_time").alias("arrived"), F.explode("test.results").alias("r"))
    return unique_results(x.select("condition", "arrived", "r.*"), delay)


HELD = "ts timestamp, row_id long, cost double, verified boolean"
REPLAYED = "instance_id long, ts timestamp, row_id long, cost double, best_before double, first_cost double"


class Replay(StatefulProcessor):
    """Holds an instance's rows until the watermark has passed them, then gives them in order with the best verified cost before each and the first one so far."""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)
        self.known = handle.getValueState("known", "best double, first double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        late, passed = [], pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        for part in rows:
            for r in part.itertuples():
                if r.ts < passed:
                    late.append((r.ts, r.row_id, r.cost, r.verified))
                else:
                    self.held.appendValue((r.ts.to_pydatetime(), int(r.row_id), None if pd.isna(r.cost) else float(r.cost), bool(r.verified)))
                    self.handle.registerTimer(int(r.ts.timestamp() * 1000) + 1)
        if late:  # what comes after its turn is told what was known then and since
            yield self.told(key, sorted(late))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        rows = [tuple(r) for r in self.held.get()]
        ready = sorted(r for r in rows if pd.Timestamp(r[0]) < passed)
        if not ready:
            return
        rest = [r for r in rows if pd.Timestamp(r[0]) >= passed]
        self.held.clear()
        if rest:
            self.held.put(rest)
        yield self.told(key, ready)

    def told(self, key, rows: list[tuple]) -> pd.DataFrame:
        best, first = self.known.get() if self.known.exists() else (None, None)
        out = []
        for ts, row_id, cost, verified in rows:
            before = best
            if verified and cost is not None and not pd.isna(cost):
                best, first = cost if best is None else min(best, cost), cost if first is None else first
            out.append((key[0], ts, row_id, cost, before, first))
        if best is not None:
            self.known.update((best, first))
        return pd.DataFrame(out, columns=["instance_id", "ts", "row_id", "cost", "best_before", "first_cost"])


def stream_replay(results: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Results (instance_id, ts, row_id, cost, verified) in the order of ts and row_id, each with the best verified cost before it and the first one up to it; for append mode.

    Rows may come in any order within the delay. A row that comes later is given at once, with what is known by then. The state of an instance is what the watermark has not
    passed, and two numbers. Needs a state store with timers: spark.sql.streaming.stateStore.providerClass is Spark's RocksDB provider.
    """
    return results.select("instance_id", "ts", "row_id", "cost", "verified").withWatermark("ts", delay).groupBy("instance_id").transformWithStateInPandas(Replay(), REPLAYED, "Append", "EventTime")
