"""Constraint audits: each rule gives violations (instance_id, rule, entity, observed, limit) from long tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.tables import large

RULES: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {}


def audit_rule(name: str):
    """Registers a rule by name."""

    def add(f):
        RULES[name] = f
        return f

    return add


def violations(df: DataFrame, rule: str, entity: str, observed: Column, limit: Column) -> DataFrame:
    return df.select(F.col("instance_id").cast("string").alias("instance_id"), F.lit(rule).alias("rule"), F.col(entity).cast("string").alias("entity"), observed.cast("double").alias("observed"), limit.cast("double").alias("limit"))


def rollup(found: DataFrame, instances: DataFrame, total: int | None = None, keep: int = 6) -> DataFrame:
    """feasible, verified, partial score and the first messages of each instance. Counts are of all violations; only keep messages of an instance are gathered.

    instances: (instance_id) with total constraints each, or with columns total and readable. What is not readable is unverified and feasible, whatever was found.
    """
    n = found.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"))
    said = found.select("instance_id", F.concat_ws(":", "rule", "entity").alias("said")).distinct()
    first = said.withColumn("_k", F.row_number().over(Window.partitionBy("instance_id").orderBy("said"))).where(F.col("_k") <= keep)
    n = n.join(first.groupBy("instance_id").agg(F.array_sort(F.collect_list("said")).alias("m")), "instance_id", "left")
    own = F.col("total") if "total" in instances.columns else F.lit(total if total is not None else 1)
    read = F.coalesce("readable", F.lit(False)) if "readable" in instances.columns else F.lit(True)
    x = instances.select(F.col("instance_id").cast("string").alias("instance_id"), own.cast("long").alias("total"), read.alias("read")).distinct().join(n, "instance_id", "left")
    count = F.when(F.col("read"), F.coalesce("n", F.lit(0))).otherwise(F.lit(0))
    most = F.greatest("total", F.lit(1))
    partial = F.when(F.col("read"), F.greatest(F.col("total") - count, F.lit(0)).cast("double") / most).otherwise(1.0)
    none = F.array().cast("array<string>")
    return x.select(
        "instance_id", (count == 0).alias("feasible"), count.cast("long").alias("violation_count"), partial.alias("partial_score"),
        F.when(F.col("read"), F.coalesce("m", none)).otherwise(none).alias("messages"), F.col("read").alias("verified"), F.col("total").alias("total_constraints"),
    )


@audit_rule("coverage")
def coverage(t: dict[str, DataFrame]) -> DataFrame:
    """required (instance_id, item) and assigned (instance_id, item): each item once; unknown items are violations too."""
    n = t["assigned"].groupBy("instance_id", "item").agg(F.count(F.lit(1)).alias("n"))
    x = t["required"].select("instance_id", "item", F.lit(1).alias("need")).join(n, ["instance_id", "item"], "full_outer")
    return violations(x.where("coalesce(n, 0) <> coalesce(need, 0)"), "coverage", "item", F.coalesce("n", F.lit(0)), F.coalesce("need", F.lit(0)))


@audit_rule("capacity")
def capacity(t: dict[str, DataFrame]) -> DataFrame:
    """loads (instance_id, slot, amount) against limits (instance_id, slot, limit)."""
    s = t["loads"].groupBy("instance_id", "slot").agg(F.sum("amount").alias("s"))
    return violations(s.join(t["limits"], ["instance_id", "slot"]).where("s > limit"), "capacity", "slot", F.col("s"), F.col("limit"))


@audit_rule("overlap")
def overlap(t: dict[str, DataFrame]) -> DataFrame:
    """spans (instance_id, resource, item, t_start, t_end), half open: a start before the latest end so far."""
    w = Window.partitionBy("instance_id", "resource").orderBy("t_start", "t_end", "item").rowsBetween(Window.unboundedPreceding, -1)
    x = t["spans"].withColumn("latest", F.max("t_end").over(w))
    return violations(x.where("t_start < latest"), "overlap", "item", F.col("t_start"), F.col("latest"))


@audit_rule("precedence")
def precedence(t: dict[str, DataFrame]) -> DataFrame:
    """A successor starts when its predecessor has ended: precedence (instance_id, before, after) on spans."""
    s = t["spans"].select("instance_id", "item", "t_start", "t_end")
    a = t["precedence"].join(s.select("instance_id", F.col("item").alias("before"), F.col("t_end").alias("e")), ["instance_id", "before"])
    x = a.join(s.select("instance_id", F.col("item").alias("after"), "t_start"), ["instance_id", "after"])
    return violations(x.where("t_start < e"), "precedence", "after", F.col("t_start"), F.col("e"))


def peak_usage(spans: DataFrame) -> DataFrame:
    """(instance_id, peak) of spans with usage, by sweeping events; ends come before starts at equal times."""
    up = spans.select("instance_id", F.col("t_start").alias("t"), F.lit(1).alias("kind"), F.col("usage").alias("d"))
    down = spans.select("instance_id", F.col("t_end").alias("t"), F.lit(0).alias("kind"), (-F.col("usage")).alias("d"))
    steps = up.union(down).groupBy("instance_id", "t", "kind").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("instance_id").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("level", F.sum("d").over(w)).groupBy("instance_id").agg(F.max("level").alias("peak"))


@audit_rule("cumulative")
def cumulative(t: dict[str, DataFrame]) -> DataFrame:
    x = peak_usage(t["spans"]).join(t["peaks"], "instance_id")
    return violations(x.where("peak > limit"), "cumulative", "instance_id", F.col("peak"), F.col("limit"))


def run_lengths(states: DataFrame, on: Column) -> DataFrame:
    """(instance_id, person, first_day, length) of the runs of consecutive days where on holds."""
    x = states.where(on).withColumn("island", F.col("day") - F.row_number().over(Window.partitionBy("instance_id", "person").orderBy("day")))
    return x.groupBy("instance_id", "person", "island").agg(F.min("day").alias("first_day"), F.count(F.lit(1)).alias("length")).drop("island")


def balance(series: DataFrame) -> DataFrame:
    """A column stock: start + the running sum of inflow - outflow."""
    w = Window.partitionBy("instance_id", "entity").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("stock", F.sum(F.col("inflow") - F.col("outflow")).over(w))


def clipped(series: DataFrame) -> DataFrame:
    """A column level: x = max(0, x + inflow - outflow) period by period, as the running sum less the least running sum so far, or 0."""
    w = Window.partitionBy("instance_id", "entity").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return balance(series).withColumn("level", F.col("stock") - F.least(F.lit(0.0), F.min("stock").over(w)))


@audit_rule("supply")
def first_breach(t: dict[str, DataFrame]) -> DataFrame:
    """series: the first period in which cumulative outflow exceeds cumulative inflow."""
    x = balance(t["series"]).where("stock < 0")
    first = x.groupBy("instance_id", "entity").agg(F.min(F.struct("period", "stock")).alias("b"))
    return violations(first, "supply", "entity", F.col("b.stock"), F.lit(0.0))


def flow_balance(flows: DataFrame, arcs: DataFrame) -> DataFrame:
    """(instance_id, commodity, node, net): inflow less outflow."""
    x = flows.join(arcs, ["instance_id", "arc_id"])
    signed = x.select("instance_id", "commodity", F.explode(F.array(F.struct(F.col("src").alias("node"), (-F.col("amount")).alias("a")), F.struct(F.col("dst").alias("node"), F.col("amount").alias("a")))).alias("p"))
    return signed.groupBy("instance_id", "commodity", F.col("p.node").alias("node")).agg(F.sum("p.a").alias("net"))


def edge_conflicts(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends chosen: what an independent set must not have. chosen: (instance_id, node)."""
    a = edges.join(chosen.select("instance_id", F.col("node").alias("u")), ["instance_id", "u"], "left_semi")
    return a.join(chosen.select("instance_id", F.col("node").alias("v")), ["instance_id", "v"], "left_semi")


@audit_rule("independent")
def independent_set(t: dict[str, DataFrame]) -> DataFrame:
    x = edge_conflicts(t["edges"], t["chosen"]).withColumn("at", F.concat_ws("/", "u", "v"))
    return violations(x, "independent", "at", F.lit(1), F.lit(0))


def nearest_open(distances: DataFrame, opened: DataFrame) -> DataFrame:
    """Each customer's nearest opened facility: (instance_id, customer, facility, distance)."""
    x = distances.join(opened, ["instance_id", "facility"])
    return x.groupBy("instance_id", "customer").agg(F.min(F.struct("distance", "facility")).alias("m")).select("instance_id", "customer", "m.facility", "m.distance")


def nearest_points(points: DataFrame, centres: DataFrame, part: int = 4096) -> DataFrame:
    """Each point's nearest centre by straight distance: (instance_id, item, cx, cy, distance), of equally near ones the least (cx, cy). points: (instance_id, item, x, y), centres: (instance_id, cx, cy).

    Points are dealt to parts of about part rows, and so are the distinct centres; a part of points meets each part of its instance's centres as arrays
    in one task, which keeps the nearest only; the session's Arrow batches are bounded by bytes for that. So rows are shuffled for points and parts, not for pairs, however many an instance has. Points without a
    place, or without a centre, have no row; repeated points are one.
    """

    def dealt(df: DataFrame, cols: list[str], name: str) -> DataFrame:
        n = df.groupBy("instance_id").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("_parts"))
        own = df.join(n, "instance_id").withColumn(name, F.pmod(F.xxhash64(*cols), F.col("_parts")).cast("int"))
        return own.groupBy("instance_id", name).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name + "s"))

    kind, item = (points.schema[c].dataType.simpleString() for c in ("instance_id", "item"))
    p = dealt(points.select("instance_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "item").dropna(subset=["x", "y"]), ["x", "y", "item"], "p")
    c = dealt(centres.select("instance_id", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy")).dropna().distinct(), ["cx", "cy"], "c")
    points.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    met = p.join(large(c), "instance_id").repartition("instance_id", "p", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda rows, k: rows.field(k).to_numpy(zero_copy_only=False)
        for batch in batches:
            for i in range(batch.num_rows):
                own, held = batch.column("ps")[i].values, batch.column("cs")[i].values
                x, y, cx, cy = number(own, "x"), number(own, "y"), number(held, "cx"), number(held, "cy")
                at, least = np.empty(len(x), np.int64), np.empty(len(x))
                step = max(1, (1 << 18) // len(cx))  # 2 MB of distances at a time
                for lo in range(0, len(x), step):
                    d = (x[lo : lo + step, None] - cx) ** 2 + (y[lo : lo + step, None] - cy) ** 2
                    at[lo : lo + step] = best = d.argmin(axis=1)
                    least[lo : lo + step] = np.sqrt(d[np.arange(len(best)), best])
                yield pa.RecordBatch.from_arrays([batch.column("instance_id").take(pa.array([i] * len(x), pa.int64())), own.field("item"), pa.array(least), pa.array(cx[at]), pa.array(cy[at])], ["instance_id", "item", "distance", "cx", "cy"])

    found = met.select("instance_id", "ps", "cs").mapInArrow(run, f"instance_id {kind}, item {item}, distance double, cx double, cy double")
    return found.groupBy("instance_id", "item").agg(F.min(F.struct("distance", "cx", "cy")).alias("m")).select("instance_id", "item", "m.cx", "m.cy", "m.distance")


def makespan(loads: DataFrame) -> DataFrame:
    """(instance_id, makespan) of (instance_id, machine, time)."""
    return loads.groupBy("instance_id", "machine").agg(F.sum("time").alias("s")).groupBy("instance_id").agg(F.max("s").alias("makespan"))


def cvar(losses: DataFrame, alpha: float) -> DataFrame:
    """(instance_id, cvar): the mean of the worst 1 - alpha share of equally likely scenario losses, the last one in part."""
    w = Window.partitionBy("instance_id").orderBy(F.col("loss").desc(), "scenario")
    n = F.count(F.lit(1)).over(Window.partitionBy("instance_id"))
    x = losses.withColumn("k", F.row_number().over(w)).withColumn("tail", (1 - alpha) * n)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("tail") - F.col("k") + 1))
    return x.groupBy("instance_id").agg((F.sum(part * F.col("loss")) / F.max("tail")).alias("cvar"))
