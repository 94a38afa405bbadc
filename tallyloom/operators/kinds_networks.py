"""Checks of network kinds from JSON: what answers claim lies within bounds that cuts, cheapest edges and shortest paths give, and cuts are what they claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.numbers import close

from .audit import violations
from .checks import cut_bounds, cut_value, path_values, tree_bound
from .kinds import Audit, Keep, all_of, each, first_of, get, items, kind_check, loose, sort_of
from .kinds_shops import any_of, whole_list

EPS = 1e-6


def edges_of(rows: DataFrame, *numbers: str) -> DataFrame:
    """(instance_id, edge, u, v, *numbers) of the payload's edges, their ends as texts, under any of their names or as lists of two."""
    e = each(rows, ["instance_id"], get("p", "$.edges", "array<variant>"))
    v = F.col("item")
    two = F.when(sort_of(v) == "array", items(v))
    name = lambda x: get(x, "$", "string")
    u = F.coalesce(name(F.get(two, 0)), name(first_of(v, "from", "u", "source", "left")))
    w = F.coalesce(name(F.get(two, 1)), name(first_of(v, "to", "v", "target", "right")))
    return e.select("instance_id", F.col("pos").alias("edge"), u.alias("u"), w.alias("v"), *[loose(get(v, f"$.{c}")).alias(c) for c in numbers]).where("u IS NOT NULL AND v IS NOT NULL")


def claim(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumn("said", loose(any_of("a", *names)))


def beyond(x: DataFrame, cond: Column, what: str, limit: Column) -> DataFrame:
    return violations(x.where(cond).withColumn("at", F.lit(what)), "bounds", "at", F.col("said"), limit)


@kind_check("source_sink")
def source_sink(rows: DataFrame, keep: Keep) -> Audit:
    """A flow's value is not beyond what leaves the source or enters the sink, which a budget may widen. A cut, where the answer has two sides, parts all nodes, has the source and the sink on its sides, and the capacity that it claims."""
    edges = keep(edges_of(rows, "capacity", "expand_unit_cost"), "edges")
    end = lambda c: get("p", f"$.{c}", "string").alias(c)
    x = claim(rows, "max_flow", "flow", "objective_value").select("instance_id", end("source"), end("sink"), loose(get("p", "$.budget")).alias("budget"), loose(get("p", "$.num_nodes")).alias("nodes"), whole_list(any_of("a", "S_side", "s_side", "source_side")).alias("s"), whole_list(any_of("a", "T_side", "t_side", "sink_side")).alias("t"), "said", loose(any_of("a", "min_cut_value", "cut_value", "objective_value")).alias("cut"))
    x = keep(x, "answers")
    sided = F.col("s").isNotNull() & F.col("t").isNotNull()
    flows = x.where(~sided & F.col("said").isNotNull()).join(cut_bounds(edges, x.select("instance_id", "source", "sink", "budget")), "instance_id", "left").withColumn("high", F.coalesce("high", F.lit(0.0)))
    found = [beyond(flows, F.col("said") > F.col("high") + EPS, "cut", F.col("high")), beyond(flows, F.col("said") < -EPS, "negative", F.lit(0.0))]
    cuts = x.where(sided)
    own = cut_value(edges, cuts.select("instance_id", F.explode(F.transform(F.array_distinct("s"), lambda v: v.cast("string"))).alias("node")))
    cuts = keep(cuts.join(own.select("instance_id", F.col("value").alias("capacity")), "instance_id", "left").withColumn("capacity", F.coalesce("capacity", F.lit(0.0))), "cuts")
    part = lambda cond, what: violations(cuts.where(cond).withColumn("at", F.lit(what)), "cut", "at", F.lit(None), F.lit(None))
    every = F.array_union("s", "t")
    out = lambda c, side: ~F.coalesce(F.array_contains(F.transform(side, lambda v: v.cast("string")), F.col(c)), F.lit(False))
    all_nodes = (F.size(every) == F.coalesce("nodes", F.lit(0.0))) & F.forall(every, lambda v: (v >= 0) & (v < F.col("nodes")))
    found += [part(F.size(F.array_intersect("s", "t")) > 0, "both"), part(~F.coalesce(all_nodes, F.lit(False)), "nodes"), part(out("source", F.col("s")), "source"), part(out("sink", F.col("t")), "sink")]
    found.append(violations(cuts.where(~close(F.col("cut"), F.col("capacity"))).withColumn("at", F.lit("capacity")), "declared", "at", F.col("cut"), F.col("capacity")))
    seen = flows.select("instance_id", F.lit(True).alias("readable"), F.lit(2).alias("total"), F.col("said").alias("cost")).union(cuts.select("instance_id", F.lit(True), F.lit(5), "capacity"))
    return Audit(all_of(*found), seen)


@kind_check("transportation")
def transportation(rows: DataFrame, keep: Keep) -> Audit:
    """Supply covers demand, and the cost is not below that of each place's demand from its cheapest source."""
    x = keep(claim(rows, "min_cost", "total_cost", "objective_value").where("said IS NOT NULL").select("instance_id", "p", "said"), "answers")
    listed = lambda c: F.transform(F.coalesce(get("p", f"$.{c}", "array<variant>"), F.array().cast("array<variant>")), loose)
    total = lambda c: F.aggregate(listed(c), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    need = x.select("instance_id", F.posexplode(listed("demand")).alias("j", "need"))
    costs = each(x, ["instance_id"], get("p", "$.cost", "array<variant>")).select("instance_id", F.posexplode(F.transform(items("item"), loose)).alias("j", "c"))
    least = costs.groupBy("instance_id", "j").agg(F.min(F.coalesce("c", F.lit(0.0))).alias("c"))
    bound = need.join(least, ["instance_id", "j"]).groupBy("instance_id").agg(F.sum(F.col("need") * F.col("c")).alias("low"))
    y = keep(x.select("instance_id", "said", total("supply").alias("supply"), total("demand").alias("demand")).join(bound, "instance_id", "left").fillna(0.0, ["low"]), "bounds")
    short = violations(y.where(F.col("supply") + EPS < F.col("demand")).withColumn("at", F.lit("supply")), "bounds", "at", F.col("supply"), F.col("demand"))
    found = all_of(short, beyond(y, F.col("said") + EPS < F.col("low"), "cost", F.col("low")), beyond(y, F.col("said") < -EPS, "negative", F.lit(0.0)))
    return Audit(found, y.select("instance_id", F.lit(True).alias("readable"), F.lit(3).alias("total"), F.col("said").alias("cost")))


@kind_check("min_cost_flow")
def min_cost_flow(rows: DataFrame, keep: Keep) -> Audit:
    """The cost is not below the amount times the cheapest path."""
    x = claim(rows, "min_cost", "total_cost", "objective_value").where("said IS NOT NULL")
    x = keep(x.select("instance_id", "p", "said", get("p", "$.supply_node", "string").alias("node"), get("p", "$.demand_node", "string").alias("to"), F.coalesce(loose(get("p", "$.amount")), F.lit(0.0)).alias("amount")), "answers")
    arcs = edges_of(x, "cost").select("instance_id", F.col("u").alias("src"), F.col("v").alias("dst"), F.coalesce("cost", F.lit(0.0)).alias("length"))
    reach = path_values(arcs, x.select("instance_id", "node")).withColumnRenamed("node", "to")
    y = keep(x.drop("p").join(reach, ["instance_id", "to"], "left").withColumn("low", F.col("amount") * F.col("value")), "bounds")
    found = all_of(beyond(y, F.col("said") + EPS < F.col("low"), "cost", F.col("low")), beyond(y, F.col("said") < -EPS, "negative", F.lit(0.0)))
    return Audit(found, y.select("instance_id", F.lit(True).alias("readable"), F.lit(2).alias("total"), F.col("said").alias("cost")))


@kind_check("spanning_tree")
def spanning_tree(rows: DataFrame, keep: Keep) -> Audit:
    """A tree of n nodes has n - 1 edges, and does not cost less than the n - 1 cheapest."""
    x = claim(rows, "min_total_cost", "total_cost", "objective_value").where("said IS NOT NULL")
    x = keep(x.select("instance_id", "p", "said", loose(get("p", "$.num_nodes")).alias("n"), loose(any_of("a", "num_edges_used", "edge_count")).alias("used")), "answers")
    x = x.where("n > 0")
    nodes = x.select("instance_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("node"))
    low = tree_bound(edges_of(x, "cost").withColumn("cost", F.coalesce("cost", F.lit(0.0))), nodes)
    y = keep(x.drop("p").join(low, "instance_id", "left").fillna(0.0, ["bound"]), "bounds")
    edges = violations(y.where(F.col("used").cast("long") != F.col("n").cast("long") - 1).withColumn("at", F.lit("edges")), "declared", "at", F.col("used"), F.col("n") - 1)
    return Audit(all_of(edges, beyond(y, F.col("said") + EPS < F.col("bound"), "cost", F.col("bound"))), y.select("instance_id", F.lit(True).alias("readable"), F.lit(2).alias("total"), F.col("said").alias("cost")))

