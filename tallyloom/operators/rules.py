"""More audit rules: setups, blocked times, staffing, states, routes, patterns, linear use, portfolios, levels and placements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numbers import close

from .audit import audit_rule, violations


@audit_rule("setup")
def setup_gaps(t: dict[str, DataFrame]) -> DataFrame:
    """spans with a kind, and setups (before, after, setup): an item must start setup after its predecessor on the resource ends."""
    w = Window.partitionBy("instance_id", "resource").orderBy("t_start", "t_end", "item")
    x = t["spans"].withColumns({"before": F.lag("kind").over(w), "free": F.lag("t_end").over(w)}).withColumnRenamed("kind", "after")
    x = x.join(t["setups"], ["before", "after"]).withColumn("ready", F.col("free") + F.col("setup"))
    return violations(x.where("t_start < ready"), "setup", "item", F.col("t_start"), F.col("ready"))


def overlapping(spans: DataFrame, blocked: DataFrame, width: float) -> DataFrame:
    """Spans and blocked times (instance_id, resource, b_start, b_end) that overlap, half open.

    Both are dealt to bins of the given width, and a pair is found in the bin where the later of the two starts.
    """
    bins = lambda a, b: F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))
    x = spans.where("t_end > t_start").withColumn("bin", F.explode(bins("t_start", "t_end")))
    y = blocked.where("b_end > b_start").withColumn("bin", F.explode(bins("b_start", "b_end")))
    pairs = x.join(y, ["instance_id", "resource", "bin"]).where("t_start < b_end AND t_end > b_start")
    return pairs.where(F.col("bin") == F.floor(F.greatest("t_start", "b_start") / width)).drop("bin")


@audit_rule("blocked")
def blocked(t: dict[str, DataFrame]) -> DataFrame:
    x = overlapping(t["spans"], t["blocked"], 30.0)
    return violations(x, "blocked", "item", F.col("t_start"), F.col("b_end"))


def staffing(required: DataFrame, assigned: DataFrame) -> DataFrame:
    """required (instance_id, slot, role, need) with n, the assigned (instance_id, slot, role), and the shortage."""
    n = assigned.groupBy("instance_id", "slot", "role").agg(F.count(F.lit(1)).alias("n"))
    x = required.join(n, ["instance_id", "slot", "role"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.withColumn("shortage", F.greatest(F.col("need") - F.col("n"), F.lit(0)))


@audit_rule("staffing")
def understaffed(t: dict[str, DataFrame]) -> DataFrame:
    """Each slot has the staff that it needs of each role; where required has a true column exact, no more than that either."""
    x = staffing(t["required"], t["assigned"])
    over = F.coalesce(F.col("exact"), F.lit(False)) & (F.col("n") > F.col("need")) if "exact" in x.columns else F.lit(False)
    return violations(x.where((F.col("shortage") > 0) | over).withColumn("at", F.concat_ws("/", "slot", "role")), "staffing", "at", F.col("n"), F.col("need"))


@audit_rule("fit")
def misfits(t: dict[str, DataFrame]) -> DataFrame:
    """assigned (instance_id, item, slot): an item's size is within its slot's, the slot has the item's skill (or all of its list, needs), is among those that the item may use (an array allowed, by name), and is open (open_from, open_to) from the item's t_start to its t_end; each as far as items and slots have these columns."""
    x = t["assigned"].join(t["items"], ["instance_id", "item"]).join(t["slots"], ["instance_id", "slot"])
    held = set(x.columns)
    rules = {
        ("size", "room"): lambda: F.col("size") > F.col("room"), ("skill", "skills"): lambda: ~F.array_contains("skills", F.col("skill")), ("needs", "skills"): lambda: F.size(F.array_except("needs", "skills")) > 0,
        ("allowed",): lambda: ~F.array_contains("allowed", F.col("slot")), ("open_from", "open_to", "t_start", "t_end"): lambda: (F.col("t_start") < F.col("open_from")) | (F.col("t_end") > F.col("open_to")),
    }
    bad = [F.coalesce(broken(), F.lit(False)) for names, broken in rules.items() if set(names) <= held]
    own = lambda c: F.col(c) if c in held else F.lit(None)
    return violations(x.where(F.greatest(*bad, F.lit(False), F.lit(False))), "fit", "item", own("size"), own("room"))


@audit_rule("sequence")
def forbidden_states(t: dict[str, DataFrame]) -> DataFrame:
    """states (instance_id, person, day, state): pairs on consecutive days that forbidden (before, state) lists."""
    w = Window.partitionBy("instance_id", "person").orderBy("day")
    x = t["states"].withColumns({"before": F.lag("state").over(w), "last": F.lag("day").over(w)}).where("day = last + 1")
    return violations(x.join(t["forbidden"], ["before", "state"], "left_semi"), "sequence", "person", F.col("day"), F.col("last"))


def block_counts(states: DataFrame, on: Column, days: int = 7) -> DataFrame:
    """(instance_id, person, block, n): days where on holds, in calendar blocks; day 1 begins the first."""
    return states.groupBy("instance_id", "person", F.floor((F.col("day") - 1) / days).alias("block")).agg(F.count_if(on).alias("n"))


@audit_rule("blocks")
def block_limits(t: dict[str, DataFrame]) -> DataFrame:
    """Work days for each block of 7 days are within block_limits (instance_id, limit); state off is no work."""
    x = block_counts(t["states"], F.col("state") != "off").join(t["block_limits"], "instance_id").where("n > limit")
    return violations(x.withColumn("at", F.concat_ws("/", "person", "block")), "blocks", "at", F.col("n"), F.col("limit"))


def peak_loads(stops: DataFrame) -> DataFrame:
    """(instance_id, route, peak): what is delivered is on board from the start, what is picked up stays until the end."""
    w = Window.partitionBy("instance_id", "route")
    total = F.sum("delivery").over(w)
    so_far = F.sum(F.col("pickup") - F.col("delivery")).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    x = stops.select("instance_id", "route", total.alias("total"), (total + so_far).alias("load"))
    return x.groupBy("instance_id", "route").agg(F.greatest(F.max("load"), F.max("total")).alias("peak"))


@audit_rule("pairing")
def pickups_first(t: dict[str, DataFrame]) -> DataFrame:
    """stops with request and kind (pickup, delivery): each once, on one route, the pickup first. observed and limit are the positions."""
    at = lambda kind, f: f(F.when(F.col("kind") == kind, F.col("pos")))
    x = t["stops"].groupBy("instance_id", "request").agg(at("pickup", F.min).alias("up"), at("delivery", F.max).alias("down"), F.count(F.lit(1)).alias("n"), F.countDistinct("route").alias("routes"))
    good = F.coalesce((F.col("n") == 2) & (F.col("routes") == 1) & (F.col("up") < F.col("down")), F.lit(False))
    return violations(x.where(~good), "pairing", "request", F.col("up"), F.col("down"))


@audit_rule("match")
def quantity_match(t: dict[str, DataFrame]) -> DataFrame:
    """Sums of sent and received (instance_id, key, amount) agree, for keys of either."""
    own = lambda name, out: t[name].groupBy("instance_id", "key").agg(F.sum("amount").alias(out))
    x = own("sent", "a").join(own("received", "b"), ["instance_id", "key"], "full_outer").fillna(0.0, ["a", "b"])
    return violations(x.where(~close(F.col("a"), F.col("b"))), "match", "key", F.col("b"), F.col("a"))


@audit_rule("linear")
def linear_use(t: dict[str, DataFrame]) -> DataFrame:
    """coefficients (instance_id, resource, item, coeff) by quantities (instance_id, item, amount), against limits (instance_id, resource, limit)."""
    x = t["coefficients"].join(t["quantities"], ["instance_id", "item"])
    s = x.groupBy("instance_id", "resource").agg(F.sum(F.col("coeff") * F.col("amount")).alias("s"))
    return violations(s.join(t["limits"], ["instance_id", "resource"]).where("s > limit + 1e-6"), "linear", "resource", F.col("s"), F.col("limit"))


def blend(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted means of parts (keys, amount, value); without any amount the mean is null."""
    return parts.groupBy(*keys).agg(F.try_divide(F.sum(F.col("amount") * F.col("value")), F.sum("amount")).alias("mean"))


@audit_rule("production")
def pattern_production(t: dict[str, DataFrame]) -> DataFrame:
    """patterns (instance_id, pattern, item, pieces), used (instance_id, pattern, times): what is made covers demand (instance_id, item, need)."""
    made = t["patterns"].join(t["used"], ["instance_id", "pattern"]).groupBy("instance_id", "item").agg(F.sum(F.col("pieces") * F.col("times")).alias("made"))
    x = t["demand"].join(made, ["instance_id", "item"], "left").withColumn("made", F.coalesce("made", F.lit(0)))
    return violations(x.where("made < need"), "production", "item", F.col("made"), F.col("need"))


def distinct_patterns(patterns: DataFrame) -> DataFrame:
    """(instance_id, n_patterns): patterns with the same pieces count once. A pattern's own list is small."""
    content = F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("item", "pieces")))), 256)
    own = patterns.groupBy("instance_id", "pattern").agg(content.alias("h"))
    return own.groupBy("instance_id").agg(F.countDistinct("h").alias("n_patterns"))


def turnover(old: DataFrame, new: DataFrame) -> DataFrame:
    """(instance_id, turnover, n_held, total) of weights (instance_id, asset, weight), over assets of either."""
    x = old.select("instance_id", "asset", F.col("weight").alias("a")).join(new.select("instance_id", "asset", F.col("weight").alias("b")), ["instance_id", "asset"], "full_outer").fillna(0.0, ["a", "b"])
    return x.groupBy("instance_id").agg(F.sum(F.abs(F.col("a") - F.col("b"))).alias("turnover"), F.count_if(F.col("b") > 0).alias("n_held"), F.sum("b").alias("total"))


def expected_value(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of outcomes (keys, value, weight) under weights that need not sum to one."""
    return outcomes.groupBy(*keys).agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("expected"))


def level_changes(levels: DataFrame) -> DataFrame:
    """(instance_id, entity, n_starts, up, down): how often a level leaves 0, and what it rises and falls by, from 0 before the first period."""
    before = F.coalesce(F.lag("level").over(Window.partitionBy("instance_id", "entity").orderBy("period")), F.lit(0.0))
    x = levels.withColumn("before", before)
    step = F.col("level") - F.col("before")
    return x.groupBy("instance_id", "entity").agg(F.count_if((F.col("before") == 0) & (F.col("level") > 0)).alias("n_starts"), F.sum(F.greatest(step, F.lit(0.0))).alias("up"), F.sum(F.greatest(-step, F.lit(0.0))).alias("down"))


def placement_cost(flows: DataFrame, placed: DataFrame, distances: DataFrame) -> DataFrame:
    """(instance_id, cost): flow (a, b, flow) times the distance (p, q, distance) of the places of a and b. placed: (instance_id, item, place)."""
    x = flows.join(placed.select("instance_id", F.col("item").alias("a"), F.col("place").alias("p")), ["instance_id", "a"])
    x = x.join(placed.select("instance_id", F.col("item").alias("b"), F.col("place").alias("q")), ["instance_id", "b"])
    return x.join(distances, ["instance_id", "p", "q"]).groupBy("instance_id").agg(F.sum(F.col("flow") * F.col("distance")).alias("cost"))


@audit_rule("path")
def broken_paths(t: dict[str, DataFrame]) -> DataFrame:
    """paths (instance_id, path, pos, arc_id) over arcs: each arc is known and begins where the one before it ends."""
    x = t["paths"].join(t["arcs"].select("instance_id", "arc_id", "src", "dst"), ["instance_id", "arc_id"], "left")
    w = Window.partitionBy("instance_id", "path").orderBy("pos")
    x = x.withColumns({"came": F.lag("dst").over(w), "first": F.row_number().over(w) == 1})
    bad = F.col("src").isNull() | (~F.col("first") & ~F.col("src").eqNullSafe(F.col("came")))
    return violations(x.where(bad).withColumn("at", F.concat_ws("/", "path", "pos")), "path", "at", F.col("src"), F.col("came"))


def flow_shop(jobs: DataFrame, stages: int) -> DataFrame:
    """(instance_id, makespan) of jobs (instance_id, pos, t_1 ... t_stages) in their order: for each stage a prefix sum and a running maximum, no loop over jobs."""
    w = Window.partitionBy("instance_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = jobs.withColumn("ready", F.lit(0.0))
    for s in range(1, stages + 1):
        x = x.withColumn("p", F.sum(f"t_{s}").over(w))
        x = x.withColumn("ready", F.col("p") + F.max(F.col("ready") - (F.col("p") - F.col(f"t_{s}"))).over(w))
    return x.groupBy("instance_id").agg(F.max("ready").alias("makespan"))


def tardiness(jobs: DataFrame) -> DataFrame:
    """(instance_id, tardiness) of jobs (instance_id, pos, time, due) in their order on one machine."""
    w = Window.partitionBy("instance_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = jobs.withColumn("end", F.sum("time").over(w))
    return x.groupBy("instance_id").agg(F.sum(F.greatest(F.col("end") - F.col("due"), F.lit(0.0))).alias("tardiness"))
