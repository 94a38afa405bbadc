"""Further audit rules and recomputed values: index ranges, declared values, job orders, rosters, stocks, arcs, paths, geometry, matchings, portfolios, duties and bounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numbers import close, close_soft
from tallyloom.functions.tables import Shelf

from .audit import audit_rule, balance, run_lengths, violations
from .rules import staffing

@audit_rule("index")
def index_range(t: dict[str, DataFrame]) -> DataFrame:
    """chosen (instance_id, item) are whole numbers from 0 to sizes (instance_id, size) - 1, each at most once. observed is the item, or how often it occurs."""
    n = t["chosen"].groupBy("instance_id", "item").agg(F.count(F.lit(1)).alias("n")).join(t["sizes"], "instance_id")
    outside = violations(n.where("item < 0 OR item >= size"), "index", "item", F.col("item"), F.col("size"))
    return outside.union(violations(n.where("n > 1"), "index", "item", F.col("n"), F.lit(1)))


@audit_rule("declared")
def declared_values(t: dict[str, DataFrame]) -> DataFrame:
    """declared and recomputed (instance_id, field, value) agree: softly, or strictly where declared has a true column strict. A declared value that is null is not checked."""
    d = t["declared"] if "strict" in t["declared"].columns else t["declared"].withColumn("strict", F.lit(False))
    x = d.where("value IS NOT NULL").withColumnRenamed("value", "said").join(t["recomputed"], ["instance_id", "field"])
    good = F.when(F.col("strict"), close(F.col("said"), F.col("value"))).otherwise(close_soft(F.col("said"), F.col("value")))
    return violations(x.where(~good), "declared", "field", F.col("said"), F.col("value"))


@audit_rule("operations")
def operation_order(t: dict[str, DataFrame]) -> DataFrame:
    """operations (instance_id, job, pos, machine, t_start, t_end) of a job follow each other from its release on, last as long as allowed (instance_id, job, pos, machine, duration) says, on an allowed machine. jobs: (instance_id, job, release)."""
    w = Window.partitionBy("instance_id", "job").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    x = t["operations"].join(t["jobs"], ["instance_id", "job"]).withColumn("ready", F.greatest(F.coalesce(F.max("t_end").over(w), F.col("release")), "release"))
    x = x.join(t["allowed"], ["instance_id", "job", "pos", "machine"], "left").withColumn("at", F.concat_ws("/", "job", "pos"))
    early = violations(x.where("t_start < ready"), "operations", "at", F.col("t_start"), F.col("ready"))
    span = F.col("t_end") - F.col("t_start")
    return early.union(violations(x.where(F.col("duration").isNull() | ~close(span, F.col("duration"))), "operations", "at", span, F.col("duration")))


@audit_rule("runs")
def run_limits(t: dict[str, DataFrame]) -> DataFrame:
    """Runs of work days in states (instance_id, person, day, state) have from least to most days, and rest free days after them; run_limits (instance_id, least, most, rest, horizon). What the horizon cuts short is not held against a run."""
    runs = run_lengths(t["states"], F.col("state") != "off").join(t["run_limits"], "instance_id")
    last = F.col("first_day") + F.col("length") - 1
    free = F.lead("first_day").over(Window.partitionBy("instance_id", "person").orderBy("first_day")) - last - 1
    x = runs.withColumns({"last": last, "free": free, "at": F.concat_ws("/", "person", "first_day")})
    long = violations(x.where("length > most"), "runs", "at", F.col("length"), F.col("most"))
    short = violations(x.where("length < least AND last < horizon"), "runs", "at", F.col("length"), F.col("least"))
    return long.union(short).union(violations(x.where("free < rest"), "runs", "at", F.col("free"), F.col("rest")))


@audit_rule("totals")
def state_totals(t: dict[str, DataFrame]) -> DataFrame:
    """Days of each state and person are within total_limits (instance_id, state, least, most); a person without any day of a state has 0."""
    people = t["states"].select("instance_id", "person").distinct().join(t["total_limits"], "instance_id")
    n = t["states"].groupBy("instance_id", "person", "state").agg(F.count(F.lit(1)).alias("n"))
    x = people.join(n, ["instance_id", "person", "state"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "at": F.concat_ws("/", "person", "state")})
    return violations(x.where("n < least OR n > most"), "totals", "at", F.col("n"), F.when(F.col("n") < F.col("least"), F.col("least")).otherwise(F.col("most")))


def soft_cost(required: DataFrame, assigned: DataFrame, states: DataFrame, wishes: DataFrame, weekend: tuple[int, int] = (6, 0)) -> DataFrame:
    """(instance_id, shortage, broken, weekends, spread) of a roster.

    shortage: missing staff; broken: weights of wishes (instance_id, person, day, state, weight) that are not met; weekends: weekends with one work day
    of two (days are weekend days by their number modulo 7); spread: the sum of |work days - mean|, rounded.
    """
    s = staffing(required, assigned).groupBy("instance_id").agg(F.sum("shortage").alias("shortage"))
    met = states.select("instance_id", "person", "day", F.col("state").alias("own"))
    b = wishes.join(met, ["instance_id", "person", "day"], "left").groupBy("instance_id").agg(F.sum(F.when(F.col("own").eqNullSafe(F.col("state")), 0).otherwise(F.col("weight"))).alias("broken"))
    work = F.col("state") != "off"
    first, second = weekend
    at = F.pmod("day", F.lit(7))
    pairs = states.where(at.isin(first, second)).groupBy("instance_id", "person", F.floor((F.col("day") - first) / 7).alias("w")).agg(F.count_if(work).alias("k"))
    k = pairs.groupBy("instance_id").agg(F.count_if(F.col("k") == 1).alias("weekends"))
    days = states.groupBy("instance_id", "person").agg(F.count_if(work).alias("d"))
    mean = days.groupBy("instance_id").agg(F.avg("d").alias("mean"))
    spread = days.join(mean, "instance_id").groupBy("instance_id").agg(F.round(F.sum(F.abs(F.col("d") - F.col("mean")))).alias("spread"))
    return reduce(lambda a, c: a.join(c, "instance_id", "full_outer"), (s, b, k, spread)).fillna(0)


@audit_rule("stock")
def stock_bounds(t: dict[str, DataFrame]) -> DataFrame:
    """series (instance_id, entity, period, inflow, outflow) from initial (instance_id, entity, start, least, most) stays within least and most; where the series has a column declared, it is the stock."""
    x = balance(t["series"]).join(t["initial"], ["instance_id", "entity"]).withColumns({"level": F.col("stock") + F.col("start"), "at": F.concat_ws("/", "entity", "period")})
    low = violations(x.where("level < least - 1e-6"), "stock", "at", F.col("level"), F.col("least"))
    out = low.union(violations(x.where("level > most + 1e-6"), "stock", "at", F.col("level"), F.col("most")))
    if "declared" in x.columns:
        out = out.union(violations(x.where(F.col("declared").isNotNull() & ~close_soft(F.col("declared"), F.col("level"))), "stock", "at", F.col("declared"), F.col("level")))
    return out


@audit_rule("arcs")
def arc_limits(t: dict[str, DataFrame]) -> DataFrame:
    """flows (instance_id, commodity, arc_id, amount) are not negative, on known and open arcs (instance_id, arc_id, capacity, open), and within capacity over all commodities."""
    x = t["flows"].join(t["arcs"].select("instance_id", "arc_id", "capacity", "open"), ["instance_id", "arc_id"], "left").withColumn("at", F.concat_ws("/", "commodity", "arc_id"))
    negative = violations(x.where("amount < -1e-6"), "arcs", "at", F.col("amount"), F.lit(0.0))
    closed = violations(x.where("amount > 1e-6 AND (capacity IS NULL OR NOT open)"), "arcs", "at", F.col("amount"), F.lit(0.0))
    s = x.groupBy("instance_id", "arc_id").agg(F.sum("amount").alias("s"), F.max("capacity").alias("c"))
    return negative.union(closed).union(violations(s.where("s > c + 1e-6"), "arcs", "arc_id", F.col("s"), F.col("c")))


@audit_rule("conservation")
def conservation(t: dict[str, DataFrame]) -> DataFrame:
    """Inflow less outflow of each node and commodity is its need (instance_id, commodity, node, need), 0 where none is stated."""
    from .audit import flow_balance

    x = flow_balance(t["flows"], t["arcs"]).join(t["needs"], ["instance_id", "commodity", "node"], "full_outer").fillna(0.0, ["net", "need"])
    return violations(x.where(~close_soft(F.col("net"), F.col("need"))).withColumn("at", F.concat_ws("/", "commodity", "node")), "conservation", "at", F.col("net"), F.col("need"))


@audit_rule("path_ends")
def path_ends(t: dict[str, DataFrame]) -> DataFrame:
    """paths (instance_id, path, pos, arc_id) begin at their source and end at their sink, within the limit of ends (instance_id, path, source, sink, limit) on arcs' length. observed is the length; limit is null where an end is wrong."""
    x = t["paths"].select("instance_id", "path", "pos", "arc_id").join(t["arcs"].select("instance_id", "arc_id", "src", "dst", "length"), ["instance_id", "arc_id"])
    s = x.groupBy("instance_id", "path").agg(F.min_by("src", "pos").alias("a"), F.max_by("dst", "pos").alias("b"), F.sum("length").alias("length")).join(t["ends"], ["instance_id", "path"])
    wrong = ~F.col("a").eqNullSafe(F.col("source")) | ~F.col("b").eqNullSafe(F.col("sink"))
    return violations(s.where(wrong | (F.col("length") > F.col("limit") + 1e-6)), "path_ends", "path", F.col("length"), F.when(~wrong, F.col("limit")))


@audit_rule("disjoint")
def disjoint_paths(t: dict[str, DataFrame]) -> DataFrame:
    """No arc is on two paths (instance_id, path, arc_id) of an instance."""
    n = t["paths"].groupBy("instance_id", "arc_id").agg(F.countDistinct("path").alias("n"))
    return violations(n.where("n > 1"), "disjoint", "arc_id", F.col("n"), F.lit(1))


def nearest_in_radius(points: DataFrame, centres: DataFrame, radius: DataFrame) -> DataFrame:
    """(instance_id, item, x, y, distance): each point's distance to the nearest centre (instance_id, cx, cy) within its instance's radius (instance_id, radius), null if there is none. A grid of cells as wide as that radius limits what is compared."""
    cell = lambda c: F.floor(F.col(c) / F.col("radius"))
    around = lambda c: F.explode(F.array(cell(c) - 1, cell(c), cell(c) + 1))
    own = radius.select("instance_id", "radius").where("radius > 0")
    p = points.join(own, "instance_id").withColumns({"gx": cell("x"), "gy": cell("y")})
    c = centres.join(own, "instance_id").select("instance_id", "cx", "cy", "radius", around("cx").alias("gx")).select("*", around("cy").alias("gy")).drop("radius")
    d = F.sqrt(F.pow(F.col("x") - F.col("cx"), F.lit(2)) + F.pow(F.col("y") - F.col("cy"), F.lit(2)))
    near = p.join(c, ["instance_id", "gx", "gy"]).withColumn("d", d).where(F.col("d") <= F.col("radius")).groupBy("instance_id", "item").agg(F.min("d").alias("distance"))
    return points.join(near, ["instance_id", "item"], "left")


@audit_rule("radius")
def radius_coverage(t: dict[str, DataFrame]) -> DataFrame:
    """Every point (instance_id, item, x, y) has a centre (instance_id, cx, cy) within its instance's radius (instance_id, radius) and 1 more. A table of one radius alone is for all instances."""
    r = t["radius"]
    if "instance_id" not in r.columns:
        r = t["points"].select("instance_id").distinct().join(F.broadcast(r.limit(1)))  # one row
    x = nearest_in_radius(t["points"], t["centres"], r.withColumn("radius", F.col("radius") + 1.0)).join(r.select("instance_id", F.col("radius").alias("limit")), "instance_id")
    return violations(x.where("distance IS NULL"), "radius", "item", F.lit(None), F.col("limit"))


@audit_rule("cover_edges")
def uncovered_edges(t: dict[str, DataFrame]) -> DataFrame:
    """Vertex cover: every edge (instance_id, u, v) has an end among chosen (instance_id, node)."""
    x = t["edges"].join(t["chosen"].select("instance_id", F.col("node").alias("u")), ["instance_id", "u"], "left_anti")
    x = x.join(t["chosen"].select("instance_id", F.col("node").alias("v")), ["instance_id", "v"], "left_anti")
    return violations(x.withColumn("at", F.concat_ws("/", "u", "v")), "cover_edges", "at", F.lit(0), F.lit(1))


@audit_rule("clique")
def missing_edges(t: dict[str, DataFrame]) -> DataFrame:
    """Clique: k chosen nodes have k (k - 1) / 2 different edges among them, in either direction."""
    from .audit import edge_conflicts

    own = edge_conflicts(t["edges"], t["chosen"]).select("instance_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct().groupBy("instance_id").agg(F.count(F.lit(1)).alias("m"))
    k = t["chosen"].groupBy("instance_id").agg(F.countDistinct("node").alias("k"))
    x = k.join(own, "instance_id", "left").withColumns({"m": F.coalesce("m", F.lit(0)), "need": F.col("k") * (F.col("k") - 1) / 2})
    return violations(x.where("m < need"), "clique", "instance_id", F.col("m"), F.col("need"))


@audit_rule("colouring")
def same_colours(t: dict[str, DataFrame]) -> DataFrame:
    """Edges whose ends have one colour (instance_id, node, colour), or an end without a colour."""
    of = lambda n: t["colours"].select("instance_id", F.col("node").alias(n), F.col("colour").alias(f"c_{n}"))
    x = t["edges"].join(of("u"), ["instance_id", "u"], "left").join(of("v"), ["instance_id", "v"], "left")
    bad = F.coalesce(F.col("c_u") == F.col("c_v"), F.lit(True))
    return violations(x.where(bad).withColumn("at", F.concat_ws("/", "u", "v")), "colouring", "at", F.col("c_u"), F.col("c_v"))


def cut_value(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """(instance_id, value): the capacity of edges (instance_id, u, v, capacity) that lead out of the chosen nodes."""
    x = edges.join(chosen.select("instance_id", F.col("node").alias("u")), ["instance_id", "u"], "left_semi")
    return x.join(chosen.select("instance_id", F.col("node").alias("v")), ["instance_id", "v"], "left_anti").groupBy("instance_id").agg(F.sum("capacity").alias("value"))


@audit_rule("stable")
def blocking_pairs(t: dict[str, DataFrame]) -> DataFrame:
    """Pairs that would rather have each other than their matches, the best of them if there are more. ranks_a and ranks_b: (instance_id, a, b, rank), the lower the better; matches: (instance_id, a, b)."""
    of = lambda who, ranks: t["matches"].join(t[ranks], ["instance_id", "a", "b"]).groupBy("instance_id", who).agg(F.min("rank").alias(f"own_{who}"))
    x = t["ranks_a"].withColumnRenamed("rank", "ra").join(t["ranks_b"].withColumnRenamed("rank", "rb"), ["instance_id", "a", "b"])
    x = x.join(of("a", "ranks_a"), ["instance_id", "a"], "left").join(of("b", "ranks_b"), ["instance_id", "b"], "left")
    rather = lambda r, own: F.col(own).isNull() | (F.col(r) < F.col(own))
    return violations(x.where(rather("ra", "own_a") & rather("rb", "own_b")).withColumn("at", F.concat_ws("/", "a", "b")), "stable", "at", F.col("ra"), F.col("own_a"))


def overlapping_rectangles(rectangles: DataFrame) -> DataFrame:
    """(instance_id, bin, item, other) of rectangles (instance_id, bin, item, x, y, w, h) that overlap, item before other.

    Widths and heights have levels, the next power of two. Two rectangles meet in the grid whose cells are as wide as the wider and as high as the higher
    one's level, in the cell where their overlap begins; there, each covers a few cells. A rectangle goes to grids of its own levels, where larger and smaller ones of its bin are looked up, so a cell
    holds few rectangles that do not overlap, and a long strip meets what is near it only.
    """
    own = ["instance_id", "bin"]
    level = lambda c: F.ceil(F.log2(c)).cast("int")
    r = rectangles.where("w > 0 AND h > 0").select(*own, "item", "x", "y", "w", "h", level("w").alias("lx"), level("h").alias("ly"))
    kinds = r.select(*own, F.col("lx").alias("gw"), F.col("ly").alias("gh")).distinct()
    span = lambda a, b, g: F.explode(F.sequence(F.floor(F.col(a) / F.pow(F.lit(2.0), F.col(g))), F.floor((F.col(a) + F.col(b)) / F.pow(F.lit(2.0), F.col(g)))))
    cells = lambda df: df.withColumn("gx", span("x", "w", "gw")).withColumn("gy", span("y", "h", "gh"))
    keys = [*own, "gw", "gh", "gx", "gy"]

    def pairs(a: DataFrame, b: DataFrame, more: Column) -> DataFrame:
        a, b = cells(a).alias("a"), cells(b).alias("b")
        same = reduce(Column.__and__, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
        meet = (F.col("a.x") < F.col("b.x") + F.col("b.w")) & (F.col("b.x") < F.col("a.x") + F.col("a.w")) & (F.col("a.y") < F.col("b.y") + F.col("b.h")) & (F.col("b.y") < F.col("a.y") + F.col("a.h"))
        at = lambda c, g: F.floor(F.greatest(f"a.{c}", f"b.{c}") / F.pow(F.lit(2.0), F.col(f"a.{g}")))
        first = (F.col("a.gx") == at("x", "gw")) & (F.col("a.gy") == at("y", "gh"))
        return a.join(b, same & meet & first & more).select(*[F.col(f"a.{k}") for k in own], F.least("a.item", "b.item").alias("item"), F.greatest("a.item", "b.item").alias("other"))

    home = r.withColumns({"gw": F.col("lx"), "gh": F.col("ly")})
    guest = r.join(kinds, own).where("gw >= lx AND gh >= ly")
    alike = (F.col("b.lx") == F.col("a.lx")) & (F.col("b.ly") == F.col("a.ly"))
    # One is as large as the other in both ways; or one is wider and the other higher.
    nested = pairs(home, guest, ~alike | (F.col("a.item") < F.col("b.item")))
    wide = r.withColumn("gw", F.col("lx")).join(kinds.select(*own, "gh").distinct(), own).where("gh > ly")
    high = r.withColumn("gh", F.col("ly")).join(kinds.select(*own, "gw").distinct(), own).where("gw > lx")
    return nested.unionByName(pairs(wide.select(*home.columns), high.select(*home.columns), F.lit(True)))


@audit_rule("packing")
def packing(t: dict[str, DataFrame]) -> DataFrame:
    """rectangles lie in their bins (instance_id, bin, width, height) and do not overlap."""
    x = t["rectangles"].join(t["bins"], ["instance_id", "bin"])
    out = violations(x.where("x < 0 OR y < 0 OR x + w > width OR y + h > height"), "packing", "item", F.greatest(F.col("x") + F.col("w") - F.col("width"), F.col("y") + F.col("h") - F.col("height"), -F.col("x"), -F.col("y")), F.lit(0.0))
    return out.union(violations(overlapping_rectangles(t["rectangles"]), "packing", "item", F.col("other"), F.lit(None)))


def hop(metric: str, x: Column, y: Column) -> Column:
    return F.abs(x) + F.abs(y) if metric == "manhattan" else F.sqrt(x * x + y * y)


def tour_lengths(stops: DataFrame, metric: str = "euclid", closed: bool = True) -> DataFrame:
    """(instance_id, route, length) of stops (instance_id, route, pos, x, y)."""
    w = Window.partitionBy("instance_id", "route").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = lambda c: F.coalesce(F.lag(c).over(w), F.last(c).over(whole) if closed else F.col(c))
    return stops.select("instance_id", "route", hop(metric, F.col("x") - back("x"), F.col("y") - back("y")).alias("d")).groupBy("instance_id", "route").agg(F.sum("d").alias("length"))


def matrix_lengths(stops: DataFrame, distances: DataFrame, closed: bool = True) -> DataFrame:
    """(instance_id, route, length) of stops (instance_id, route, pos, item) by distances (instance_id, a, b, distance); null if one is unknown."""
    w = Window.partitionBy("instance_id", "route").orderBy("pos")
    last = F.last("item").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = stops.select("instance_id", "route", F.coalesce(F.lag("item").over(w), last if closed else F.lit(None)).alias("a"), F.col("item").alias("b")).where("a IS NOT NULL AND a <> b")
    x = x.join(distances, ["instance_id", "a", "b"], "left")
    return x.groupBy("instance_id", "route").agg(F.when(F.count_if(F.col("distance").isNull()) == 0, F.sum("distance")).alias("length"))


def inflated(lengths: DataFrame, visited: DataFrame, required: DataFrame) -> DataFrame:
    """(instance_id, length): the sum of route lengths, times required / visited stops where some are missing."""
    total = lengths.groupBy("instance_id").agg(F.sum("length").alias("sum"))
    n = visited.groupBy("instance_id").agg(F.countDistinct("item").alias("v")).join(required.groupBy("instance_id").agg(F.countDistinct("item").alias("r")), "instance_id")
    return total.join(n, "instance_id").select("instance_id", (F.col("sum") * F.greatest(F.lit(1.0), F.col("r") / F.col("v"))).alias("length"))


def route_clock(stops: DataFrame, opens: Column | None = None) -> DataFrame:
    """(instance_id, route, end, waited, n_late, slack) of stops (instance_id, route, pos, travel, service, tw_start, tw_end): waiting for windows to open, no loop.

    With C the travel and service before a stop, it starts at C + max(open, max so far of tw_start - C). slack: how much later the route could start without being later anywhere.
    """
    w = Window.partitionBy("instance_id", "route").orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    begin = opens if opens is not None else F.lit(0.0)
    x = stops.withColumn("step", F.col("travel") + F.coalesce(F.lag("service").over(w), F.lit(0.0))).withColumn("c", F.sum("step").over(so_far))
    x = x.withColumn("start", F.col("c") + F.greatest(begin, F.max(F.col("tw_start") - F.col("c")).over(so_far)))
    return x.groupBy("instance_id", "route").agg(
        F.max(F.col("start") + F.col("service")).alias("end"), (F.max_by(F.col("start") - F.col("c"), "pos") - F.max(begin)).alias("waited"), F.count_if(F.col("start") > F.col("tw_end")).alias("n_late"), F.min(F.col("tw_end") - F.col("c") - begin).alias("slack"),
    )


@audit_rule("clock")
def shift_clock(t: dict[str, DataFrame]) -> DataFrame:
    """Routes start their service in time, are no longer on duty than allowed and are back before closing; a violation of each for a route at most.

    stops: (instance_id, route, pos, travel, service, tw_start, tw_end); shifts: (instance_id, route, opens, closes, longest, back), back is the travel
    from the last stop. A route may start later than it opens as long as nothing gets late: of its time from opening on, what it
    waits, within the least slack of its stops, is not on duty. With C the travel and service before a stop, the stop starts at
    C + max(opens, max so far of tw_start - C), and the least slack is min(tw_end - C) - opens, so both are running extremes and there is no loop.
    """
    own = ["instance_id", "route"]
    w = Window.partitionBy(*own).orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    x = t["stops"].join(t["shifts"].select(*own, "opens"), own).withColumn("c", F.sum(F.col("travel") + F.coalesce(F.lag("service").over(w), F.lit(0.0))).over(so_far))
    x = x.withColumn("start", F.col("c") + F.greatest("opens", F.max(F.col("tw_start") - F.col("c")).over(so_far)))
    r = x.groupBy(*own).agg(F.max_by(F.col("start") + F.col("service"), "pos").alias("left"), F.max_by(F.col("start") - F.col("c") - F.col("opens"), "pos").alias("waited"), F.count_if(F.col("start") > F.col("tw_end") + 1e-6).alias("late"), F.min(F.col("tw_end") - F.col("c") - F.col("opens")).alias("slack"))
    r = t["shifts"].join(r, own, "left").withColumn("home", F.coalesce("left", "opens") + F.col("back"))
    spared = F.greatest(F.lit(0.0), F.least(F.coalesce("waited", F.lit(0.0)), F.coalesce("slack", F.lit(0.0))))
    r = r.withColumn("duty", F.col("home") - F.col("opens") - spared)
    late = violations(r.where("late > 0"), "clock", "route", F.col("late"), F.lit(0))
    long = violations(r.where("duty > longest + 1e-6").withColumn("at", F.concat_ws("/", "route", F.lit("duty"))), "clock", "at", F.col("duty"), F.col("longest"))
    return late.union(long).union(violations(r.where("home > closes + 1e-6").withColumn("at", F.concat_ws("/", "route", F.lit("return"))), "clock", "at", F.col("home"), F.col("closes")))


@audit_rule("fleet")
def fleet_limits(t: dict[str, DataFrame]) -> DataFrame:
    """Routes (instance_id, route, kind) of each kind of vehicle are not more than held (instance_id, kind, held)."""
    n = t["routes"].groupBy("instance_id", "kind").agg(F.countDistinct("route").alias("n"))
    x = n.join(t["held"], ["instance_id", "kind"], "left").withColumn("held", F.coalesce("held", F.lit(0)))
    return violations(x.where("n > held"), "fleet", "kind", F.col("n"), F.col("held"))


def chain_heads(edges: DataFrame, sources: DataFrame, shelf: Shelf) -> DataFrame:
    """(instance_id, node, head, dist): for each node with one edge in and one out, and no source, the first node back that has not, and the length from there.

    Heads are found by doubling: each round a node takes the head of its head, so a chain of n nodes takes about log2 n rounds. Nodes of closed rings have none.
    """
    into = edges.groupBy("instance_id", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("k"), F.min("src").alias("head"), F.min("length").alias("dist")).where("k = 1").drop("k")
    out = edges.groupBy("instance_id", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("k")).where("k = 1").drop("k")
    own = into.join(out, ["instance_id", "node"]).join(sources.select("instance_id", "node").distinct(), ["instance_id", "node"], "left_anti")
    at = shelf.put(own.select("instance_id", "node", "head", "dist"), "heads")
    for _ in range(max(1, at.count()).bit_length() + 1):
        up = at.select("instance_id", F.col("node").alias("head"), F.col("head").alias("far"), F.col("dist").alias("more"))
        new = at.join(up, ["instance_id", "head"], "left").select("instance_id", "node", F.coalesce("far", "head").alias("head"), (F.col("dist") + F.coalesce("more", F.lit(0.0))).alias("dist"), F.col("far").isNotNull().alias("open"))
        new = shelf.put(new, "heads")
        shelf.drop(at)
        at = new.drop("open")
        shelf.places[id(at)] = (at, shelf.places[id(new)][1])
        if new.where("open").isEmpty():
            return at
    return at.join(at.select("instance_id", F.col("node").alias("head")), ["instance_id", "head"], "left_anti")


def path_values(edges: DataFrame, sources: DataFrame, longest: bool = False, rounds: int = 10_000) -> DataFrame:
    """(instance_id, node, value): the least (or greatest, in a graph without cycles) length of edges (instance_id, src, dst, length) from sources (instance_id, node).

    Chains of nodes with one edge in and one out are one edge each. What is left is relaxed in rounds from the nodes that changed, each written before the
    next and the one before it removed, until nothing changes; a cycle that keeps improving is an error after rounds.
    """
    best = F.max if longest else F.min
    better = (lambda a, b: a > b) if longest else (lambda a, b: a < b)
    shelf = Shelf(edges.sparkSession, "paths")
    own = shelf.put(edges.groupBy("instance_id", "src", "dst").agg(best("length").cast("double").alias("length")), "edges")
    heads = chain_heads(own, sources, shelf)
    to = own.join(heads.select("instance_id", F.col("node").alias("dst")), ["instance_id", "dst"], "left_anti")
    to = to.join(heads.select("instance_id", F.col("node").alias("src"), "head", "dist"), ["instance_id", "src"], "left")
    short = shelf.put(to.groupBy("instance_id", F.coalesce("head", "src").alias("src"), "dst").agg(best(F.col("length") + F.coalesce("dist", F.lit(0.0))).alias("length")), "short")
    at = shelf.put(sources.select("instance_id", "node", F.lit(0.0).alias("value"), F.lit(True).alias("moved")).distinct(), "values")
    for _ in range(rounds):
        step = at.where("moved").select("instance_id", F.col("node").alias("src"), "value").join(short, ["instance_id", "src"]).groupBy("instance_id", F.col("dst").alias("node")).agg(best(F.col("value") + F.col("length")).alias("new"))
        x = at.drop("moved").join(step, ["instance_id", "node"], "full_outer")
        moved = F.col("new").isNotNull() & (F.col("value").isNull() | better(F.col("new"), F.col("value")))
        new = shelf.put(x.select("instance_id", "node", F.when(moved, F.col("new")).otherwise(F.col("value")).alias("value"), moved.alias("moved")), "values")
        shelf.drop(at)
        at = new
        if at.where("moved").isEmpty():
            along = heads.join(at.select("instance_id", F.col("node").alias("head"), "value"), ["instance_id", "head"]).select("instance_id", "node", (F.col("value") + F.col("dist")).alias("value"))
            return at.drop("moved").unionByName(along)
    raise ValueError("a cycle keeps improving")


def trusted_duration(claimed: DataFrame, computed: DataFrame) -> DataFrame:
    """(instance_id, duration): the claimed duration, or the computed one where it is under half of that."""
    return claimed.withColumnRenamed("duration", "said").join(computed, "instance_id").select("instance_id", F.when(F.col("said") < F.col("duration") / 2, F.col("duration")).otherwise(F.coalesce("said", "duration")).alias("duration"))


@audit_rule("patterns")
def pattern_fit(t: dict[str, DataFrame]) -> DataFrame:
    """Pieces of each pattern (instance_id, pattern, item, pieces) fit the stock: sum of pieces times sizes (instance_id, item, size) within stock (instance_id, stock); used times (instance_id, pattern, times) are whole, and at least lot if the stock has one."""
    s = t["patterns"].join(t["item_sizes"], ["instance_id", "item"]).groupBy("instance_id", "pattern").agg(F.sum(F.col("pieces") * F.col("size")).alias("s")).join(t["stock"], "instance_id")
    wide = violations(s.where("s > stock + 1e-6"), "patterns", "pattern", F.col("s"), F.col("stock"))
    u = t["used"].join(t["stock"], "instance_id")
    bad = (F.col("times") != F.floor("times")) | (F.col("times") < 0)
    if "lot" in u.columns:
        bad = bad | ((F.col("times") > 0) & (F.col("times") < F.col("lot")))
    return wide.union(violations(u.where(bad), "patterns", "pattern", F.col("times"), F.lit(None)))


@audit_rule("budget")
def budget(t: dict[str, DataFrame]) -> DataFrame:
    """Costs (instance_id, item, cost) of chosen items sum to the budget (instance_id, budget) at most."""
    s = t["chosen"].select("instance_id", "item").distinct().join(t["costs"], ["instance_id", "item"]).groupBy("instance_id").agg(F.sum("cost").alias("s")).join(t["budgets"], "instance_id")
    return violations(s.where("s > budget + 1e-6"), "budget", "instance_id", F.col("s"), F.col("budget"))


@audit_rule("prerequisites")
def prerequisites(t: dict[str, DataFrame]) -> DataFrame:
    """What a chosen item requires (instance_id, item, needs) is chosen too."""
    c = t["chosen"].select("instance_id", "item").distinct()
    x = t["requires"].join(c, ["instance_id", "item"], "left_semi").join(c.withColumnRenamed("item", "needs"), ["instance_id", "needs"], "left_anti")
    return violations(x, "prerequisites", "item", F.col("needs"), F.lit(None))


def covers(t: dict[str, DataFrame]) -> DataFrame:
    """(instance_id, element, n): how many chosen sets (instance_id, item) have each of the elements (instance_id, element); sets: (instance_id, item, element)."""
    n = t["sets"].join(t["chosen"].select("instance_id", "item").distinct(), ["instance_id", "item"], "left_semi").groupBy("instance_id", "element").agg(F.count(F.lit(1)).alias("n"))
    return t["elements"].join(n, ["instance_id", "element"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@audit_rule("set_cover")
def set_cover(t: dict[str, DataFrame]) -> DataFrame:
    return violations(covers(t).where("n = 0"), "set_cover", "element", F.col("n"), F.lit(1))


@audit_rule("partition")
def exact_partition(t: dict[str, DataFrame]) -> DataFrame:
    return violations(covers(t).where("n <> 1"), "partition", "element", F.col("n"), F.lit(1))


@audit_rule("portfolio")
def portfolio_limits(t: dict[str, DataFrame]) -> DataFrame:
    """weights (instance_id, asset, weight) against portfolio_limits (instance_id, total, most_held, least_weight, most_weight, least_return) and assets (instance_id, asset, sector, mean_return); sector_limits (instance_id, sector, most). least_weight holds for what is held."""
    w = t["weights"].join(t["assets"], ["instance_id", "asset"], "left")
    one = w.groupBy("instance_id").agg(F.sum("weight").alias("total_w"), F.count_if(F.col("weight") > 1e-9).alias("held"), F.sum(F.col("weight") * F.coalesce("mean_return", F.lit(0.0))).alias("ret")).join(t["portfolio_limits"], "instance_id")
    part = lambda cond, seen, limit: violations(one.where(cond), "portfolio", "instance_id", seen, limit)
    single = w.join(t["portfolio_limits"], "instance_id").where("weight > 1e-9 AND (weight < least_weight - 1e-6 OR weight > most_weight + 1e-6)")
    sector = w.groupBy("instance_id", "sector").agg(F.sum("weight").alias("s")).join(t["sector_limits"], ["instance_id", "sector"]).where("s > most + 1e-6")
    return reduce(DataFrame.union, [
        part(~close_soft(F.col("total_w"), F.col("total")), F.col("total_w"), F.col("total")), part(F.col("held") > F.col("most_held"), F.col("held"), F.col("most_held")), part(F.col("ret") < F.col("least_return") - 1e-6, F.col("ret"), F.col("least_return")),
        violations(single, "portfolio", "asset", F.col("weight"), F.when(F.col("weight") < F.col("least_weight"), F.col("least_weight")).otherwise(F.col("most_weight"))), violations(sector, "portfolio", "sector", F.col("s"), F.col("most")),
    ])


@audit_rule("no_sale")
def no_sale(t: dict[str, DataFrame]) -> DataFrame:
    """Locked assets (instance_id, asset) of the old weights are not sold: the new weight is no less."""
    x = t["old_weights"].withColumnRenamed("weight", "old").join(t["locked"], ["instance_id", "asset"], "left_semi").join(t["weights"], ["instance_id", "asset"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return violations(x.where("weight < old - 1e-6"), "no_sale", "asset", F.col("weight"), F.col("old"))


def mean_deviation(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """(instance_id, mean, mad) over equally likely scenarios of returns (instance_id, scenario, asset, value) by weights (instance_id, asset, weight)."""
    s = returns.join(weights, ["instance_id", "asset"]).groupBy("instance_id", "scenario").agg(F.sum(F.col("value") * F.col("weight")).alias("r"))
    m = s.groupBy("instance_id").agg(F.avg("r").alias("mean"))
    return s.join(m, "instance_id").groupBy("instance_id").agg(F.max("mean").alias("mean"), F.avg(F.abs(F.col("r") - F.col("mean"))).alias("mad"))


@audit_rule("levels")
def level_bounds(t: dict[str, DataFrame]) -> DataFrame:
    """levels (instance_id, entity, period, level) are 0 or within level_limits (instance_id, entity, least, most)."""
    x = t["levels"].join(t["level_limits"], ["instance_id", "entity"]).where("level <> 0 AND (level < least - 1e-6 OR level > most + 1e-6)")
    return violations(x.withColumn("at", F.concat_ws("/", "entity", "period")), "levels", "at", F.col("level"), F.when(F.col("level") < F.col("least"), F.col("least")).otherwise(F.col("most")))


@audit_rule("hiring")
def hiring(t: dict[str, DataFrame]) -> DataFrame:
    """staff (instance_id, entity, period, level, hired, fired): each level is the one before (start in the first period, from initial) plus hired less fired."""
    before = F.lag("level").over(Window.partitionBy("instance_id", "entity").orderBy("period"))
    x = t["staff"].join(t["initial"].select("instance_id", "entity", "start"), ["instance_id", "entity"], "left").withColumn("want", F.coalesce(before, F.col("start"), F.lit(0.0)) + F.col("hired") - F.col("fired"))
    return violations(x.where(~close_soft(F.col("level"), F.col("want"))).withColumn("at", F.concat_ws("/", "entity", "period")), "hiring", "at", F.col("level"), F.col("want"))


@audit_rule("duties")
def duty_legality(t: dict[str, DataFrame]) -> DataFrame:
    """legs (instance_id, duty, pos, from_place, to_place, t_start, t_end) of a duty connect: places match, gaps are within least_gap and most_gap, and it has most_legs and most_span at most and starts and ends at its base; duty_limits (instance_id, least_gap, most_gap, most_legs, most_span), bases (instance_id, duty, base)."""
    w = Window.partitionBy("instance_id", "duty").orderBy("pos")
    x = t["legs"].join(t["duty_limits"], "instance_id").withColumns({"came": F.lag("to_place").over(w), "gap": F.col("t_start") - F.lag("t_end").over(w), "at": F.concat_ws("/", "duty", "pos")})
    place = violations(x.where("came <> from_place"), "duties", "at", F.col("gap"), F.lit(None))
    gap = violations(x.where("gap < least_gap OR gap > most_gap"), "duties", "at", F.col("gap"), F.when(F.col("gap") < F.col("least_gap"), F.col("least_gap")).otherwise(F.col("most_gap")))
    d = t["legs"].groupBy("instance_id", "duty").agg(F.count(F.lit(1)).alias("n"), (F.max("t_end") - F.min("t_start")).alias("span"), F.min_by("from_place", "pos").alias("a"), F.max_by("to_place", "pos").alias("b"))
    d = d.join(t["duty_limits"], "instance_id").join(t["bases"], ["instance_id", "duty"], "left")
    legs = violations(d.where("n > most_legs"), "duties", "duty", F.col("n"), F.col("most_legs"))
    span = violations(d.where("span > most_span"), "duties", "duty", F.col("span"), F.col("most_span"))
    base = violations(d.where("base IS NOT NULL AND (a <> base OR b <> base)"), "duties", "duty", F.lit(None), F.lit(None))
    return reduce(DataFrame.union, (place, gap, legs, span, base))


def duty_costs(assigned: DataFrame, duties: DataFrame, crews: DataFrame, wishes: DataFrame, away: float, missing: float) -> DataFrame:
    """(instance_id, cost): away for each duty (instance_id, duty, base) whose crew (instance_id, crew, base) has another base, missing for each without crew, less the weights of wishes (instance_id, crew, duty, weight) that are met."""
    x = duties.join(assigned.select("instance_id", "duty", "crew"), ["instance_id", "duty"], "left").join(crews.select("instance_id", "crew", F.col("base").alias("home")), ["instance_id", "crew"], "left").join(wishes, ["instance_id", "crew", "duty"], "left")
    one = F.when(F.col("crew").isNull(), missing).otherwise(F.when(F.col("home") != F.col("base"), away).otherwise(0.0) - F.coalesce("weight", F.lit(0.0)))
    return x.groupBy("instance_id").agg(F.sum(one).alias("cost"))


@audit_rule("crews")
def crew_limits(t: dict[str, DataFrame]) -> DataFrame:
    """A crew has most (instance_id, crew, most) duties at most, and a duty one crew at most; assigned: (instance_id, crew, duty)."""
    n = t["assigned"].groupBy("instance_id", "crew").agg(F.count(F.lit(1)).alias("n")).join(t["crews"], ["instance_id", "crew"])
    m = t["assigned"].groupBy("instance_id", "duty").agg(F.countDistinct("crew").alias("n"))
    return violations(n.where("n > most"), "crews", "crew", F.col("n"), F.col("most")).union(violations(m.where("n > 1"), "crews", "duty", F.col("n"), F.lit(1)))


def cheapest_sum(costs: DataFrame, by: str) -> DataFrame:
    """(instance_id, bound): the sum of the least cost of each row or column of costs (instance_id, by, cost): no assignment is cheaper."""
    return costs.groupBy("instance_id", by).agg(F.min("cost").alias("c")).groupBy("instance_id").agg(F.sum("c").alias("bound"))


def tree_bound(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(instance_id, bound): the sum of the n - 1 cheapest edges (instance_id, edge, cost) of n nodes: no spanning tree is cheaper."""
    n = nodes.groupBy("instance_id").agg(F.countDistinct("node").alias("n"))
    k = F.row_number().over(Window.partitionBy("instance_id").orderBy("cost", "edge"))
    return edges.join(n, "instance_id").withColumn("k", k).where("k < n").groupBy("instance_id").agg(F.sum("cost").alias("bound"))


def cut_bounds(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(instance_id, high): no flow from source to sink (instance_id, source, sink, budget) is more than what leaves the source or what enters the sink.

    edges: (instance_id, u, v, capacity, expand_unit_cost). A budget widens either by as much as it buys of its cheapest edge with a unit cost.
    """
    x = edges.join(ends.where("source IS NOT NULL AND sink IS NOT NULL"), "instance_id")
    sides = []
    for at, end in (("u", "source"), ("v", "sink")):
        own = F.col(at) == F.col(end)
        more = F.coalesce(F.try_divide(F.max("budget"), F.min(F.when(own & (F.col("expand_unit_cost") != 0), F.col("expand_unit_cost")))), F.lit(0.0))
        sides.append(F.coalesce(F.sum(F.when(own, F.col("capacity"))), F.lit(0.0)) + more)
    return x.groupBy("instance_id").agg(F.least(*sides).alias("high"))


def tour_bound(edges: DataFrame) -> DataFrame:
    """(instance_id, bound): half the sum of each node's two shortest edges (instance_id, u, v, length), which may be listed in either direction or both: no tour is shorter. Nodes with one edge count it twice."""
    both = edges.where("u <> v").select("instance_id", F.col("u").alias("node"), F.col("v").alias("other"), "length").union(edges.where("u <> v").select("instance_id", "v", "u", "length"))
    near = both.groupBy("instance_id", "node", "other").agg(F.min("length").alias("length"))
    two = near.withColumn("k", F.row_number().over(Window.partitionBy("instance_id", "node").orderBy("length", "other"))).where("k <= 2")
    own = two.groupBy("instance_id", "node").agg(F.sum("length").alias("s"), F.count(F.lit(1)).alias("k"))
    return own.groupBy("instance_id").agg((F.sum(F.col("s") * 2 / F.col("k")) / 2).alias("bound"))


@audit_rule("bounds")
def bound_check(t: dict[str, DataFrame]) -> DataFrame:
    """Objectives alone (instance_id, value) lie within bounds (instance_id, low, high), either of which may be null, with the soft tolerance."""
    x = t["values"].join(t["bounds"], "instance_id")
    low = (F.col("value") < F.col("low")) & ~close_soft(F.col("value"), F.col("low"))
    high = (F.col("value") > F.col("high")) & ~close_soft(F.col("value"), F.col("high"))
    return violations(x.where(F.coalesce(low, F.lit(False)) | F.coalesce(high, F.lit(False))), "bounds", "instance_id", F.col("value"), F.when(low, F.col("low")).otherwise(F.col("high")))


def worst_scenario(opened: DataFrame, shipped: DataFrame) -> DataFrame:
    """(instance_id, cost): opening costs (instance_id, cost) plus the transport costs of the dearest scenario of shipped (instance_id, scenario, amount, unit_cost)."""
    s = shipped.groupBy("instance_id", "scenario").agg(F.sum(F.col("amount") * F.col("unit_cost")).alias("c")).groupBy("instance_id").agg(F.max("c").alias("c"))
    o = opened.groupBy("instance_id").agg(F.sum("cost").alias("o"))
    return o.join(s, "instance_id", "full_outer").select("instance_id", (F.coalesce("o", F.lit(0.0)) + F.coalesce("c", F.lit(0.0))).alias("cost"))


@audit_rule("scenario_outflow")
def scenario_outflow(t: dict[str, DataFrame]) -> DataFrame:
    """In each scenario, what a facility ships (instance_id, scenario, facility, amount) is within capacities (instance_id, facility, capacity), 0 for unknown ones."""
    s = t["shipped"].groupBy("instance_id", "scenario", "facility").agg(F.sum("amount").alias("s")).join(t["capacities"], ["instance_id", "facility"], "left").withColumn("capacity", F.coalesce("capacity", F.lit(0.0)))
    return violations(s.where("s > capacity + 1e-6").withColumn("at", F.concat_ws("/", "scenario", "facility")), "scenario_outflow", "at", F.col("s"), F.col("capacity"))


def partial_credit(parts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """parts (instance_id, a column of shares from 0 to 1 for each weight) with partial: their weighted sum, from 0 to 1; null shares count as 0.

    Weights in use: tours 0.8, 0.1, 0.1 and routes 0.4, 0.3, 0.3 (visited, not repeated, within capacity), sequences 0.7, 0.3, vehicles 0.5, 0.4, 0.1.
    """
    total = sum((w * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(0.0)))) for c, w in weights.items()), F.lit(0.0))
    return parts.withColumn("partial", total)


def distinct_groups(rows: DataFrame, group: str) -> DataFrame:
    """(instance_id, n): how many different groups, such as trains, the rows of each instance use; nulls do not count."""
    return rows.groupBy("instance_id").agg(F.countDistinct(group).alias("n"))
