"""Checks of packing and shop scheduling kinds from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numbers import close

from .audit import violations
from .kinds import Audit, Keep, all_of, each, first_of, get, is_object, items, kind_check, loose, mismatch, number, sort_of
from .kinds_rosters import entries

EPS = 1e-6


def any_of(v: Column | str, *names: str) -> Column:
    """The first of the names that is there, else in any case."""
    low = F.transform(entries(v), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    is_named = lambda n: lambda e: e["key"] == n.lower()
    named = [F.try_element_at(F.filter(low, is_named(n)), F.lit(1))["value"] for n in names]
    return F.when(is_object(F.col(v) if isinstance(v, str) else v), F.coalesce(first_of(v, *names), *named))


def index_of(key: Column) -> Column:
    """The whole number that a key is, or that it ends in as its only one."""
    n = key.try_cast("double")
    return F.coalesce(F.when(n == F.floor(n), n.cast("long")), F.when(n.isNull() & key.rlike(r"^\D*\d+\s*$"), F.regexp_extract(key, r"(\d+)", 1).try_cast("long")))


def indexed(v: Column) -> Column:
    """(at, value) of a map by number or of a list by place; null if a key is no number."""
    mapped = F.transform(entries(v), lambda e: F.struct(index_of(e["key"]).alias("at"), e["value"].alias("value")))
    listed = F.transform(items(v), lambda x, i: F.struct(i.cast("long").alias("at"), x.alias("value")))
    found = F.when(sort_of(v) == "array", listed).when(is_object(v), mapped)
    return F.when(~F.exists(found, lambda e: e["at"].isNull()), found)


def whole_list(v: Column) -> Column:
    """Whole numbers of a list, or of a map's values; null if one is none."""
    listed = F.when(sort_of(v) == "array", items(v)).when(is_object(v), F.transform(entries(v), lambda e: e["value"]))
    n = F.transform(listed, loose)
    return F.when(F.forall(n, lambda x: F.coalesce(x == F.floor(x), F.lit(False))), F.transform(n, lambda x: x.cast("long")))


@kind_check("bin_packing")
def bin_packing(rows: DataFrame, keep: Keep) -> Audit:
    """Each item is in one bin, bins hold what fits, and the declared number of bins is that of bins with items."""
    x = keep(rows.select("instance_id", "p", any_of("a", "bins", "assignment", "packing").alias("b"), any_of("a", "min_bins", "num_bins", "objective_value").alias("s")), "fields")
    x = x.select("instance_id", "p", indexed(F.col("b")).alias("bins"), F.coalesce(loose(get("p", "$.bin_capacity")), F.lit(0.0)).alias("room"), loose(F.col("s")).alias("said")).where("bins IS NOT NULL")
    x = keep(x, "answers")
    sizes = each(x, ["instance_id"], F.transform(F.array_sort(F.coalesce(indexed(get("p", "$.item_sizes")), F.array().cast("array<struct<at: bigint, value: variant>>")), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)), lambda e: loose(e["value"])))
    sizes = sizes.select("instance_id", F.col("pos").cast("long").alias("item"), F.col("item").alias("size"))
    b = x.select("instance_id", "room", F.explode("bins").alias("b")).select("instance_id", "room", F.col("b.at").alias("bin"), whole_list(F.col("b.value")).alias("held"))
    b, sizes = keep(b, "bins"), keep(sizes, "sizes")
    odd = violations(b.where("held IS NULL").withColumn("at", F.concat(F.lit("bin "), F.col("bin"))), "index", "at", F.lit(None), F.lit(None))
    placed = b.select("instance_id", "room", "bin", F.explode("held").alias("item"))
    load = placed.join(sizes, ["instance_id", "item"]).groupBy("instance_id", "bin").agg(F.sum("size").alias("load"), F.max("room").alias("room"))
    heavy = violations(load.where(F.col("load") > F.col("room") + EPS), "capacity", "bin", F.col("load"), F.col("room"))
    need = x.select("instance_id").join(sizes.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n")), "instance_id", "left").fillna(0, ["n"])
    n = placed.groupBy("instance_id", "item").agg(F.count(F.lit(1)).alias("k")).join(need, "instance_id")
    inside = F.col("item").between(0, F.col("n") - 1)
    own = n.groupBy("instance_id").agg(F.count_if(~inside).alias("outside"), F.count_if(F.col("k") > 1).alias("again"), F.count_if(inside).alias("there"))
    y = keep(need.join(own, "instance_id", "left").fillna(0), "sums").withColumn("missing", F.col("n") - F.col("there"))
    one = lambda cond, rule, what, seen: violations(y.where(cond).withColumn("at", F.lit(what)), rule, "at", seen, F.lit(0))
    used = b.groupBy("instance_id").agg(F.count_if(F.size("held") > 0).alias("used"), F.count(F.lit(1)).alias("bins"))
    z = x.select("instance_id", "said").join(used, "instance_id", "left").fillna(0, ["used", "bins"])
    wrong = violations(z.where(~close(F.col("said"), F.col("used"))).withColumn("at", F.lit("bins")), "declared", "at", F.col("said"), F.col("used"))
    found = all_of(odd, heavy, one(F.col("outside") > 0, "index", "outside", F.col("outside")), one(F.col("again") > 0, "index", "again", F.col("again")), one((F.col("missing") > 0) | (F.col("outside") > 0), "coverage", "missing", F.col("missing")), wrong)
    return Audit(found, z.select("instance_id", F.lit(True).alias("readable"), (F.col("bins") + 3).alias("total"), F.lit(None).cast("double").alias("cost")))


def overlaps(spans: DataFrame, by: str) -> DataFrame:
    """Spans (instance_id, by, item, t_start, t_end) that begin before the latest end so far on what they share."""
    w = Window.partitionBy("instance_id", by).orderBy("t_start", "t_end", "item").rowsBetween(Window.unboundedPreceding, -1)
    return violations(spans.withColumn("latest", F.max("t_end").over(w)).where("t_start < latest").withColumn("at", F.concat_ws("/", by, "item")), "overlap", "at", F.col("t_start"), F.col("latest"))


@kind_check("job_shop")
def job_shop(rows: DataFrame, keep: Keep) -> Audit:
    """Each job's operations run on their machines for their times, one after the other, machines run one at a time, and the makespan is the last end."""
    x = keep(rows.withColumn("plan", indexed(get("a", "$.schedule"))).where("plan IS NOT NULL"), "plans")
    jobs = each(x, ["instance_id", "plan"], get("p", "$.jobs", "array<variant>"))
    jobs = jobs.select("instance_id", "plan", F.col("pos").alias("job"), F.coalesce(loose(get("item", "$.id")), F.col("pos") + 1.0).cast("long").alias("id"), get("item", "$.operations", "array<variant>").alias("ops"))
    planned = F.try_element_at(F.filter("plan", lambda e: e["at"] == F.col("id")), F.lit(-1))["value"]
    by_number = F.transform(F.array_sort(indexed(planned), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)), lambda e: e["value"])
    listed = F.when(sort_of(planned) == "array", items(planned)).when(is_object(planned), by_number)
    jobs = keep(jobs.withColumn("rows", listed).drop("plan"), "jobs")
    whole = F.coalesce(F.size("rows") == F.size("ops"), F.lit(False))
    name = F.concat(F.lit("job "), F.col("id"))
    partial = violations(jobs.where(~whole).withColumn("at", name), "operations", "at", F.size("rows"), F.size("ops"))
    numbered = F.forall("rows", lambda r: F.coalesce(is_object(r) & loose(get(r, "$.operation")).isNotNull(), F.lit(False)))
    in_order = F.transform(F.array_sort(F.transform("rows", lambda r, i: F.struct(loose(get(r, "$.operation")).alias("k"), i.alias("i"), r.alias("r"))), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).when(a["i"] < b["i"], -1).otherwise(1)), lambda s: s["r"])
    jobs = jobs.where(whole).withColumn("rows", F.when(numbered, in_order).otherwise(F.col("rows")))
    o = jobs.select("instance_id", "job", "id", F.posexplode(F.arrays_zip("ops", "rows")).alias("pos", "z"))
    start, end = (F.when(is_object(F.col("z.rows")), loose(first_of("z.rows", f"{c}_time", c))) for c in ("start", "end"))
    o = o.select("instance_id", "job", "id", "pos", loose(get("z.ops", "$.machine")).alias("machine"), loose(get("z.rows", "$.machine")).alias("own"), F.coalesce(loose(get("z.ops", "$.processing_time")), F.lit(0.0)).alias("time"), start.alias("t_start"), end.alias("t_end"))
    w = Window.partitionBy("instance_id", "job").orderBy("pos")
    timed = F.col("t_start").isNotNull() & F.col("t_end").isNotNull()
    o = o.withColumns({"lost": F.count_if(~timed).over(w.rowsBetween(Window.unboundedPreceding, 0)), "before": F.coalesce(F.lag("t_end").over(w), F.lit(0.0)), "at": F.concat_ws("/", F.col("id").cast("string"), F.col("pos").cast("string"))})
    o = keep(o, "operations")
    timeless = violations(o.where((F.col("lost") == 1) & ~timed), "operations", "at", F.lit(None), F.lit(None))
    o = o.where("lost = 0")
    span = F.col("t_end") - F.col("t_start")
    part = lambda cond, what, seen, limit: violations(o.where(cond).withColumn("at", F.concat_ws("/", "at", F.lit(what))), "operations", "at", seen, limit)
    wrong = part(F.col("own").isNull() | ~close(F.col("own"), F.coalesce("machine", F.lit(-1.0))), "machine", F.col("own"), F.col("machine"))
    short = part(~close(span, F.col("time")), "time", span, F.col("time"))
    early = part(F.col("t_start") < F.col("before"), "early", F.col("t_start"), F.col("before"))
    spans = o.select("instance_id", F.col("machine").cast("string").alias("machine"), F.col("at").alias("item"), "t_start", "t_end")
    done = o.groupBy("instance_id").agg(F.max("t_end").alias("finish"), F.countDistinct("machine").alias("machines"))
    y = x.select("instance_id", "a", F.size(get("p", "$.jobs", "array<variant>")).alias("n")).join(done, "instance_id", "left").fillna(0.0, ["finish"]).fillna(0, ["machines"]).withColumn("said", loose(get("a", "$.makespan")))
    bad = F.col("said").isNull() | ~close(F.col("said"), F.col("finish"))
    makespan = violations(y.where(bad).withColumn("at", F.lit("makespan")), "declared", "at", F.col("said"), F.col("finish"))
    return Audit(all_of(partial, timeless, wrong, short, early, overlaps(spans, "machine"), makespan), y.select("instance_id", F.lit(True).alias("readable"), (F.col("n") + F.col("machines") + 1).alias("total"), F.col("finish").alias("cost")))


def name_of(v: Column) -> Column:
    """Names of jobs and machines, which may be numbers: 1, 1.0 and "1" are one."""
    n = number(v)
    return F.coalesce(F.when(n == F.floor(n), n.cast("long").cast("string")), F.trim(get(v, "$", "string")))


def flexible_shop(rows: DataFrame, with_setup: bool, keep: Keep) -> Audit:
    """Each operation is planned once, on one of its machines for the time that it takes there, after its job's release and earlier operations; machines run one at a time, and with_setup, leave setup times between jobs and pause in breakdowns."""
    plan = F.col("a")
    s = get(plan, "$.schedule")
    listed = F.when(sort_of(s) == "array", F.transform(items(s), lambda r: F.struct(F.lit(None).cast("string").alias("job"), r.alias("r"))))
    nested = F.flatten(F.transform(F.filter(entries(s), lambda e: F.coalesce(sort_of(e["value"]) == "array", F.lit(False))), lambda e: F.transform(items(e["value"]), lambda r: F.struct(F.trim(e["key"]).alias("job"), r.alias("r")))))
    x = rows.where(is_object(plan)).withColumn("rows", F.when(sort_of(s) == "array", listed).when(is_object(s), nested)).where("rows IS NOT NULL")
    flat = x.select("instance_id", F.posexplode_outer("rows").alias("k", "s")).select("instance_id", "k", F.col("s.job").alias("job"), F.col("s.r").alias("r"))
    raw = flat.select("instance_id", "k", "job", any_of("r", "job_id", "job").alias("own"), any_of("r", "op_index", "operation", "op").alias("op"), any_of("r", "machine", "machine_id").alias("machine"), any_of("r", "start", "start_time").alias("t_start"), any_of("r", "end", "end_time").alias("t_end"))
    raw = keep(raw, "raw")
    read = raw.select("instance_id", "k", F.coalesce("job", name_of(F.col("own"))).alias("job"), "op", name_of(F.col("machine")).alias("machine"), number(F.col("t_start")).alias("t_start"), number(F.col("t_end")).alias("t_end"))
    dark = read.where("k IS NOT NULL AND (job IS NULL OR op IS NULL OR machine IS NULL OR t_start IS NULL OR t_end IS NULL)").select("instance_id").distinct()
    x, read = x.join(dark, "instance_id", "left_anti"), read.where("k IS NOT NULL").join(dark, "instance_id", "left_anti").withColumn("op", F.coalesce(name_of(F.col("op")).try_cast("long"), F.lit(-1).cast("long")))
    x, read = keep(x.select("instance_id", "p", "a"), "answers"), keep(read, "planned")
    jobs = each(x, ["instance_id"], get("p", "$.jobs", "array<variant>")).select("instance_id", name_of(get("item", "$.id")).alias("job"), F.coalesce(get("item", "$.release_time", "double"), F.lit(0.0)).alias("release"), get("item", "$.operations", "array<variant>").alias("ops"))
    ops = each(jobs, ["instance_id", "job", "release"], F.col("ops")).select("instance_id", "job", "release", "pos", get("item", "$.op_index", "long").alias("op"), get("item", "$.machine_options", "map<string,double>").alias("options"))
    ops = keep(ops, "operations")
    known = ops.select("instance_id", "job", (F.col("pos") + 1).cast("long").alias("op"))
    at = lambda df: df.withColumn("at", F.concat_ws("/", "job", "op"))
    unknown = violations(at(read.join(known, ["instance_id", "job", "op"], "left_anti")), "operations", "at", F.lit(None), F.lit(None))
    turn = F.row_number().over(Window.partitionBy("instance_id", "job", "op").orderBy("k"))
    mine = read.join(known, ["instance_id", "job", "op"], "left_semi").withColumn("turn", turn)
    twice = violations(at(mine.where("turn > 1")), "operations", "at", F.col("turn"), F.lit(1))
    mine = keep(mine.where("turn = 1").drop("turn"), "mine")
    y = at(ops.join(mine, ["instance_id", "job", "op"], "left"))
    lost = violations(y.where("t_start IS NULL"), "coverage", "at", F.lit(0), F.lit(1))
    w = Window.partitionBy("instance_id", "job").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    y = y.withColumns({"time": F.try_element_at("options", "machine"), "ready": F.greatest("release", F.coalesce(F.max("t_end").over(w), F.col("release")))})
    y = keep(y, "in-order").where("t_start IS NOT NULL")
    span = F.col("t_end") - F.col("t_start")
    part = lambda cond, what, seen, limit: violations(y.where(cond).withColumn("at", F.concat_ws("/", "at", F.lit(what))), "operations", "at", seen, limit)
    elsewhere = part(F.col("time").isNull(), "machine", F.lit(None), F.lit(None))
    short = part(F.abs(span - F.col("time")) > EPS, "time", span, F.col("time"))
    early = part(F.col("t_start") < F.col("ready") - EPS, "early", F.col("t_start"), F.col("ready"))
    machines = each(x, ["instance_id"], get("p", "$.machines", "array<variant>")).select("instance_id", F.when(is_object(F.col("item")), name_of(get("item", "$.id"))).otherwise(name_of(F.col("item"))).alias("machine"))
    on = at(mine.join(machines, ["instance_id", "machine"], "left_semi"))
    nowhere = violations(at(mine.join(machines, ["instance_id", "machine"], "left_anti")), "fit", "at", F.lit(None), F.lit(None))
    w = Window.partitionBy("instance_id", "machine").orderBy("t_start", "t_end", "k")
    z = on.withColumns({"last_job": F.lag("job").over(w), "free": F.lag("t_end").over(w)}).where("free IS NOT NULL").join(x.select("instance_id", "p"), "instance_id")
    found = [unknown, twice, lost, elsewhere, short, early, nowhere]
    setup = F.lit(0.0)
    if with_setup:
        of = lambda v, name: F.try_element_at(get(v, "$", "map<string,variant>"), name)
        setup = F.coalesce(number(of(of(of(get("p", "$.setups"), F.col("machine")), F.col("last_job")), F.col("job"))), F.lit(0.0))
        pauses = x.select("instance_id", F.explode(entries(get("p", "$.breakdowns"))).alias("e")).select("instance_id", F.trim("e.key").alias("machine"), F.explode(items("e.value")).alias("b"))
        begin = F.coalesce(get("b", "$.start", "double"), F.lit(0.0))
        pauses = pauses.select("instance_id", "machine", begin.alias("b_start"), F.coalesce(get("b", "$.end", "double"), begin + F.coalesce(get("b", "$.duration", "double"), F.lit(0.0))).alias("b_end"))
        hit = on.join(pauses, ["instance_id", "machine"]).where(F.col("t_start") < F.col("b_end") - EPS).where(F.col("t_end") > F.col("b_start") + EPS)
        found.append(violations(hit, "blocked", "at", F.col("t_start"), F.col("b_end")))
    z = z.withColumn("ready", F.col("free") + setup)
    found.append(violations(z.where(F.col("t_start") < F.col("ready") - EPS), "overlap", "at", F.col("t_start"), F.col("ready")))
    size = ops.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_ops"))
    end = mine.groupBy("instance_id").agg(F.max("t_end").alias("cost"))
    out = x.select("instance_id", "a", F.size(get("p", "$.machines", "array<variant>")).alias("m")).join(size, "instance_id", "left").join(end, "instance_id", "left").fillna(0.0, ["cost"]).fillna(0, ["n_ops"])
    out = keep(out.withColumn("s", any_of("a", "makespan", "objective_value")), "sums")
    found.append(mismatch(out, number(F.col("s")), "cost"))
    return Audit(all_of(*found), out.select("instance_id", F.lit(True).alias("readable"), (3 * F.col("n_ops") + (3 if with_setup else 1) * F.col("m") + 1).alias("total"), "cost"))


@kind_check("fjsp")
def flexible_job_shop(rows: DataFrame, keep: Keep) -> Audit:
    return flexible_shop(rows, False, keep)


@kind_check("fjsp_setup")
def flexible_job_shop_setups(rows: DataFrame, keep: Keep) -> Audit:
    return flexible_shop(rows, True, keep)
