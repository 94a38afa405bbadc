"""Checks of rosters and crew pairings from JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audit import violations
from .kinds import Audit, Keep, all_of, each, fields, first_of, get, is_list, is_object, items, kind_check, mismatch, number, sort_of, whole_id

EPS = 1e-6
#: Names that answers use for the same thing.
ROSTER = ["roster", "roster_by_staff", "roster_by_nurse", "schedule"]
PERSON = ["nurse_id", "nurse", "staff_id", "staff", "person_id", "person", "employee_id", "employee", "id"]
ROW = ["schedule", "shifts", "days", "states", "roster"]
LABEL = ["id", "pairing_id", "pairing_index", "name"]
UNCOVERED = ["uncovered_flights", "outsourced_flights", "uncovered"]
RESERVED = [*UNCOVERED, "pairings", "assignments", "unassigned_pairings", "generated_columns", "cost", "num_pairings", "num_uncovered"]


def entries(v: Column) -> Column:
    """(key, value) of an object's fields, as an array; null for what is no object."""
    return F.when(is_object(v), F.transform(fields(v), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def state_cells(rows: DataFrame, people: DataFrame, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """(instance_id, person, day, state, region) of each person and day, and the instances whose answer can be read.

    Rosters are maps of people to days, records of a person with days or of a person and a day, or lists in the order of the people. Who is not in the
    roster is off on all days; days are from 1. rows: (instance_id, p, a, n_days, states); people: (instance_id, person, pos).
    """
    n_people = people.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_people"))
    x = rows.join(n_people, "instance_id").select("instance_id", "n_days", "states", "n_people", F.when(is_object(F.col("a")), first_of("a", *ROSTER)).alias("r"))
    first = F.get(items("r"), 0)
    objects = F.forall(items("r"), is_object)
    by_person = F.coalesce(objects & (F.size(items("r")) > 0) & first_of(first, *ROW).isNotNull(), F.lit(False))
    by_day = F.coalesce(objects & (F.size(items("r")) > 0) & ~by_person & get(first, "$.day").isNotNull(), F.lit(False))
    in_order = F.coalesce((sort_of("r") == "array") & (F.size(items("r")) == F.col("n_people")), F.lit(False))
    form = F.when(is_object(F.col("r")), "map").when((sort_of("r") == "array") & (F.size(items("r")) == 0), "none").when(by_person, "person").when(by_day, "day").when(in_order, "order")
    x = x.withColumn("form", form)

    x = keep(x.drop("n_people"), "rosters")
    own = ["instance_id", "n_days", "states"]
    mapped = x.where("form = 'map'").select(*own, F.explode(entries(F.col("r"))).alias("e")).select(*own, F.col("e.key").try_cast("double").cast("long").alias("person"), F.col("e.value").alias("days"))
    records = each(x.where("form = 'person'"), own, items("r")).select(*own, whole_id(first_of("item", *PERSON)).alias("person"), first_of("item", *ROW).alias("days"))
    ordered = each(x.where("form = 'order'"), own, items("r")).join(people, ["instance_id", "pos"]).select(*own, "person", F.col("item").alias("days"))
    whole = keep(mapped.union(records).union(ordered), "person-days")
    row_good = F.coalesce((sort_of("days") == "array") & (F.size(items("days")) == F.col("n_days")) & F.col("person").isNotNull(), F.lit(False))
    rows_read = whole.withColumn("good", row_good).groupBy("instance_id").agg(F.min(F.col("good").cast("int")).alias("good"), (F.count(F.lit(1)) == F.countDistinct("person")).alias("once"))
    flat = each(whole.where(row_good), [*own, "person"], items("days")).select(*own, "person", (F.col("pos") + 1).cast("long").alias("day"), "item")
    days = each(x.where("form = 'day'"), own, items("r")).select(*own, whole_id(first_of("item", *PERSON)).alias("person"), whole_id(get("item", "$.day")).alias("day"), "item")
    days_read = days.groupBy("instance_id").agg(F.min(F.coalesce(F.col("person").isNotNull() & F.col("day").between(1, F.col("n_days")), F.lit(False)).cast("int")).alias("good"), ((F.count(F.lit(1)) == F.countDistinct("person", "day")) & (F.count(F.lit(1)) == F.countDistinct("person") * F.max("n_days"))).alias("once"))
    said = F.when(is_object(F.col("item")), first_of("item", "state", "shift")).otherwise(F.col("item"))
    cells = flat.union(days).select(*own, "person", "day", get(said, "$", "string").alias("state"), F.when(is_object(F.col("item")), get("item", "$.region", "string")).alias("region"))
    cells = keep(cells, "cells-read")
    known = cells.join(people.select("instance_id", "person", F.lit(True).alias("here")), ["instance_id", "person"], "left")
    cells_read = known.groupBy("instance_id").agg(F.min((F.coalesce(F.array_contains("states", F.col("state")), F.lit(False)) & F.col("here").isNotNull()).cast("int")).alias("cells"))
    read = x.where("form IS NOT NULL").select("instance_id", "form").join(rows_read.union(days_read), "instance_id", "left").join(cells_read, "instance_id", "left")
    read = read.where("form = 'none' OR coalesce(good = 1 AND once, true) AND coalesce(cells = 1, true)").select("instance_id")
    read = keep(read, "read")
    every = people.join(read, "instance_id").join(rows.select("instance_id", "n_days"), "instance_id").select("instance_id", "person", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_days").cast("long"))).alias("day"))
    out = every.join(cells.select("instance_id", "person", "day", "state", "region"), ["instance_id", "person", "day"], "left").withColumn("state", F.coalesce("state", F.lit("off")))
    return keep(out, "cells"), read


def labour_rules(cells: DataFrame, rules: DataFrame, keep: Keep) -> DataFrame:
    """At most one violation for each person and rule: forbidden transitions, lengths of night blocks, rest after them, work days in a row and in a calendar week, days off and nights.

    rules: (instance_id, forbidden, least_nights, most_nights, rest, most_in_row, most_in_week, least_off, most_nights_in_all).
    """
    who = ["instance_id", "person"]
    w = Window.partitionBy(*who).orderBy("day")
    work = F.col("state") != "off"
    x = cells.join(rules, "instance_id")
    x = x.withColumns({
        "step": F.concat(F.lag("state").over(w), F.lit("->"), F.col("state")),
        "next_work": F.min(F.when(work, F.col("day"))).over(w.rowsBetween(1, Window.unboundedFollowing)),
        "night_run": F.when(F.col("state") == "night", F.col("day") - F.count_if(F.col("state") == "night").over(w.rowsBetween(Window.unboundedPreceding, 0))),
        "work_run": F.when(work, F.col("day") - F.count_if(work).over(w.rowsBetween(Window.unboundedPreceding, 0))),
    })
    x = keep(x, "days")
    limit = lambda c: F.max(c).alias(c)
    blocks = x.where("night_run IS NOT NULL").groupBy(*who, "night_run").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("last"), F.max_by("next_work", "day").alias("next_work"), *map(limit, ("least_nights", "most_nights", "rest")))
    runs = x.where("work_run IS NOT NULL").groupBy(*who, "work_run").agg(F.count(F.lit(1)).alias("n"), limit("most_in_row"))
    weeks = x.groupBy(*who, F.floor((F.col("day") - 1) / 7).alias("week")).agg(F.count_if(work).alias("n"), limit("most_in_week"))
    totals = x.groupBy(*who).agg(F.count_if(~work).alias("off"), F.count_if(F.col("state") == "night").alias("nights"), limit("least_off"), limit("most_nights_in_all"))
    bad = x.where(F.array_contains("forbidden", F.col("step")))

    def one(found: DataFrame, rule: str, what: str) -> DataFrame:
        n = found.groupBy(*who).agg(F.count(F.lit(1)).alias("n"))
        return violations(n.withColumn("at", F.concat_ws("/", F.col("person").cast("string"), F.lit(what))), rule, "at", F.col("n"), F.lit(0))

    return all_of(
        one(bad, "sequence", "transition"), one(blocks.where("n < least_nights OR n > most_nights"), "runs", "nights"), one(blocks.where("next_work - last <= rest"), "runs", "rest"), one(runs.where("n > most_in_row"), "runs", "work"),
        one(weeks.where("n > most_in_week"), "blocks", "week"), one(totals.where("off < least_off"), "totals", "off"), one(totals.where("nights > most_nights_in_all"), "totals", "nights"),
    )


def rules_of(rows: DataFrame) -> DataFrame:
    n = lambda name, as_: get("p", f"$.rules.{name}", "double").alias(as_)
    return rows.select(
        "instance_id", F.coalesce(get("p", "$.rules.forbidden_transitions", "array<string>"), F.array().cast("array<string>")).alias("forbidden"), n("min_consecutive_nights", "least_nights"), n("max_consecutive_nights", "most_nights"), n("rest_days_after_night_block", "rest"),
        n("max_consecutive_work_days", "most_in_row"), n("max_work_days_per_week", "most_in_week"), n("min_off_days", "least_off"), n("max_nights", "most_nights_in_all"),
    )


def roster_cost(rows: DataFrame, cells: DataFrame, shortage: DataFrame, wishes: DataFrame) -> DataFrame:
    """(instance_id, cost): weights of missing staff, days off that were wished for and are worked (wishes: instance_id, person, day, weight), weekends off that are missing, and how far work days lie from their mean, rounded. Day 6 and 7 are a weekend."""
    pen = lambda c: get("p", f"$.penalties.{c}", "double")
    own = rows.select("instance_id", pen("shortage").alias("w_short"), pen("preference").alias("w_pref"), pen("weekend_off").alias("w_week"), pen("imbalance").alias("w_even"), get("p", "$.rules.min_full_weekend_off", "double").alias("least"))
    work = F.col("state") != "off"
    pref = wishes.join(cells.where(work), ["instance_id", "person", "day"]).groupBy("instance_id").agg(F.sum("weight").alias("pref"))
    place = (F.col("day") - 1) % 7
    pairs = cells.where(place.isin(5, 6)).groupBy("instance_id", "person", F.floor((F.col("day") - 1) / 7).alias("week")).agg(((F.count_if(~work) == 2) & (F.count(F.lit(1)) == 2)).cast("int").alias("full"))
    people = cells.groupBy("instance_id", "person").agg(F.count_if(work).alias("work"))
    full = people.join(pairs.groupBy("instance_id", "person").agg(F.sum("full").alias("full")), ["instance_id", "person"], "left").join(own.select("instance_id", "least"), "instance_id")
    weekend = full.groupBy("instance_id").agg(F.sum(F.greatest(F.lit(0.0), F.col("least") - F.coalesce("full", F.lit(0)))).alias("weekend"))
    mean = people.withColumn("mean", F.avg("work").over(Window.partitionBy("instance_id")))
    even = mean.groupBy("instance_id").agg(F.bround(F.sum(F.abs(F.col("work") - F.col("mean")))).alias("even"))
    x = reduce(lambda a, b: a.join(b, "instance_id", "left"), (shortage, pref, weekend, even), own)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return x.select("instance_id", (F.col("w_short") * zero("shortage") + F.col("w_pref") * zero("pref") + F.col("w_week") * zero("weekend") + F.col("w_even") * zero("even")).alias("cost"))


@kind_check("nurse_roster")
def nurse_roster(rows: DataFrame, keep: Keep) -> Audit:
    """Labour rules of each nurse; missing staff of each shift but day, and wishes, are costs."""
    people = each(rows, ["instance_id"], get("p", "$.nurses", "array<variant>")).select("instance_id", "pos", whole_id(get("item", "$.id")).alias("person"), get("item", "$.preferred_off_days", "array<variant>").alias("wished"))
    odd = people.where("person IS NULL").select("instance_id").distinct()
    needs = get("p", "$.daily_requirements", "array<variant>")
    shifts = F.coalesce(get("p", "$.shifts", "array<string>"), F.array().cast("array<string>"))
    own = rows.where((F.size(needs) > 0) & (F.size(get("p", "$.nurses", "array<variant>")) > 0)).join(odd, "instance_id", "left_anti").select("instance_id", "p", "a", F.size(needs).alias("n_days"), F.concat(shifts, F.array(F.lit("off"))).alias("states"))
    people = keep(people.join(own.select("instance_id"), "instance_id"), "people")
    cells, read = state_cells(own, people.select("instance_id", "person", "pos"), keep)
    own = keep(own.join(read, "instance_id"), "own")
    need = each(own, ["instance_id"], needs).select("instance_id", (F.col("pos") + 1).cast("long").alias("day"), F.explode(fields("item")).alias("e")).select("instance_id", "day", F.col("e.key").alias("state"), number(F.col("e.value")).alias("need")).where("state <> 'day'")
    n = cells.groupBy("instance_id", "day", "state").agg(F.count(F.lit(1)).alias("n"))
    shortage = need.join(n, ["instance_id", "day", "state"], "left").groupBy("instance_id").agg(F.sum(F.greatest(F.lit(0.0), F.col("need") - F.coalesce("n", F.lit(0)))).alias("shortage"))
    wishes = people.select("instance_id", "person", F.explode("wished").alias("d")).select("instance_id", "person", whole_id(F.col("d")).alias("day"), F.lit(1).alias("weight"))
    cost = keep(own.select("instance_id", "a").join(roster_cost(own, cells, shortage, wishes), "instance_id"), "costs")
    size = people.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"))
    wrong = mismatch(cost, number(first_of("a", "objective_value", "objective", "total_cost")), "cost")
    seen = cost.join(size, "instance_id").select("instance_id", F.lit(True).alias("readable"), (F.col("n") * 7 + 1).alias("total"), "cost")
    return Audit(all_of(labour_rules(cells, rules_of(own), keep), wrong), seen)


@kind_check("role_roster")
def role_roster(rows: DataFrame, keep: Keep) -> Audit:
    """As of nurses; besides, staff work in their home region, only the qualified at night, and what is needed is told by role, shift and region. A work day without a region is at home; wishes weigh by seniority."""
    v = each(rows, ["instance_id"], get("p", "$.staff", "array<variant>"))
    s = lambda c: get("item", f"$.{c}", "string").alias(c)
    people = v.select("instance_id", "pos", whole_id(get("item", "$.id")).alias("person"), get("item", "$.preferred_off_days", "array<variant>").alias("wished"), s("role"), s("region").alias("home"), F.coalesce(get("item", "$.qualified", "boolean"), F.lit(False)).alias("qualified"), F.coalesce(get("item", "$.seniority", "double"), F.lit(1.0)).alias("seniority"))
    odd = people.where("person IS NULL").select("instance_id").distinct()
    needs = get("p", "$.daily_requirements", "array<variant>")
    shifts = F.coalesce(get("p", "$.shifts", "array<string>"), F.array().cast("array<string>"))
    own = rows.where((F.size(needs) > 0) & (F.size(get("p", "$.staff", "array<variant>")) > 0)).join(odd, "instance_id", "left_anti").select("instance_id", "p", "a", F.size(needs).alias("n_days"), F.concat(shifts, F.array(F.lit("off"))).alias("states"), F.coalesce(get("p", "$.rules.night_requires_qualified", "boolean"), F.lit(True)).alias("strict"))
    people = keep(people.join(own.select("instance_id"), "instance_id"), "people")
    cells, read = state_cells(own, people.select("instance_id", "person", "pos"), keep)
    own = keep(own.join(read, "instance_id"), "own")
    known = keep(cells.join(people.select("instance_id", "person", "role", "home", "qualified"), ["instance_id", "person"]).join(own.select("instance_id", "strict"), "instance_id"), "known")

    def one(cond: Column, what: str) -> DataFrame:
        n = known.where(cond).groupBy("instance_id", "person").agg(F.count(F.lit(1)).alias("n"))
        return violations(n.withColumn("at", F.concat_ws("/", F.col("person").cast("string"), F.lit(what))), "fit", "at", F.col("n"), F.lit(0))

    work = F.col("state") != "off"
    away = one(work & F.col("region").isNotNull() & ~F.col("region").eqNullSafe(F.col("home")), "region")
    nights = one(F.col("strict") & ~F.col("qualified") & (F.col("state") == "night"), "qualified")
    need = each(own, ["instance_id"], needs).select("instance_id", (F.col("pos") + 1).cast("long").alias("day"), F.explode(fields("item")).alias("e")).where(F.col("e.key") != "day")
    need = need.select("instance_id", "day", F.col("e.key").alias("key"), number(F.col("e.value")).alias("need"))
    n = known.where(work).groupBy("instance_id", "day", F.concat_ws("_", "role", "state", F.coalesce("region", "home")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    shortage = need.join(n, ["instance_id", "day", "key"], "left").groupBy("instance_id").agg(F.sum(F.greatest(F.lit(0.0), F.col("need") - F.coalesce("n", F.lit(0)))).alias("shortage"))
    wishes = people.select("instance_id", "person", F.col("seniority").alias("weight"), F.explode("wished").alias("d")).select("instance_id", "person", whole_id(F.col("d")).alias("day"), "weight")
    cost = keep(own.select("instance_id", "a").join(roster_cost(own, cells, shortage, wishes), "instance_id"), "costs")
    size = people.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"))
    wrong = mismatch(cost, number(first_of("a", "objective_value", "objective", "total_cost")), "cost")
    seen = cost.join(size, "instance_id").select("instance_id", F.lit(True).alias("readable"), (F.col("n") * 9 + 1).alias("total"), "cost")
    return Audit(all_of(labour_rules(cells, rules_of(own), keep), away, nights, wrong), seen)


def label(v: Column) -> Column:
    """The name of a pairing: a whole number, or a text without the space around it."""
    n = whole_id(v)
    return F.coalesce(n.cast("string"), F.when(sort_of(v) == "string", F.nullif(F.trim(get(v, "$", "string")), F.lit(""))))


def key_label(key: Column) -> Column:
    n = key.try_cast("double")
    return F.coalesce(F.when(n == F.floor(n), n.cast("long").cast("string")), F.nullif(F.trim(key), F.lit("")))


def pairings_of(rows: DataFrame, flights: DataFrame, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """(instance_id, duty, pos, flight) of the pairings, and (instance_id, duties), their labels, of what can be read. rows: (instance_id, c), where c holds the pairings as a list, a map, or as its own fields."""
    c = F.col("c")
    p = get(c, "$.pairings")
    own = entries(c)
    plain = p.isNull() & (F.size(own) > 0) & ~F.exists(own, lambda e: e["key"].isin(RESERVED)) & F.forall(own, lambda e: F.coalesce(sort_of(e["value"]) == "array", F.lit(False)))
    listed = F.transform(items(p), lambda v, i: F.struct(F.coalesce(F.when(is_object(v) & first_of(v, *LABEL).isNotNull(), F.coalesce(label(first_of(v, *LABEL)), F.lit(""))), (i + 1).cast("string")).alias("duty"), v.alias("v")))
    keyed = lambda m: F.transform(m, lambda e: F.struct(F.coalesce(key_label(e["key"]), F.lit("")).alias("duty"), e["value"].alias("v")))
    found = F.when(sort_of(p) == "array", listed).when(sort_of(p) == "object", keyed(entries(p))).when(plain, keyed(own))
    legs = lambda v: F.when(is_object(v), F.when(is_list(v, "flights"), get(v, "$.flights", "array<variant>"))).when(sort_of(v) == "array", items(v))
    x = rows.where(is_object(c)).select("instance_id", F.transform(found, lambda s: F.struct(s["duty"].alias("duty"), F.transform(legs(s["v"]), whole_id).alias("ids"))).alias("pairings")).where("pairings IS NOT NULL")
    good = F.forall("pairings", lambda s: (s["duty"] != "") & s["ids"].isNotNull() & ~F.exists(F.coalesce(s["ids"], F.array().cast("array<bigint>")), lambda i: i.isNull()))
    names = F.transform("pairings", lambda s: s["duty"])
    x = x.where(F.coalesce(good, F.lit(False)) & (F.size(F.array_distinct(names)) == F.size(names)))
    x = keep(x, "pairings")
    flat = x.select("instance_id", F.explode("pairings").alias("s")).select("instance_id", "s.duty", F.posexplode("s.ids").alias("pos", "flight"))
    unknown = flat.join(flights.select("instance_id", "flight"), ["instance_id", "flight"], "left_anti").select("instance_id").distinct()
    x = x.join(unknown, "instance_id", "left_anti")
    return keep(flat.join(unknown, "instance_id", "left_anti"), "legs"), keep(x.select("instance_id", names.alias("duties")), "duties")


def flights_of(rows: DataFrame) -> DataFrame:
    f = each(rows, ["instance_id"], get("p", "$.flights", "array<variant>"))
    n = lambda c: get("item", f"$.{c}", "double").alias(c)
    s = lambda c: get("item", f"$.{c}", "string").alias(c)
    return f.select("instance_id", whole_id(get("item", "$.id")).alias("flight"), s("origin"), s("destination"), n("dep_time"), n("arr_time"), n("flight_cost"))


def pairing_audit(rows: DataFrame, flights: DataFrame, legs: DataFrame, read: DataFrame, keep: Keep) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Violations, (instance_id, total, cost), and (instance_id, duty, origin, span) of pairings. rows: (instance_id, p, c, strict). Strict: each flight is in one pairing at most, and pairings end at a base."""
    n = lambda c: get("p", f"$.{c}", "double").alias(c)
    limits = rows.join(read, "instance_id").select("instance_id", "c", "strict", "duties", get("p", "$.bases", "array<string>").alias("bases"), *map(n, ("min_connect_hours", "max_connect_hours", "max_legs_per_pairing", "max_span_hours", "fixed_cost_per_pairing", "wait_cost_per_hour", "uncovered_flight_cost")))
    w = Window.partitionBy("instance_id", "duty").orderBy("pos")
    x = legs.join(flights, ["instance_id", "flight"]).join(limits.select("instance_id", "min_connect_hours", "max_connect_hours"), "instance_id")
    x = x.withColumns({"gap": F.col("dep_time") - F.lag("arr_time").over(w), "came": F.lag("destination").over(w)})
    bad = F.col("gap").isNotNull() & (~F.col("came").eqNullSafe(F.col("origin")) | (F.col("gap") < F.col("min_connect_hours") - EPS) | (F.col("gap") > F.col("max_connect_hours") + EPS))
    d = x.groupBy("instance_id", "duty").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("origin", "pos").alias("origin"), F.max_by("destination", "pos").alias("destination"), (F.max_by("arr_time", "pos") - F.min_by("dep_time", "pos")).alias("span"), F.count_if(bad).alias("bad"), F.coalesce(F.sum("gap"), F.lit(0.0)).alias("wait"), F.sum("flight_cost").alias("flown"),
    )
    d, limits = keep(d, "sums"), keep(limits, "limits")
    every = limits.select("instance_id", F.explode("duties").alias("duty"))
    empty = violations(every.join(d.select("instance_id", "duty"), ["instance_id", "duty"], "left_anti").withColumn("at", F.concat(F.lit("pairing "), F.col("duty"))), "duties", "at", F.lit(0), F.lit(1))
    y = d.join(limits, "instance_id")
    part = lambda cond, what, seen, limit: violations(y.where(cond).withColumn("at", F.concat_ws("/", "duty", F.lit(what))), "duties", "at", seen, limit)
    base = lambda c: F.array_contains("bases", F.col(c))
    found = [
        empty, part(~base("origin"), "start", F.lit(None), F.lit(None)), part(F.col("strict") & ~base("destination"), "end", F.lit(None), F.lit(None)), part(F.col("bad") > 0, "connections", F.col("bad"), F.lit(0)),
        part(F.col("n") > F.col("max_legs_per_pairing"), "legs", F.col("n"), F.col("max_legs_per_pairing")), part(F.col("span") > F.col("max_span_hours") + EPS, "span", F.col("span"), F.col("max_span_hours")),
    ]
    times = legs.groupBy("instance_id", "flight").agg(F.count(F.lit(1)).alias("n"))
    twice = times.where("n > 1").join(limits.where("strict").select("instance_id"), "instance_id")
    found.append(violations(twice.withColumn("at", F.concat(F.lit("flight "), F.col("flight"))), "coverage", "at", F.col("n"), F.lit(1)))
    left = flights.join(limits.select("instance_id"), "instance_id").join(times, ["instance_id", "flight"], "left_anti").groupBy("instance_id").agg(F.array_sort(F.collect_set("flight")).alias("left"))
    z = limits.join(left, "instance_id", "left").withColumn("left", F.coalesce("left", F.array().cast("array<bigint>")))
    said = first_of("c", *UNCOVERED)
    ids = F.array_sort(F.array_distinct(F.transform(F.when(sort_of(said) == "array", items(said)), lambda v: F.coalesce(whole_id(v), F.lit(-(1 << 62))))))
    found.append(violations(z.where(ids != F.col("left")).withColumn("at", F.lit("uncovered_flights")), "declared", "at", F.size(ids), F.size("left")))
    own = d.groupBy("instance_id").agg(F.count(F.lit(1)).alias("k"), F.sum("flown").alias("flown"), F.sum("wait").alias("wait"))
    z = z.join(own, "instance_id", "left").fillna(0, ["k", "flown", "wait"])
    cost = F.col("k") * F.col("fixed_cost_per_pairing") + F.col("flown") + F.col("wait") * F.col("wait_cost_per_hour") + F.size("left") * F.col("uncovered_flight_cost")
    total = F.when(F.col("strict"), 6).otherwise(4) * F.size("duties") + 1
    return all_of(*found), z.select("instance_id", total.alias("total"), cost.alias("cost")), d.select("instance_id", "duty", "origin", "span")


@kind_check("crew_pairing")
def crew_pairing(rows: DataFrame, keep: Keep) -> Audit:
    """Flights that no pairing has cost extra. variant strict: each flight once, pairings end at a base."""
    flights = keep(flights_of(rows), "flights")
    own = rows.join(flights.where("flight IS NULL").select("instance_id").distinct(), "instance_id", "left_anti").where(F.size(get("p", "$.flights", "array<variant>")) > 0)
    own = own.withColumns({"c": F.col("a"), "strict": F.coalesce(F.col("variant") == "strict", F.lit(False))})
    legs, read = pairings_of(own, flights, keep)
    found, seen, _ = pairing_audit(own, flights, legs, read, keep)
    seen = keep(seen, "costs")
    x = own.select("instance_id", "a").join(seen, "instance_id")
    wrong = mismatch(x, number(first_of("a", "objective_value", "total_cost", "cost")), "cost")
    return Audit(all_of(found, wrong), seen.select("instance_id", F.lit(True).alias("readable"), (F.col("total") + 1).alias("total"), "cost"))


@kind_check("crew_pairing_seniority")
def crew_assignment(rows: DataFrame, keep: Keep) -> Audit:
    """Pairings, and their crews: each crew has at most its number of duties; a duty costs by its span, more from another base than the crew's, and most without a crew."""
    flights = keep(flights_of(rows), "flights")
    crews = each(rows, ["instance_id"], get("p", "$.crews", "array<variant>")).select("instance_id", whole_id(get("item", "$.id")).alias("crew"), get("item", "$.home_base", "string").alias("home"), get("item", "$.max_duties", "double").alias("most"), get("item", "$.span_pref", "double").alias("pref"))
    odd = flights.where("flight IS NULL").select("instance_id").union(crews.where("crew IS NULL").select("instance_id")).distinct()
    own = rows.join(odd, "instance_id", "left_anti").where(is_object(F.col("a")) & (F.size(get("p", "$.flights", "array<variant>")) > 0) & (F.size(get("p", "$.crews", "array<variant>")) > 0))
    own = own.withColumns({"c": F.coalesce(get("a", "$.stage1"), F.col("a")), "d": F.coalesce(get("a", "$.stage2"), F.col("a")), "strict": F.lit(False)})
    legs, read = pairings_of(own, flights, keep)
    own = own.join(read, "instance_id")
    raw = get("d", "$.assignments")
    plain_fields = entries(F.col("d"))
    scalar = F.forall(plain_fields, lambda e: ~F.coalesce(sort_of(e["value"]).isin("array", "object"), F.lit(False)))
    plain = raw.isNull() & (F.size(plain_fields) > 0) & ~F.exists(plain_fields, lambda e: e["key"].isin(RESERVED)) & scalar & F.forall(plain_fields, lambda e: F.coalesce(F.array_contains("duties", key_label(e["key"])), F.lit(False)))
    record_label = lambda v: F.coalesce(first_of(v, "pairing_id", "pairing_index", "id"), F.when(sort_of(get(v, "$.pairing")) != "array", get(v, "$.pairing")))
    listed = F.transform(items(raw), lambda v: F.struct(F.when(is_object(v), label(record_label(v))).alias("duty"), v.alias("v")))
    keyed = lambda m: F.transform(m, lambda e: F.struct(key_label(e["key"]).alias("duty"), e["value"].alias("v")))
    given = F.when(sort_of(raw) == "array", listed).when(sort_of(raw) == "object", keyed(entries(raw))).when(plain, keyed(plain_fields))
    crew = lambda v: F.when(is_object(v), whole_id(first_of(v, "crew", "crew_id"))).otherwise(whole_id(v))
    told = lambda v: F.when(is_object(v), first_of(v, "pairing", "flights"))
    said = F.transform(given, lambda s: F.struct(s["duty"].alias("duty"), crew(s["v"]).alias("crew"), F.when(sort_of(told(s["v"])) == "array", F.transform(items(told(s["v"])), whole_id)).alias("told")))
    own = own.withColumn("said", said)
    names = F.transform("said", lambda s: s["duty"])
    good = F.forall("said", lambda s: s["duty"].isNotNull() & s["crew"].isNotNull()) & (F.size(F.array_distinct(names)) == F.size(names))
    own = keep(own.where(F.coalesce(good, F.lit(False))), "own")
    read = own.select("instance_id", "duties")
    legs = legs.join(read.select("instance_id"), "instance_id", "left_semi")
    found, seen, duties = pairing_audit(own.drop("duties"), flights, legs, read, keep)
    a = own.select("instance_id", "duties", F.explode("said").alias("s")).select("instance_id", "duties", "s.*")
    a = keep(a, "assigned")
    known = F.array_contains("duties", F.col("duty"))
    strangers = violations(a.where(~known).withColumn("at", F.concat(F.lit("pairing "), F.col("duty"))), "crews", "at", F.lit(1), F.lit(0))
    a = a.where(known).join(crews, ["instance_id", "crew"], "left")
    nobody = violations(a.where("most IS NULL").withColumn("at", F.concat(F.lit("crew "), F.col("crew"))), "crews", "at", F.lit(1), F.lit(0))
    a = a.where("most IS NOT NULL")
    true_legs = legs.groupBy("instance_id", "duty").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "flight"))), lambda s: s["flight"]).alias("ids"))
    a = a.join(true_legs, ["instance_id", "duty"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
    differ = violations(a.where(F.col("told").isNotNull() & ~F.col("told").eqNullSafe(F.col("ids"))).withColumn("at", F.concat_ws("/", "duty", F.lit("flights"))), "declared", "at", F.size("told"), F.size("ids"))
    a = a.join(duties, ["instance_id", "duty"])  # duties without flights are nobody's
    many = a.groupBy("instance_id", "crew").agg(F.count(F.lit(1)).alias("n"), F.max("most").alias("most")).where("n > most")
    many = violations(many.withColumn("at", F.concat(F.lit("crew "), F.col("crew"))), "crews", "at", F.col("n"), F.col("most"))
    bids = a.groupBy("instance_id").agg(F.sum(F.col("span") * F.col("pref") * 100.0 + F.when(F.col("home").eqNullSafe(F.col("origin")), 0.0).otherwise(5000.0)).alias("bids"))
    size = crews.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_crews"))
    x = own.select("instance_id", "p", "a", "d", "said", "duties").join(seen, "instance_id").join(bids, "instance_id", "left").join(size, "instance_id")
    x = keep(x, "sums-of-crews")
    free = F.array_except("duties", F.transform("said", lambda s: s["duty"]))
    x = x.withColumn("free", F.array_sort(free)).withColumn("cost", F.col("cost") + F.coalesce("bids", F.lit(0.0)) + F.size("free") * get("p", "$.unassigned_pairing_cost", "double"))
    unassigned = F.array_sort(F.array_distinct(F.transform(F.when(is_list("d", "unassigned_pairings"), get("d", "$.unassigned_pairings", "array<variant>")), lambda v: F.coalesce(label(v), F.lit("")))))
    wrong = violations(x.where(unassigned != F.col("free")).withColumn("at", F.lit("unassigned_pairings")), "declared", "at", F.size(unassigned), F.size("free"))
    cost = mismatch(x, number(first_of("a", "objective_value", "total_cost", "cost")), "cost")
    out = x.select("instance_id", F.lit(True).alias("readable"), (F.col("total") + F.size("said") + F.col("n_crews") + 2).alias("total"), "cost")
    return Audit(all_of(found, strangers, nobody, differ, many, wrong, cost), out)

