"""Checks of routing kinds from JSON: routes of several depots and vehicle types with time windows, and pickup and delivery pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audit import violations
from .checks import shift_clock
from .kinds import Audit, Keep, all_of, each, get, is_list, is_object, items, kind_check, mismatch, number, has, sort_of, text

EPS = 1e-6
PLACE = ["x", "y", "demand", "tw_start", "tw_end", "service_time"]


def routes_of(rows: DataFrame, *stop_keys: str) -> tuple[DataFrame, DataFrame]:
    """(instance_id, route, depot, vehicle_type, stops) of the answers, and (instance_id, n) of the answers that can be read: a list of routes, each with a depot, a vehicle_type and a list of stops under one of the names."""
    listed = F.when(is_list("a", "routes"), get("a", "$.routes", "array<variant>"))
    stops = lambda r: F.coalesce(*[F.when(is_list(r, k), get(r, f"$.{k}", "array<variant>")) for k in stop_keys])
    good = F.forall(listed, lambda r: is_object(r) & has(r, "depot", "vehicle_type") & stops(r).isNotNull())
    read = rows.where(F.coalesce(good, F.lit(False)))
    routes = each(read, ["instance_id"], listed).select("instance_id", F.col("pos").alias("route"), number(get("item", "$.depot")).alias("depot"), text(get("item", "$.vehicle_type")).alias("vehicle_type"), stops(F.col("item")).alias("stops"))
    return routes, read.select("instance_id", F.size(listed).alias("n"))


def depots_of(rows: DataFrame) -> DataFrame:
    v = each(rows, ["instance_id"], get("p", "$.depots", "array<variant>"))
    at = lambda name: get("item", f"$.{name}", "double").alias(f"depot_{name}")
    return v.select("instance_id", number(get("item", "$.id")).alias("depot"), at("x"), at("y"), at("open_time"), at("close_time"), get("item", "$.fleet", "map<string,double>").alias("fleet"))


def vehicles_of(rows: DataFrame) -> DataFrame:
    v = each(rows, ["instance_id"], get("p", "$.vehicle_types", "array<variant>"))
    return v.select("instance_id", text(get("item", "$.type")).alias("vehicle_type"), *[get("item", f"$.{c}", "double").alias(c) for c in ("capacity", "speed_kmh", "fixed_cost", "cost_per_km", "max_route_hours")])


def place(v: Column) -> list[Column]:
    return [F.coalesce(get(v, f"$.{c}", "double"), F.lit(0.0) if c == "service_time" else F.lit(None)).alias(c) for c in PLACE]


def driven(routes: DataFrame, stops: DataFrame, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """Violations of load, time windows, duty lengths, opening hours and fleets, and (instance_id, cost) of the routes.

    routes: (instance_id, route) with the columns of depots_of() and vehicles_of(); stops: (instance_id, route, pos, *PLACE).
    """
    own = ["instance_id", "route"]
    w = Window.partitionBy(*own).orderBy("pos")
    x = stops.join(routes.drop("fleet"), own)
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.col(f"depot_{c}"))
    x = x.withColumn("leg", F.hypot(step("x"), step("y"))).withColumn("load", F.sum("demand").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by(F.hypot(F.col("x") - F.col("depot_x"), F.col("y") - F.col("depot_y")), "pos")
    sums = x.groupBy(*own).agg(F.sum("leg").alias("out"), last.alias("back"), F.max("load").alias("peak"))
    x, r = keep(x, "legs"), keep(routes.join(sums, own, "left").fillna(0.0, ["out", "back", "peak"]), "sums")
    name = F.col("route").cast("string").alias("route")
    heavy = violations(r.where(F.col("peak") > F.col("capacity") + EPS), "capacity", "route", F.col("peak"), F.col("capacity"))
    clock = shift_clock({
        "stops": x.select("instance_id", name, "pos", (F.col("leg") / F.col("speed_kmh")).alias("travel"), F.col("service_time").alias("service"), "tw_start", "tw_end"),
        "shifts": r.select("instance_id", name, F.col("depot_open_time").alias("opens"), F.col("depot_close_time").alias("closes"), F.col("max_route_hours").alias("longest"), (F.col("back") / F.col("speed_kmh")).alias("back")),
    })
    used = r.groupBy("instance_id", "depot", "vehicle_type").agg(F.count(F.lit(1)).alias("n"), F.first(F.coalesce(F.try_element_at("fleet", "vehicle_type"), F.lit(0.0))).alias("held")).where("n > held")
    fleet = violations(used.withColumn("at", F.concat_ws("/", F.col("depot").cast("long"), "vehicle_type")), "fleet", "at", F.col("n"), F.col("held"))
    cost = r.groupBy("instance_id").agg(F.sum(F.col("fixed_cost") + F.col("cost_per_km") * (F.col("out") + F.col("back"))).alias("cost"))
    return all_of(heavy, clock, fleet), cost


def routing_audit(rows: DataFrame, routes: DataFrame, read: DataFrame, stops: DataFrame, odd: DataFrame, known: DataFrame, served: DataFrame, unserved_key: str, per_route: int, keep: Keep) -> Audit:
    """What routing kinds have in common. stops: of good routes; odd: further violations; known and served: (instance_id, id) of what is to be served, and is."""
    own = rows.join(read, "instance_id").withColumn("penalty", get("p", "$.unserved_penalty", "double"))
    found, cost = driven(routes, stops, keep)
    left = known.distinct().join(served.distinct(), ["instance_id", "id"], "left_anti").groupBy("instance_id").agg(F.array_sort(F.collect_set("id")).alias("left"))
    x = own.join(cost, "instance_id", "left").join(left, "instance_id", "left").withColumn("left", F.coalesce("left", F.array().cast("array<double>")))
    x = keep(x.withColumn("cost", F.coalesce("cost", F.lit(0.0)) + F.col("penalty") * F.size("left")), "costs")
    said = [number(get("a", f"$.{k}")) for k in ("total_cost", "objective_value")]
    far = [F.abs(s - F.col("cost")) > 5e-3 * F.greatest(F.lit(1.0), F.abs("cost")) for s in said]
    wrong = mismatch(x, F.coalesce(F.when(far[0], said[0]), said[1], said[0]), "cost")
    listed = F.when(is_list("a", unserved_key), get("a", f"$.{unserved_key}", "array<variant>"))
    same = F.array_sort(F.array_distinct(F.transform(listed, lambda v: F.coalesce(number(v), F.lit(float("nan")))))) == F.col("left")
    unserved = violations(x.where(~same).withColumn("at", F.lit(unserved_key)), "declared", "at", F.size(listed), F.size("left"))
    seen = x.select("instance_id", F.lit(True).alias("readable"), (F.col("n") * per_route + 3).alias("total"), "cost")
    return Audit(all_of(found, odd, wrong, unserved), seen)


def split_routes(rows: DataFrame, routes: DataFrame, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """Routes with a known depot and vehicle type, and a violation for each other one."""
    routes = keep(routes, "routes")
    good = routes.join(depots_of(rows), ["instance_id", "depot"]).join(vehicles_of(rows), ["instance_id", "vehicle_type"])
    good = keep(good, "good-routes")
    bad = routes.join(good.select("instance_id", "route"), ["instance_id", "route"], "left_anti")
    return good, violations(bad.withColumn("at", F.concat(F.lit("route "), F.col("route"))), "fleet", "at", F.lit(None), F.lit(None))


@kind_check("vrptw_md")
def vehicle_routes(rows: DataFrame, keep: Keep) -> Audit:
    """Each customer is on one route at most; those on none cost a penalty. Routes of unknown depots or vehicle types are a violation and serve nobody."""
    routes, read = routes_of(rows, "customers", "sequence")
    good, unknown = split_routes(rows, routes, keep)
    customers = each(rows, ["instance_id"], get("p", "$.customers", "array<variant>")).select("instance_id", number(get("item", "$.id")).alias("id"), *place(F.col("item")))
    read, customers = keep(read, "read"), keep(customers, "customers")
    asked = each(good, ["instance_id", "route"], F.col("stops")).select("instance_id", "route", "pos", number(F.col("item")).alias("id"), F.to_json("item").alias("said"))
    asked = keep(asked, "asked")
    stops = keep(asked.join(customers, ["instance_id", "id"]), "stops")
    lost = asked.join(customers.select("instance_id", "id"), ["instance_id", "id"], "left_anti")
    strangers = violations(lost.withColumn("at", F.concat_ws("/", "route", "said")), "coverage", "at", F.lit(1), F.lit(0))
    again = stops.groupBy("instance_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("instance_id").agg(F.max("n").alias("n"))
    repeated = violations(again.withColumn("at", F.lit("repeated")), "coverage", "at", F.col("n"), F.lit(1))
    return routing_audit(rows, good.drop("stops"), read, stops, all_of(unknown, strangers, repeated), customers.select("instance_id", "id"), stops.select("instance_id", "id"), "unserved_customers", 5, keep)


#: What a stop's kind may be called.
PICKUP, DELIVERY = ["p", "pickup"], ["d", "delivery", "dropoff"]


def stop_kind(said: Column) -> Column:
    low = F.lower(F.trim(said))
    return F.when(low.isin(PICKUP), "pickup").when(low.isin(DELIVERY), "delivery").otherwise(said)


@kind_check("pdptw")
def pickup_routes(rows: DataFrame, keep: Keep) -> Audit:
    """Stops name a pair and whether it is picked up or delivered: [12, "pickup"], {"pair": 12, "type": "delivery"} or "P12". Both are on one route, once each, the pickup first.

    A bare depot number at an end of a route is its start or return, and no stop; an answer with other stops that do not tell their kind cannot be read.
    """
    routes, read = routes_of(rows, "stops")
    good, unknown = split_routes(rows, routes, keep)
    s = F.col("stops")
    bare = lambda v: F.coalesce(number(v) == F.col("depot"), F.lit(False))
    first = F.when(F.size(s) > 0, bare(F.get(s, 0))).otherwise(False).cast("int")
    after = F.slice(s, first + 1, F.size(s))
    last = F.when(F.size(after) > 0, bare(F.get(after, F.size(after) - 1))).otherwise(False).cast("int")
    asked = each(good.withColumn("stops", F.slice(after, F.lit(1), F.size(after) - last)), ["instance_id", "route"], s)
    v = F.col("item")
    two = F.when((sort_of(v) == "array") & (F.size(items(v)) == 2), items(v))
    entry = lambda *names: F.when(is_object(v), F.coalesce(*[get(v, f"$.{k}") for k in names]))
    parts = asked.select("instance_id", "route", "pos", F.trim(text(v)).alias("name"), F.coalesce(two[0], entry("pair", "pair_id", "id")).alias("pair"), F.coalesce(two[1], entry("type", "kind")).alias("kind"), F.to_json("item").alias("said"))
    parts = keep(parts, "parts").select("instance_id", "route", "pos", "name", "said", number(F.col("pair")).alias("n"), F.trim(text(F.col("pair"))).alias("t"), (sort_of("pair") != "null").alias("paired"), text(F.col("kind")).alias("kind"))
    named = F.col("name").rlike(r"^(?i)(p|d|pickup|delivery|dropoff)[ _:-]?(\d+)$")
    digits = F.when(F.col("t").rlike(r"^\d+$"), F.col("t").try_cast("double"))
    kind = F.when(named, stop_kind(F.regexp_extract("name", "^[A-Za-z]+", 0))).otherwise(stop_kind(F.col("kind")))
    pid = F.when(named, F.regexp_extract("name", r"(\d+)$", 1).try_cast("double")).otherwise(F.coalesce("n", digits))
    told = named | F.coalesce(F.col("paired") & F.col("kind").isNotNull(), F.lit(False))
    x = parts.select("instance_id", "route", "pos", kind.alias("kind"), pid.alias("id"), F.coalesce(told, F.lit(False)).alias("told"), "said")
    x = keep(x, "asked")
    dark = x.where(~F.col("told")).select("instance_id").distinct()
    read, good, unknown = (t.join(dark, "instance_id", "left_anti") for t in (read, good, unknown))
    x = x.join(dark, "instance_id", "left_anti")
    pairs = each(rows, ["instance_id"], get("p", "$.pairs", "array<variant>")).select("instance_id", number(get("item", "$.id")).alias("id"), "item")
    of = lambda kind: pairs.select("instance_id", "id", F.lit(kind).alias("kind"), *place(get("item", f"$.{kind}")))
    pairs, read = keep(pairs, "pairs"), keep(read, "read")
    places = keep(of("pickup").union(of("delivery")), "places")
    stops = keep(x.join(places, ["instance_id", "id", "kind"]), "stops")
    lost = x.join(places.select("instance_id", "id", "kind"), ["instance_id", "id", "kind"], "left_anti")
    strangers = violations(lost.withColumn("at", F.concat_ws("/", "route", "said")), "coverage", "at", F.lit(1), F.lit(0))
    when = lambda k: F.max(F.when(F.col("kind") == k, F.col("pos")))  # noqa: E731  of repeated stops the last
    order = stops.groupBy("instance_id", "route", "id").agg(when("pickup").alias("up"), when("delivery").alias("down"))
    broken = order.where("up IS NULL OR down IS NULL OR up > down").groupBy("instance_id", "route").agg(F.count(F.lit(1)).alias("n"))
    broken = violations(broken.withColumn("at", F.concat(F.lit("route "), F.col("route"))), "pairing", "at", F.col("n"), F.lit(0))
    again = stops.groupBy("instance_id", "id").agg(F.countDistinct("route").alias("r"), F.count_if(F.col("kind") == "pickup").alias("u"), F.count_if(F.col("kind") == "delivery").alias("d")).where("r > 1 OR u > 1 OR d > 1")
    again = violations(again.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n")).withColumn("at", F.lit("repeated")), "coverage", "at", F.col("n"), F.lit(0))
    return routing_audit(rows, good.drop("stops"), read, stops.drop("kind"), all_of(unknown, strangers, broken, again), pairs.select("instance_id", "id"), stops.select("instance_id", "id"), "unserved_pairs", 6, keep)
