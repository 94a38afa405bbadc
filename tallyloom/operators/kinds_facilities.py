"""Checks of facility kinds from JSON: which facilities are open over several periods, whom they serve and what they procure and hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audit import violations
from .kinds import Audit, Keep, all_of, each, first_of, get, is_object, items, kind_check, mismatch, number, sort_of
from .kinds_rosters import entries

#: Plans are rounded to a tenth.
SLACK = 0.15
#: Names that records of plans use.
PLAN_ID, PLAN_AMOUNTS = ["facility", "facility_id", "id"], ["plan", "quantities", "amounts", "values", "periods"]


def id_of(v: Column) -> Column:
    """A whole number, or a text of digits."""
    n = number(v)
    text = F.trim(F.when(sort_of(v) == "string", get(v, "$", "string")))
    return F.coalesce(F.when(n == F.floor(n), n.cast("long")), F.when(text.rlike(r"^-?\d+$"), text.try_cast("long")))


def key_of(key: Column) -> Column:
    return F.when(F.trim(key).rlike(r"^-?\d+$"), F.trim(key).try_cast("long"))


def plan_of(v: Column) -> Column:
    """(facility, amounts) of a map by facility or of records; null if a facility is no number or the amounts are no list of numbers."""
    numbers = lambda x: F.when(sort_of(x) == "array", F.transform(items(x), number))
    mapped = F.transform(entries(v), lambda e: F.struct(key_of(e["key"]).alias("facility"), numbers(e["value"]).alias("amounts")))
    records = F.transform(items(v), lambda r: F.struct(F.when(is_object(r), id_of(first_of(r, *PLAN_ID))).alias("facility"), F.when(is_object(r), numbers(first_of(r, *PLAN_AMOUNTS))).alias("amounts")))
    return F.when(is_object(v), mapped).when(sort_of(v) == "array", records)


@kind_check("facility_multi")
def facility_periods(rows: DataFrame, keep: Keep) -> Audit:
    """Each customer is served by one open facility that it may use; in each period a facility's stock is the one before, more what it procures and less what it ships, within its throughput and storage and above the safety stock."""
    p = lambda path: number(get("p", f"$.{path}"))
    x = rows.where(is_object(F.col("a"))).select(
        "instance_id", "p", "a", p("num_periods").cast("int").alias("periods"), p("safety_stock_rate").alias("rate"), F.when(sort_of(get("a", "$.opened_facilities")) == "array", F.transform(get("a", "$.opened_facilities", "array<variant>"), id_of)).alias("opened"),
        F.transform(entries(get("a", "$.customer_assignment")), lambda e: F.struct(key_of(e["key"]).alias("customer"), id_of(e["value"]).alias("facility"))).alias("served"), plan_of(get("a", "$.procurement_plan")).alias("procured"), plan_of(get("a", "$.inventory_plan")).alias("stocked"),
    )
    x = keep(x, "fields")
    whole = lambda plan: F.forall(plan, lambda s: s["facility"].isNotNull() & (F.size(s["amounts"]) == F.col("periods")) & F.forall(s["amounts"], lambda v: v.isNotNull()))
    good = F.forall("opened", lambda v: v.isNotNull()) & F.forall("served", lambda s: s["customer"].isNotNull() & s["facility"].isNotNull()) & whole(F.col("procured")) & whole(F.col("stocked"))
    x = keep(x.where(F.coalesce(good, F.lit(False))), "answers")
    f = each(x, ["instance_id"], get("p", "$.facilities", "array<variant>"))
    d = lambda c: get("item", f"$.{c}", "double").alias(c)
    f = keep(f.select("instance_id", id_of(get("item", "$.id")).alias("facility"), *map(d, ("x", "y", "open_cost", "procure_cost", "holding_cost", "throughput_per_period", "storage_capacity"))), "facilities")
    c = each(x, ["instance_id"], get("p", "$.customers", "array<variant>"))
    c = keep(c.select("instance_id", id_of(get("item", "$.id")).alias("customer"), get("item", "$.x", "double").alias("cx"), get("item", "$.y", "double").alias("cy"), get("item", "$.demand", "array<double>").alias("demand"), F.transform(get("item", "$.candidate_facilities", "array<variant>"), id_of).alias("may")), "customers")
    one = lambda df, rule, what: violations(df.withColumn("at", what), rule, "at", F.lit(None), F.lit(None))
    named = lambda text, col: F.concat(F.lit(text), F.col(col))
    opened = x.select("instance_id", F.explode("opened").alias("facility"))
    strange = one(opened.join(f.select("instance_id", "facility"), ["instance_id", "facility"], "left_anti"), "index", named("opened ", "facility"))
    opened = keep(opened.distinct().join(f, ["instance_id", "facility"]), "opened")
    served = x.select("instance_id", F.explode("served").alias("s")).select("instance_id", "s.*")
    lost = one(served.join(c.select("instance_id", "customer"), ["instance_id", "customer"], "left_anti"), "index", named("assigned ", "customer"))
    a = c.join(served, ["instance_id", "customer"], "left").join(f.select("instance_id", "facility", "x", "y", F.lit(True).alias("known")), ["instance_id", "facility"], "left").join(opened.select("instance_id", "facility", F.lit(True).alias("is_open")), ["instance_id", "facility"], "left")
    a = keep(a, "assigned")
    wrong = F.col("facility").isNull() | F.col("known").isNull() | ~F.coalesce(F.array_contains("may", F.col("facility")), F.lit(False)) | F.col("is_open").isNull()
    coverage = one(a.where(wrong), "coverage", named("customer ", "customer"))
    ship = a.where("known").select("instance_id", "facility", F.posexplode("demand").alias("t", "d")).groupBy("instance_id", "facility", "t").agg(F.sum("d").alias("shipped"))

    def planned(name: str) -> tuple[DataFrame, DataFrame]:
        rows_ = x.select("instance_id", F.explode(name).alias("s")).select("instance_id", "s.*")
        odd = one(rows_.join(f.select("instance_id", "facility"), ["instance_id", "facility"], "left_anti"), "index", named(f"{name} ", "facility"))
        return rows_.join(f.select("instance_id", "facility"), ["instance_id", "facility"], "left_semi").select("instance_id", "facility", F.posexplode("amounts").alias("t", name)), odd

    (buy, odd_buy), (hold, odd_hold) = planned("procured"), planned("stocked")
    buy, hold = keep(buy, "buy"), keep(hold, "hold")
    used = buy.select("instance_id", "facility").union(hold.select("instance_id", "facility")).union(opened.select("instance_id", "facility")).distinct()
    every = used.join(x.select("instance_id", "periods", "rate"), "instance_id").select("instance_id", "facility", "rate", F.explode(F.sequence(F.lit(0), F.col("periods") - 1)).alias("t"))
    for part in (buy, hold, ship):
        every = every.join(part, ["instance_id", "facility", "t"], "left")
    every = every.fillna(0.0, ["procured", "stocked", "shipped"]).join(f.select("instance_id", "facility", "throughput_per_period", "storage_capacity"), ["instance_id", "facility"])
    before = F.coalesce(F.lag("stocked").over(Window.partitionBy("instance_id", "facility").orderBy("t")), F.lit(0.0))
    every = keep(every.withColumns({"before": before, "at": F.concat_ws("/", "facility", F.col("t") + 1)}), "periods")
    q = F.col
    rule = lambda cond, name, what, seen, limit: violations(every.where(cond).withColumn("at", F.concat_ws("/", "at", F.lit(what))), name, "at", seen, limit)
    totals = every.groupBy("instance_id", "facility").agg(F.sum("procured").alias("bought"), F.sum("stocked").alias("held"))
    shut = totals.join(opened.select("instance_id", "facility"), ["instance_id", "facility"], "left_anti").where((q("bought") > SLACK) | (q("held") > SLACK))
    found = [
        strange, lost, coverage, odd_buy, odd_hold, one(shut, "fit", named("closed ", "facility")), rule((q("procured") < -SLACK) | (q("stocked") < -SLACK), "stock", "negative", q("stocked"), F.lit(0.0)),
        rule(F.abs(q("before") + q("procured") - q("shipped") - q("stocked")) > SLACK, "stock", "balance", q("stocked"), q("before") + q("procured") - q("shipped")), rule(q("procured") > q("throughput_per_period") + SLACK, "capacity", "throughput", q("procured"), q("throughput_per_period")),
        rule(q("stocked") > q("storage_capacity") + SLACK, "capacity", "storage", q("stocked"), q("storage_capacity")), rule(q("stocked") < q("rate") * q("shipped") - SLACK, "stock", "safety", q("stocked"), q("rate") * q("shipped")),
    ]
    coefficient = F.coalesce(F.regexp_extract(F.coalesce(get("p", "$.transport_cost_formula", "string"), F.lit("")), r"^\s*([0-9]*\.?[0-9]+)", 1).try_cast("double"), F.lit(0.05))
    amount = F.aggregate("demand", F.lit(0.0), lambda s, v: s + v)
    moved = a.where("known").groupBy("instance_id").agg(F.sum(F.hypot(q("cx") - q("x"), q("cy") - q("y")) * amount).alias("moved"))
    built = opened.groupBy("instance_id").agg(F.sum("open_cost").alias("built"), F.count(F.lit(1)).alias("n_open"))
    spent = totals.join(f, ["instance_id", "facility"]).groupBy("instance_id").agg(F.sum(q("procure_cost") * q("bought") + q("holding_cost") * q("held")).alias("spent"))
    n = c.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_customers"))
    z = x.select("instance_id", "a", "periods", coefficient.alias("k"))
    for part in (moved, built, spent, n):
        z = z.join(part, "instance_id", "left")
    z = z.fillna(0.0, ["moved", "built", "spent"]).fillna(0, ["n_open", "n_customers"])
    z = keep(z.withColumn("cost", q("built") + q("k") * q("moved") + q("spent")), "costs")
    said = [number(get("a", f"$.{s}")) for s in ("objective_value", "total_cost")]
    far = F.abs(said[0] - q("cost")) > 5e-3 * F.greatest(F.lit(1.0), F.abs("cost"))
    found.append(mismatch(z, F.coalesce(F.when(far, said[0]), said[1], said[0]), "cost"))
    return Audit(all_of(*found), z.select("instance_id", F.lit(True).alias("readable"), (q("n_customers") + 5 * q("periods") * F.greatest("n_open", F.lit(1)) + 1).alias("total"), "cost"))
