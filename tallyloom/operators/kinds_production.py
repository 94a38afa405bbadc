"""Checks of production kinds from JSON: lots of several items on machines of limited capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audit import clipped, violations
from .kinds import Audit, Keep, all_of, each, first_of, get, is_object, items, kind_check, mismatch, number, sort_of
from .kinds_facilities import id_of, key_of
from .kinds_rosters import entries

EPS, ROUNDED = 1e-6, 1e-5
#: Names that answers use for the same thing.
ITEM, MACHINE, AMOUNT = ["item", "item_id", "id", "product", "product_id"], ["machine", "machine_id"], ["qty", "quantity", "amount", "production"]


def lots_of(v: Column, periods: Column) -> Column:
    """(machine, period, qty) of records, or of a list of maps by machine that has an entry for each period; null if that cannot be read."""
    listed = F.when(is_object(v), first_of(v, "production", "lots")).otherwise(v)
    rows = F.when(sort_of(listed) == "array", items(listed))
    lot = lambda m, t, q: F.struct(m.alias("machine"), t.alias("period"), q.alias("qty"))
    by_machine = (F.size(rows) > 0) & F.forall(rows, lambda r: is_object(r) & F.forall(F.coalesce(entries(r), F.array().cast("array<struct<key: string, value: variant>>")), lambda e: key_of(e["key"]).isNotNull()))
    placed = F.flatten(F.transform(rows, lambda r, i: F.transform(entries(r), lambda e: lot(key_of(e["key"]), (i + 1).cast("long"), number(e["value"])))))
    record = F.transform(rows, lambda r: F.when(is_object(r), lot(id_of(first_of(r, *MACHINE)), id_of(get(r, "$.period")), number(first_of(r, *AMOUNT)))).otherwise(lot(F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("double"))))
    found = F.when(by_machine, F.when(F.size(rows) == periods, placed)).otherwise(record)
    return F.when(F.forall(found, lambda s: s["machine"].isNotNull() & s["period"].isNotNull() & s["qty"].isNotNull()), found)


@kind_check("clsp")
def lot_sizes(rows: DataFrame, keep: Keep) -> Audit:
    """Items are made on machines that can make them, in the periods that there are, within each machine's time for lots and setups. What is left over is held, and what lacks is lost: both follow from the lots, and with the setups they make the cost."""
    plan = get("a", "$.production_plan")
    flat = F.transform(items(plan), lambda r: F.struct(F.when(is_object(r), id_of(first_of(r, *ITEM))).alias("item"), r.alias("lots")))
    x = rows.where(is_object(F.col("a"))).select("instance_id", "p", "a", get("p", "$.num_periods", "int").alias("periods"), F.when(is_object(plan), F.transform(entries(plan), lambda e: F.struct(key_of(e["key"]).alias("item"), e["value"].alias("lots")))).alias("by_item"), F.when(sort_of(plan) == "array", flat).alias("flat"))
    x = keep(x, "plans")
    keyed = x.where("by_item IS NOT NULL").select("instance_id", "periods", F.explode_outer("by_item").alias("s")).select("instance_id", "s.item", F.col("s").isNull().alias("none"), lots_of(F.col("s.lots"), F.col("periods")).alias("lots"))
    # Records of a flat list are lots of one record each.
    single = x.where("flat IS NOT NULL").select("instance_id", "periods", F.explode_outer("flat").alias("s"))
    r = F.col("s.lots")
    one = F.array(F.struct(id_of(first_of(r, *MACHINE)).alias("machine"), id_of(get(r, "$.period")).alias("period"), number(first_of(r, *AMOUNT)).alias("qty")))
    single = single.select("instance_id", "s.item", F.col("s").isNull().alias("none"), F.when(F.forall(one, lambda s: s["machine"].isNotNull() & s["period"].isNotNull() & s["qty"].isNotNull()), one).alias("lots"))
    read = keep(keyed.union(single), "lots-read")
    dark = read.where("NOT none AND (item IS NULL OR lots IS NULL)").select("instance_id").union(x.where("by_item IS NULL AND flat IS NULL").select("instance_id")).distinct()
    x = keep(x.join(dark, "instance_id", "left_anti").drop("by_item", "flat"), "answers")
    read = read.where("NOT none").join(x.select("instance_id"), "instance_id")
    lots = keep(read.select("instance_id", "item", F.explode("lots").alias("s")).groupBy("instance_id", "item", "s.machine", "s.period").agg(F.sum("s.qty").alias("qty")), "lots")
    d = lambda c: get("item", f"$.{c}", "double").alias(c)
    thing = each(x, ["instance_id"], get("p", "$.items", "array<variant>")).select("instance_id", id_of(get("item", "$.id")).alias("id"), *map(d, ("setup_cost", "setup_time", "unit_process_time", "holding_cost", "lost_sale_cost")), get("item", "$.demand", "array<double>").alias("demand"), F.transform(get("item", "$.compatible_machines", "array<variant>"), id_of).alias("may")).withColumnRenamed("id", "item")
    machine = each(x, ["instance_id"], get("p", "$.machines", "array<variant>")).select("instance_id", id_of(get("item", "$.id")).alias("machine"), d("capacity_per_period"))
    thing, machine = keep(thing, "items"), keep(machine, "machines")
    named = lambda df, rule, text: violations(df.withColumn("at", F.concat_ws("/", "item", F.lit(text))), rule, "at", F.lit(None), F.lit(None))
    strange = named(read.select("instance_id", "item").distinct().join(thing.select("instance_id", "item"), ["instance_id", "item"], "left_anti"), "index", "unknown")
    own = lots.join(thing, ["instance_id", "item"]).join(x.select("instance_id", "periods"), "instance_id").join(machine, ["instance_id", "machine"], "left")
    own = keep(own, "own-lots")
    where = lambda cond: own.where(cond).select("instance_id", "item").distinct()
    inside = F.col("period").between(1, F.col("periods"))
    found = [strange, named(where(~F.array_contains("may", F.col("machine")) | F.col("capacity_per_period").isNull()), "fit", "machine"), named(where(~inside), "index", "period"), named(where(F.col("qty") < -EPS), "index", "negative")]
    live = own.where(F.col("capacity_per_period").isNotNull() & inside & (F.col("qty") > EPS))
    load = live.groupBy("instance_id", "machine", "period").agg(F.sum(F.col("unit_process_time") * F.col("qty") + F.col("setup_time")).alias("used"), F.max("capacity_per_period").alias("most"))
    found.append(violations(load.where(F.col("used") > F.col("most") + ROUNDED).withColumn("at", F.concat_ws("/", "machine", "period")), "capacity", "at", F.col("used"), F.col("most")))
    setups = live.groupBy("instance_id").agg(F.sum("setup_cost").alias("setup"), F.count(F.lit(1)).alias("setups"))
    made = live.groupBy("instance_id", "item", "period").agg(F.sum("qty").alias("inflow"))
    series = thing.select("instance_id", "item", "holding_cost", "lost_sale_cost", F.posexplode("demand").alias("t", "outflow")).join(x.select("instance_id", "periods"), "instance_id").where("t < periods")
    series = series.withColumn("period", (F.col("t") + 1).cast("long")).join(made, ["instance_id", "item", "period"], "left").fillna(0.0, ["inflow"]).withColumnRenamed("item", "entity")
    held = clipped(series)
    before = F.coalesce(F.lag("level").over(Window.partitionBy("instance_id", "entity").orderBy("period")), F.lit(0.0))
    held = held.withColumn("lost", F.greatest(F.lit(0.0), F.col("outflow") - F.col("inflow") - before))
    sums = held.groupBy("instance_id").agg(F.sum(F.col("holding_cost") * F.col("level") + F.col("lost_sale_cost") * F.col("lost")).alias("flowing"), F.sum("lost").alias("lost"))
    count = lambda df, name: df.groupBy("instance_id").agg(F.count(F.lit(1)).alias(name))
    z = x.select("instance_id", "a", "periods")
    for part in (setups, sums, count(thing, "n_items"), count(machine, "n_machines")):
        z = z.join(part, "instance_id", "left")
    z = z.fillna(0.0, ["setup", "flowing", "lost"]).fillna(0, ["setups", "n_items", "n_machines"])
    z = keep(z.withColumn("cost", F.col("setup") + F.col("flowing")), "costs")
    said = lambda c: number(get("a", f"$.{c}"))
    found.append(mismatch(z, F.coalesce(said("objective_value"), said("total_cost")), "cost"))
    n = z.withColumn("said", id_of(get("a", "$.num_setups")))
    found.append(violations(n.where(F.col("said") != F.col("setups")).withColumn("at", F.lit("num_setups")), "declared", "at", F.col("said"), F.col("setups")))
    lost = z.withColumn("said", said("total_lost_sales"))
    found.append(violations(lost.where(F.abs(F.col("said") - F.col("lost")) > 5e-3 * F.greatest(F.lit(1.0), F.col("lost"))).withColumn("at", F.lit("total_lost_sales")), "declared", "at", F.col("said"), F.col("lost")))
    total = 3 * F.col("n_items") + F.col("n_machines") * F.col("periods") + 3
    return Audit(all_of(*found), z.select("instance_id", F.lit(True).alias("readable"), total.alias("total"), "cost"))
