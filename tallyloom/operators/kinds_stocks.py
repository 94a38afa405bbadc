"""Checks of portfolio and cutting kinds from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audit import violations
from .kinds import Audit, Keep, all_of, each, first_of, get, is_list, is_object, items, kind_check, mismatch, number, sort_of, whole_id
from .kinds_rosters import entries
from .kinds_shops import name_of

EPS, NEAR, HELD = 1e-6, 5e-4, 1e-9


def portfolio_audit(rows: DataFrame, tail: bool, keep: Keep) -> Audit:
    """Weights of known assets are not negative, sum to 1 and keep limits on holdings, single weights, sectors, return and turnover; with tail, also on the number of holdings of each sector, and nothing that is held now is sold.

    The cost is the mean deviation of scenarios from the expected return, or with tail the mean of the worst losses against it. Weights are a map by asset, or a list of as many as there are assets.
    """
    p = lambda path: number(get("p", f"$.{path}"))
    assets = each(rows, ["instance_id"], get("p", "$.assets", "array<variant>")).select("instance_id", F.col("pos").alias("at"), whole_id(get("item", "$.id")).alias("asset"), get("item", "$.sector", "string").alias("sector"), F.coalesce(get("item", "$.expected_return", "double"), get("item", "$.mean_return", "double"), F.lit(0.0)).alias("mean"))
    assets = keep(assets, "assets")
    w = get("a", "$.weights")
    size = F.size(get("p", "$.assets", "array<variant>"))
    listed = F.when((sort_of(w) == "array") & (F.size(items(w)) == size), F.transform(items(w), lambda v, i: F.struct(i.cast("long").alias("at"), F.lit(None).cast("long").alias("asset"), number(v).alias("weight"))))
    mapped = F.when(is_object(w), F.transform(entries(w), lambda e: F.struct(F.lit(None).cast("long").alias("at"), F.when(F.trim(e["key"]).rlike(r"^-?\d+$"), F.trim(e["key"]).try_cast("long")).alias("asset"), number(e["value"]).alias("weight"))))
    x = rows.where(is_object(F.col("a"))).withColumn("w", F.coalesce(listed, mapped))
    good = F.forall("w", lambda e: (e["at"].isNotNull() | e["asset"].isNotNull()) & e["weight"].isNotNull())
    x = keep(x.where(F.coalesce(good, F.lit(False))), "answers")
    flat = x.select("instance_id", F.explode("w").alias("e")).select("instance_id", "e.*")
    by_place = flat.where("at IS NOT NULL").drop("asset").join(assets.select("instance_id", F.col("at").cast("long").alias("at"), "asset"), ["instance_id", "at"]).select("instance_id", "asset", "weight")
    own = keep(by_place.unionByName(flat.where("at IS NULL").select("instance_id", "asset", "weight")).join(assets.drop("at").withColumn("known", F.lit(True)), ["instance_id", "asset"], "left"), "weights")
    held = keep(own.where(F.col("known") & (F.col("weight") > HELD)), "held")
    limit = {c: p(f"limits.{c}").alias(c) for c in ("min_holdings", "max_holdings", "min_weight", "max_weight", "max_sector_weight", "min_sectors", "max_turnover")}
    now = F.transform(F.coalesce(entries(get("p", "$.current_portfolio")), F.array().cast("array<struct<key: string, value: variant>>")), lambda e: F.struct(e["key"].try_cast("long").alias("asset"), get(e["value"], "$", "double").alias("old")))
    bounds = F.coalesce(F.when(F.lit(tail), entries(get("p", "$.sector_cardinality"))), F.array().cast("array<struct<key: string, value: variant>>"))
    limits = x.select("instance_id", "a", *limit.values(), p("target_return").alias("target"), F.coalesce(p("risk.alpha"), F.lit(0.9)).alias("alpha"), now.alias("now"), bounds.alias("bounds"))
    sums = own.groupBy("instance_id").agg(F.sum("weight").alias("total"), F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if(F.col("weight") < -NEAR).alias("negative"))
    sector = keep(held.groupBy("instance_id", "sector").agg(F.sum("weight").alias("s"), F.count(F.lit(1)).alias("k")), "sectors")
    of_held = held.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_held"), F.sum(F.col("weight") * F.col("mean")).alias("expected"))
    n_sectors = sector.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_sectors"))
    old = limits.select("instance_id", F.explode("now").alias("e")).select("instance_id", "e.asset", "e.old")
    moved = old.join(own.select("instance_id", "asset", "weight"), ["instance_id", "asset"], "full_outer").fillna(0.0, ["old", "weight"])
    turnover = moved.groupBy("instance_id").agg(F.sum(F.abs(F.col("weight") - F.col("old"))).alias("turnover"))
    y = limits
    for part in (sums, of_held, n_sectors, turnover):
        y = y.join(part, "instance_id", "left")
    y = keep(y.fillna(0.0, ["total", "expected", "turnover"]).fillna(0, ["unknown", "negative", "n_held", "n_sectors"]), "limits")
    one = lambda cond, what, seen, most: violations(y.where(F.coalesce(cond, F.lit(False))).withColumn("at", F.lit(what)), "portfolio", "at", F.col(seen), most if isinstance(most, Column) else F.lit(most))
    c = F.col
    found = [
        one(c("unknown") > 0, "unknown", "unknown", 0), one(c("negative") > 0, "negative", "negative", 0), one(F.abs(c("total") - 1) > NEAR, "total", "total", 1.0), one(c("n_held") < c("min_holdings").cast("long"), "few", "n_held", c("min_holdings")), one(c("n_held") > c("max_holdings").cast("long"), "many", "n_held", c("max_holdings")),
        one(c("n_sectors") < c("min_sectors").cast("long"), "sectors", "n_sectors", c("min_sectors")), one(c("expected") < c("target") - NEAR, "return", "expected", c("target")), one(c("turnover") > c("max_turnover") + NEAR, "turnover", "turnover", c("max_turnover")),
    ]
    single = held.join(y.select("instance_id", "min_weight", "max_weight"), "instance_id")
    found += [violations(single.where(c("weight") < c("min_weight") - NEAR), "portfolio", "asset", c("weight"), c("min_weight")), violations(single.where(c("weight") > c("max_weight") + NEAR), "portfolio", "asset", c("weight"), c("max_weight"))]
    full = sector.join(y.select("instance_id", "max_sector_weight"), "instance_id")
    found.append(violations(full.where(c("s") > c("max_sector_weight") + NEAR).withColumn("at", F.concat(F.lit("sector "), F.coalesce("sector", F.lit("")))), "portfolio", "at", c("s"), c("max_sector_weight")))
    extra = F.lit(0)
    if tail:
        b = y.select("instance_id", F.explode("bounds").alias("e")).select("instance_id", F.trim("e.key").alias("sector"), get("e.value", "$[0]", "double").alias("lo"), get("e.value", "$[1]", "double").alias("hi")).join(sector.drop("s"), ["instance_id", "sector"], "left").fillna(0, ["k"])
        found.append(violations(b.where((c("k") < c("lo")) | (c("k") > c("hi"))).withColumn("at", F.concat(F.lit("sector "), F.col("sector"))), "portfolio", "at", c("k"), c("hi")))
        sold = old.join(own.select("instance_id", "asset", "weight"), ["instance_id", "asset"], "left").fillna(0.0, ["weight"])
        found.append(violations(sold.where(c("weight") < c("old") - NEAR), "no_sale", "asset", c("weight"), c("old")))
        extra = F.size("bounds") + F.size("now")
    scenarios = each(rows, ["instance_id"], get("p", "$.scenario_returns", "array<variant>")).select("instance_id", F.col("pos").alias("scenario"), F.posexplode(get("item", "$", "array<double>")).alias("at", "r"))
    mine = scenarios.join(held.select("instance_id", "asset", "weight").join(assets.select("instance_id", "asset", "at"), ["instance_id", "asset"]), ["instance_id", "at"]).groupBy("instance_id", "scenario").agg(F.sum(c("r") * c("weight")).alias("r"))
    every = scenarios.select("instance_id", "scenario").distinct().join(y.select("instance_id", "expected", "alpha"), "instance_id").join(mine, ["instance_id", "scenario"], "left").fillna(0.0, ["r"])
    if tail:
        n = F.count(F.lit(1)).over(Window.partitionBy("instance_id"))
        loss = every.withColumn("loss", c("expected") - c("r")).withColumn("k", F.row_number().over(Window.partitionBy("instance_id").orderBy(F.desc("loss"), "scenario"))).withColumn("tail", (1 - c("alpha")) * n)
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("tail") - c("k") + 1))
        cost = loss.groupBy("instance_id").agg(F.when(F.max("tail") > 0, F.sum(part * c("loss")) / F.max("tail")).otherwise(F.max("loss")).alias("cost"))
    else:
        cost = every.groupBy("instance_id").agg(F.avg(F.abs(c("r") - c("expected"))).alias("cost"))
    groups = F.when(c("max_sector_weight").isNotNull(), c("n_sectors")).otherwise(0) + sum(c(k).isNotNull().cast("int") for k in ("min_sectors", "target", "max_turnover"))
    z = keep(y.withColumn("total_checks", 5 + c("n_held") + groups + extra).join(cost, "instance_id"), "costs")
    said = F.coalesce(*[number(get("a", f"$.{k}")) for k in (("objective_value", "cvar") if tail else ("objective_value", "mad_risk", "mad"))])
    wrong = z.withColumn("said", said).where(F.abs(c("said") - c("cost")) > F.greatest(5e-3 * F.abs("cost"), F.lit(1e-6)))
    found.append(violations(wrong.withColumn("at", F.lit("objective")), "declared", "at", c("said"), c("cost")))
    return Audit(all_of(*found), z.select("instance_id", F.lit(True).alias("readable"), c("total_checks").alias("total"), "cost"))


@kind_check("portfolio")
def portfolio(rows: DataFrame, keep: Keep) -> Audit:
    return portfolio_audit(rows, False, keep)


@kind_check("portfolio_cvar")
def portfolio_cvar(rows: DataFrame, keep: Keep) -> Audit:
    return portfolio_audit(rows, True, keep)


#: Names that answers use for the same thing.
STOCK = ["stock_id", "stock", "plate_id", "plate"]
RUNS = ["runs", "count", "uses", "usage", "quantity", "qty", "num", "bars", "copies", "multiplicity"]
CUTS = ["cuts", "items", "counts", "pieces"]


def counted(v: Column) -> Column:
    """(item, count) of a map, of item ids, or of records with an id and a count, 1 by default; null if that cannot be read."""
    mapped = F.transform(entries(v), lambda e: F.struct(e["key"].alias("item"), number(e["value"]).alias("count")))
    record = lambda x: F.struct(name_of(first_of(x, "item_id", "item", "id")).alias("item"), F.when(first_of(x, "count", "qty", "quantity", "num", "pieces").isNull(), 1.0).otherwise(number(first_of(x, "count", "qty", "quantity", "num", "pieces"))).alias("count"))
    bare = lambda x: F.struct(F.when(sort_of(x) != "array", name_of(x)).alias("item"), F.lit(1.0).alias("count"))
    listed = F.transform(items(v), lambda x: F.when(is_object(x), record(x)).otherwise(bare(x)))
    found = F.when(is_object(v), mapped).when(sort_of(v) == "array", listed)
    return F.when(F.forall(found, lambda s: s["item"].isNotNull() & s["count"].isNotNull()), found)


def whole(c: str) -> Column:
    return F.abs(F.col(c) - F.round(c)) < EPS


def cutting_audit(rows: DataFrame, plates: bool, keep: Keep) -> Audit:
    """Patterns fit their stock, are used a whole number of times (at least min_lot for plates), make what is in demand and are not of more kinds than allowed.

    Pieces lie side by side along a bar, or in strips across a plate: a strip is as high as it says, or as its highest piece.
    """
    keys = ["instance_id", "pattern"]
    answer = F.when(is_object(F.col("a")) & is_list("a", "patterns"), get("a", "$.patterns", "array<variant>"))
    x = keep(rows.withColumn("patterns", answer).where("patterns IS NOT NULL"), "answers")
    raw = each(x, ["instance_id"], F.col("patterns")).select("instance_id", F.col("pos").alias("pattern"), name_of(first_of("item", *STOCK)).alias("stock"), number(first_of("item", *RUNS)).alias("runs"), is_object(F.col("item")).alias("object"), "item")
    if plates:
        raw = raw.withColumn("strips", F.when(is_list("item", "strips"), get("item", "$.strips", "array<variant>")))
    raw = keep(raw, "patterns")
    told = F.col("object") & F.col("stock").isNotNull() & F.col("runs").isNotNull()
    if plates:
        strips = each(raw, keys, F.col("strips")).select(*keys, F.col("pos").alias("strip"), F.col("item").alias("s"))
        lone = sort_of("s").isin("number", "string")
        strips = strips.select(*keys, "strip", F.when(lone, F.array(F.struct(name_of(F.col("s")).alias("item"), F.lit(1.0).alias("count")))).when(is_object(F.col("s")), counted(first_of("s", *CUTS))).alias("cuts"), F.when(is_object(F.col("s")), get("s", "$.height")).alias("h"))
        strips = keep(strips.select(*keys, "strip", "cuts", number(F.col("h")).alias("height"), F.col("h").isNotNull().alias("stated")), "strips")
        dark = raw.where(~F.coalesce(told & F.col("strips").isNotNull(), F.lit(False))).select("instance_id").union(strips.where("cuts IS NULL OR stated AND height IS NULL").select("instance_id"))
    else:
        strips = raw.select(*keys, F.lit(0).alias("strip"), counted(first_of("item", *CUTS)).alias("cuts"), F.lit(None).cast("double").alias("height"))
        strips = keep(strips, "strips")
        dark = raw.where(~F.coalesce(told, F.lit(False))).select("instance_id").union(strips.where("cuts IS NULL").select("instance_id"))
    dark = keep(dark.distinct(), "dark")
    x, raw, strips = (t.join(dark, "instance_id", "left_anti") for t in (x, raw, strips))
    piece = each(rows, ["instance_id"], get("p", "$.items", "array<variant>")).select("instance_id", name_of(get("item", "$.id")).alias("item"), *[get("item", f"$.{c}", "double").alias(c) for c in ("width", "height", "demand")])
    stocks = each(rows, ["instance_id"], get("p", "$.plates" if plates else "$.stocks", "array<variant>")).select("instance_id", name_of(get("item", "$.id")).alias("stock"), get("item", "$.width" if plates else "$.length", "double").alias("long"), get("item", "$.height", "double").alias("high"), F.coalesce(get("item", "$.cost", "double"), F.lit(0.0)).alias("price"))
    piece, stocks = keep(piece, "pieces"), keep(stocks, "stocks")
    cuts = strips.select(*keys, "strip", F.explode("cuts").alias("c")).select(*keys, "strip", "c.item", "c.count").groupBy(*keys, "strip", "item").agg(F.sum("count").alias("count"))
    cuts = keep(cuts.join(piece.withColumnRenamed("height", "tall"), ["instance_id", "item"], "left").join(raw.select(*keys, "stock", "runs"), keys).join(stocks, ["instance_id", "stock"], "left"), "cuts")
    at = lambda df, *c: df.withColumn("at", F.concat_ws("/", *[F.col(k).cast("string") for k in c]))
    wrong_count = ~whole("count") | (F.col("count") < 0)
    found = [violations(at(cuts.where("demand IS NULL"), "pattern", "strip", "item"), "patterns", "at", F.lit(None), F.lit(None)), violations(at(cuts.where(F.col("demand").isNotNull() & wrong_count), "pattern", "strip", "item"), "patterns", "at", F.col("count"), F.lit(None))]
    fit = cuts.where(F.col("demand").isNotNull() & ~wrong_count).groupBy(*keys, "strip").agg(F.sum(F.col("width") * F.col("count")).alias("wide"), F.max("tall").alias("tall"))
    own = strips.select(*keys, "strip", "height").join(fit, [*keys, "strip"], "left").fillna(0.0, ["wide", "tall"]).join(raw.select(*keys, "stock"), keys).join(stocks, ["instance_id", "stock"], "left").withColumn("height", F.coalesce("height", "tall"))
    own = keep(own, "fits")
    found.append(violations(at(own.where(F.col("wide") > F.col("long") + EPS), "pattern", "strip"), "patterns", "at", F.col("wide"), F.col("long")))
    if plates:
        found.append(violations(at(own.where(F.col("tall") > F.col("height") + EPS), "pattern", "strip"), "patterns", "at", F.col("tall"), F.col("height")))
        stacked = own.groupBy(*keys).agg(F.sum("height").alias("stacked"), F.max("high").alias("high"))
        found.append(violations(at(stacked.where(F.col("stacked") > F.col("high") + EPS), "pattern"), "patterns", "at", F.col("stacked"), F.col("high")))
    priced = raw.select(*keys, "stock", "runs").join(stocks.select("instance_id", "stock", "price"), ["instance_id", "stock"], "left")
    lot = x.select("instance_id", F.coalesce(number(get("p", "$.min_lot")), F.lit(0.0)).alias("lot") if plates else F.lit(0.0).alias("lot"), number(get("p", "$.max_distinct_patterns")).alias("most"))
    priced = keep(priced.join(lot, "instance_id"), "priced")
    odd = ~whole("runs") | (F.col("runs") < 0)
    found += [violations(at(priced.where("price IS NULL"), "pattern", "stock"), "patterns", "at", F.lit(None), F.lit(None)), violations(at(priced.where(odd), "pattern"), "patterns", "at", F.col("runs"), F.lit(None)), violations(at(priced.where(~odd & (F.col("runs") > 0) & (F.col("runs") < F.col("lot"))), "pattern"), "patterns", "at", F.col("runs"), F.col("lot"))]
    counts_for = cuts.where(F.col("demand").isNotNull() & ~wrong_count) if plates else cuts
    made = counts_for.groupBy("instance_id", "item").agg(F.sum(F.col("count") * F.greatest("runs", F.lit(0.0))).alias("made"))
    lack = piece.join(x.select("instance_id"), "instance_id").join(made, ["instance_id", "item"], "left").fillna(0.0, ["made"]).where(F.col("made") < F.col("demand") - EPS)
    found.append(violations(lack, "production", "item", F.col("made"), F.col("demand")))
    content = strips.join(raw.select(*keys, "stock", "runs"), keys).where("runs > 0").groupBy(*keys, "stock").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("height", F.array_sort("cuts").alias("cuts"))))), 256).alias("h"))
    kinds = content.groupBy("instance_id").agg(F.countDistinct("stock", "h").alias("kinds")).join(lot, "instance_id").where("kinds > most")
    found.append(violations(kinds.withColumn("at", F.lit("kinds")), "patterns", "at", F.col("kinds"), F.col("most")))
    spent = priced.where("runs > 0 AND price IS NOT NULL").groupBy("instance_id").agg(F.sum(F.col("runs") * F.col("price")).alias("cost"))
    n_items = piece.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_items"))
    z = keep(x.select("instance_id", "a", F.size("patterns").alias("n")).join(spent, "instance_id", "left").join(n_items, "instance_id", "left").fillna(0.0, ["cost"]).fillna(0, ["n_items"]), "costs")
    found.append(mismatch(z, number(first_of("a", "total_cost", "objective_value", "cost")), "cost"))
    return Audit(all_of(*found), z.select("instance_id", F.lit(True).alias("readable"), ((4 if plates else 3) * F.col("n") + F.col("n_items") + 2).alias("total"), "cost"))


@kind_check("cutting_1d")
def cutting_bars(rows: DataFrame, keep: Keep) -> Audit:
    return cutting_audit(rows, False, keep)


@kind_check("cutting_2d")
def cutting_plates(rows: DataFrame, keep: Keep) -> Audit:
    return cutting_audit(rows, True, keep)
