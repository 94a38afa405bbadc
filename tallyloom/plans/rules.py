"""Registered queries of the further audit rules, each beside SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import audit, rules
from tallyloom.plans.queries import SPAN_SQL, query, spans, table

DAY = "date_diff('day', TIMESTAMP '1992-01-01', l_shipdate)"
ITEM = "l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)"


def lines(spark, sf_dir):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, sf_dir, "lineitem").withColumns({"k": k, "item": F.col("l_orderkey") * 1000 + k, "day": F.datediff("l_shipdate", F.lit("1992-01-01"))})


@query(f"""WITH s AS (SELECT l_suppkey AS i, {ITEM} AS item, {DAY} AS a, {DAY} + l_quantity AS b, l_returnflag AS kind FROM lineitem),
    x AS (SELECT *, lag(kind) OVER w AS pk, lag(b) OVER w AS pb FROM s WINDOW w AS (PARTITION BY i ORDER BY a, b, item))
    SELECT i::VARCHAR AS instance_id, 'setup' AS rule, item::VARCHAR AS entity, a::DOUBLE AS observed, pb + CASE WHEN pk = kind THEN 0 ELSE 2 END AS "limit" FROM x WHERE a < pb + CASE WHEN pk = kind THEN 0 ELSE 2 END""")
def audit_setup(spark, sf_dir):
    x = lines(spark, sf_dir)
    s = x.select(F.col("l_suppkey").alias("instance_id"), F.lit(0).alias("resource"), "item", F.col("day").alias("t_start"), (F.col("day") + F.col("l_quantity")).alias("t_end"), F.col("l_returnflag").alias("kind"))
    kinds = x.select("l_returnflag").distinct()  # a few flags, so few pairs
    pairs = kinds.select(F.lit(0).alias("k"), F.col("l_returnflag").alias("before")).join(kinds.select(F.lit(0).alias("k"), F.col("l_returnflag").alias("after")), "k")
    return audit.RULES["setup"]({"spans": s, "setups": pairs.select("before", "after", F.when(F.col("before") == F.col("after"), 0).otherwise(2).alias("setup"))})


@query(f"""WITH {SPAN_SQL}, b AS (SELECT DISTINCT l_suppkey AS resource, {DAY} AS b_start, {DAY} + 3 AS b_end FROM lineitem WHERE l_quantity = 50)
    SELECT sp.resource::VARCHAR AS instance_id, 'blocked' AS rule, item::VARCHAR AS entity, t_start::DOUBLE AS observed, b_end::DOUBLE AS "limit" FROM sp JOIN b ON sp.resource = b.resource AND t_start < b_end AND t_end > b_start""")
def audit_blocked(spark, sf_dir):
    day = F.datediff("l_shipdate", F.lit("1992-01-01"))
    b = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_suppkey").alias("instance_id"), F.lit(0).alias("resource"), day.alias("b_start"), (day + 3).alias("b_end")).distinct()
    return audit.RULES["blocked"]({"spans": spans(spark, sf_dir), "blocked": b})


@query("""WITH r AS (SELECT DISTINCT l_suppkey AS i, l_linestatus AS role FROM lineitem), n AS (SELECT l_suppkey AS i, l_linestatus AS role, year(l_shipdate) AS slot, count(*) AS n FROM lineitem GROUP BY ALL), y AS (SELECT DISTINCT year(l_shipdate) AS slot FROM lineitem)
    SELECT r.i::VARCHAR AS instance_id, 'staffing' AS rule, y.slot || '/' || r.role AS entity, coalesce(n, 0)::DOUBLE AS observed, 40::DOUBLE AS "limit" FROM r CROSS JOIN y LEFT JOIN n ON n.i = r.i AND n.role = r.role AND n.slot = y.slot WHERE coalesce(n, 0) < 40""")
def audit_staffing(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("instance_id"), F.year("l_shipdate").alias("slot"), F.col("l_linestatus").alias("role"), F.lit(0).alias("k"))
    need = x.select("instance_id", "role", "k").distinct().join(x.select("slot", "k").distinct(), "k").select("instance_id", "slot", "role", F.lit(40).alias("need"))  # years are few
    return audit.RULES["staffing"]({"required": need, "assigned": x})


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS day, event_type AS state FROM events), x AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY day) AS before FROM s)
    SELECT '0' AS instance_id, 'sequence' AS rule, user_id::VARCHAR AS entity, day::DOUBLE AS observed, (day - 1)::DOUBLE AS "limit" FROM x WHERE (before = 'error' AND state = 'purchase') OR (before = 'error' AND state = 'error')""")
def audit_sequence(spark, sf_dir):
    forbidden = spark.createDataFrame([("error", "purchase"), ("error", "error")], "before string, state string")
    return audit.RULES["sequence"]({"states": states(spark, sf_dir), "forbidden": forbidden})


def states(spark, sf_dir):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, sf_dir, "events").select(F.lit(0).alias("instance_id"), F.col("user_id").alias("person"), k.alias("day"), F.when(F.col("event_type") == "view", "off").otherwise(F.col("event_type")).alias("state"))


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS day, event_type AS state FROM events), n AS (SELECT user_id, (day - 1) // 7 AS block, count(*) FILTER (state <> 'view') AS n FROM s GROUP BY ALL)
    SELECT '0' AS instance_id, 'blocks' AS rule, user_id || '/' || block AS entity, n::DOUBLE AS observed, 5::DOUBLE AS "limit" FROM n WHERE n > 5""")
def audit_blocks(spark, sf_dir):
    s = states(spark, sf_dir)
    return audit.RULES["blocks"]({"states": s, "block_limits": s.select("instance_id").distinct().withColumn("limit", F.lit(5))})


@query(f"""WITH s AS (SELECT l_orderkey AS route, {ITEM} AS pos, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END AS d, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS p FROM lineitem),
    x AS (SELECT route, sum(d) OVER (PARTITION BY route) AS total, sum(d) OVER (PARTITION BY route) + sum(p - d) OVER (PARTITION BY route ORDER BY pos ROWS UNBOUNDED PRECEDING) AS load FROM s)
    SELECT route, greatest(max(load), max(total)) AS peak FROM x GROUP BY route""")
def peak_loads(spark, sf_dir):
    back = F.col("l_returnflag") == "R"
    s = lines(spark, sf_dir).select(F.lit(0).alias("instance_id"), F.col("l_orderkey").alias("route"), F.col("item").alias("pos"), F.when(back, 0.0).otherwise(F.col("l_quantity")).alias("delivery"), F.when(back, F.col("l_quantity")).otherwise(0.0).alias("pickup"))
    return rules.peak_loads(s).drop("instance_id")


@query("""WITH a AS (SELECT l_suppkey AS k, sum(l_quantity) AS a FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_suppkey AS k, sum(l_quantity) AS b FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
    SELECT '0' AS instance_id, 'match' AS rule, k::VARCHAR AS entity, coalesce(b, 0.0) AS observed, coalesce(a, 0.0) AS "limit" FROM a FULL JOIN b USING (k) WHERE abs(coalesce(a, 0) - coalesce(b, 0)) > 1e-6 * greatest(1, coalesce(a, 0), coalesce(b, 0))""")
def audit_match(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("instance_id"), F.col("l_suppkey").alias("key"), F.col("l_quantity").alias("amount"), "l_returnflag")
    return audit.RULES["match"]({"sent": x.where("l_returnflag = 'R'"), "received": x.where("l_returnflag = 'A'")})


@query("""WITH s AS (SELECT l_suppkey AS i, p_brand AS r, sum(p_size * l_quantity) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
    SELECT i::VARCHAR AS instance_id, 'linear' AS rule, r AS entity, s AS observed, 30000::DOUBLE AS "limit" FROM s WHERE s > 30000 + 1e-6""")
def audit_linear(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("instance_id"), F.col("l_partkey").alias("item"), F.col("l_quantity").alias("amount"))
    quantities = line.groupBy("instance_id", "item").agg(F.sum("amount").alias("amount"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("resource"), F.col("p_size").alias("coeff"))
    coefficients = quantities.select("instance_id", "item").join(part, "item")
    limits = coefficients.select("instance_id", "resource").distinct().withColumn("limit", F.lit(30000.0))
    return audit.RULES["linear"]({"coefficients": coefficients, "quantities": quantities, "limits": limits})


@query("SELECT l_suppkey, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def blend(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("amount"), F.col("l_discount").alias("value"))
    return rules.blend(x, ["l_suppkey"]).withColumn("mean", F.round("mean", 6))


@query("""WITH w AS (SELECT l_suppkey AS i, l_partkey AS asset, sum(CASE WHEN l_shipdate < TIMESTAMP '1995-01-01' THEN l_quantity ELSE 0 END) AS a, sum(CASE WHEN l_shipdate >= TIMESTAMP '1995-01-01' THEN l_quantity ELSE 0 END) AS b FROM lineitem GROUP BY ALL)
    SELECT i AS instance_id, sum(abs(a - b)) AS turnover, count(*) FILTER (b > 0) AS n_held, sum(b) AS total FROM w GROUP BY i""")
def turnover(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("instance_id"), F.col("l_partkey").alias("asset"), "l_quantity", (F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp")).alias("early"))
    own = lambda rows: rows.groupBy("instance_id", "asset").agg(F.sum("l_quantity").alias("weight"))
    return rules.turnover(own(x.where("early")), own(x.where("NOT early")))


@query("""WITH m AS (SELECT l_suppkey AS e, date_diff('month', TIMESTAMP '1992-01-01', l_shipdate) AS period, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS level FROM lineitem GROUP BY ALL), x AS (SELECT *, coalesce(lag(level) OVER (PARTITION BY e ORDER BY period), 0) AS b FROM m)
    SELECT e AS entity, count(*) FILTER (b = 0 AND level > 0) AS n_starts, sum(greatest(level - b, 0)) AS up, sum(greatest(b - level, 0)) AS down FROM x GROUP BY e""")
def level_changes(spark, sf_dir):
    period = (F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1
    x = table(spark, sf_dir, "lineitem").groupBy(F.lit(0).alias("instance_id"), F.col("l_suppkey").alias("entity"), period.alias("period")).agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("level"))
    return rules.level_changes(x).drop("instance_id")


@query(f"""WITH p AS (SELECT l_orderkey AS path, {ITEM} AS pos, l_suppkey % 25 AS src, l_partkey % 25 AS dst FROM lineitem), x AS (SELECT *, lag(dst) OVER (PARTITION BY path ORDER BY pos) AS came, row_number() OVER (PARTITION BY path ORDER BY pos) AS k FROM p)
    SELECT '0' AS instance_id, 'path' AS rule, path || '/' || pos AS entity, src::DOUBLE AS observed, came::DOUBLE AS "limit" FROM x WHERE k > 1 AND src <> came""")
def audit_path(spark, sf_dir):
    x = lines(spark, sf_dir)
    arc = F.pmod("l_suppkey", F.lit(25)) * 25 + F.pmod("l_partkey", F.lit(25))
    paths = x.select(F.lit(0).alias("instance_id"), F.col("l_orderkey").alias("path"), F.col("item").alias("pos"), arc.alias("arc_id"))
    arcs = paths.select("instance_id", "arc_id").distinct().withColumns({"src": F.floor(F.col("arc_id") / 25), "dst": F.pmod("arc_id", F.lit(25))})
    return audit.RULES["path"]({"paths": paths, "arcs": arcs})


@query(f"""WITH j AS (SELECT l_orderkey AS i, {ITEM} AS pos, l_quantity AS t, {DAY} % 60 AS due FROM lineitem), x AS (SELECT *, sum(t) OVER (PARTITION BY i ORDER BY pos ROWS UNBOUNDED PRECEDING) AS e FROM j) SELECT i AS instance_id, sum(greatest(e - due, 0.0)) AS tardiness FROM x GROUP BY i""")
def tardiness(spark, sf_dir):
    x = lines(spark, sf_dir)
    return rules.tardiness(x.select(F.col("l_orderkey").alias("instance_id"), F.col("item").alias("pos"), F.col("l_quantity").alias("time"), F.pmod("day", F.lit(60)).alias("due")))


@query(f"""WITH j AS (SELECT l_orderkey AS i, {ITEM} AS pos, l_quantity AS a, l_quantity * 0 + l_suppkey % 9 AS b FROM lineitem), p AS (SELECT *, sum(a) OVER w AS pa, sum(b) OVER w AS pb FROM j WINDOW w AS (PARTITION BY i ORDER BY pos ROWS UNBOUNDED PRECEDING))
    SELECT x.i AS instance_id, max(x.pa + y.pb - x.pb + x.b) AS makespan FROM p x JOIN (SELECT i, max(pb) AS pb FROM p GROUP BY i) y ON x.i = y.i GROUP BY x.i""")
def flow_shop(spark, sf_dir):
    """Two stages; the SQL takes the longest path over the job at which the second stage begins to run without a pause."""
    x = lines(spark, sf_dir)
    return rules.flow_shop(x.select(F.col("l_orderkey").alias("instance_id"), F.col("item").alias("pos"), F.col("l_quantity").alias("t_1"), F.pmod("l_suppkey", F.lit(9)).cast("double").alias("t_2")), 2)
