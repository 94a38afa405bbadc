"""Registered queries of the joins, subsets and comparisons, each beside SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.numbers import RANGE, mix32_of, mix32_sql
from tallyloom.operators import matching
from tallyloom.plans.queries import V, query, table, verdicts
from tallyloom.streaming import results


@query(f"WITH {V}, p AS (SELECT DISTINCT o_custkey AS instance_id FROM orders) SELECT event_id, p.instance_id IS NOT NULL AND condition <> 'error' AS rescored FROM v LEFT JOIN p USING (instance_id)")
def join_problems(spark, sf_dir):
    rows = verdicts(spark, sf_dir).withColumn("code", F.when(F.col("verified"), F.col("condition")))
    problems = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("instance_id")).distinct()
    return matching.join_problems(rows, problems).select("event_id", "rescored")


MEANS = f"{V}, m AS (SELECT instance_id, event_id % 2 AS half, avg(cost) AS score FROM v GROUP BY ALL)"


def halves(spark, sf_dir):
    m = verdicts(spark, sf_dir).groupBy("instance_id", F.pmod("event_id", F.lit(2)).alias("half")).agg(F.avg("cost").alias("score"))
    return m.where("half = 0"), m.where("half = 1")


@query(f"WITH {MEANS} SELECT instance_id, b.score - a.score AS delta FROM m a JOIN m b USING (instance_id) WHERE a.half = 0 AND b.half = 1 AND b.score - a.score IS NOT NULL")
def paired_deltas(spark, sf_dir):
    return matching.paired_deltas(*halves(spark, sf_dir), ["instance_id"])


@query(f"WITH {MEANS} SELECT instance_id, a.score AS old_cost, b.score AS new_cost FROM m a JOIN m b USING (instance_id) WHERE a.half = 0 AND b.half = 1 AND abs(a.score - b.score) > 1.0")
def cost_mismatches(spark, sf_dir):
    old, new = (h.withColumnRenamed("score", "cost") for h in halves(spark, sf_dir))
    return matching.cost_mismatches(old, new, ["instance_id"], 1.0)


@query("SELECT doc_id, text, lang FROM documents WHERE lang IN ('en', 'de') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND text IS NOT NULL")
def only_kinds(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("instance_id"), F.col("quality").cast("string").alias("kind"))
    docs = table(spark, sf_dir, "documents").where("lang IN ('en', 'de') AND text IS NOT NULL").withColumnRenamed("doc_id", "instance_id")
    return matching.only_kinds(docs, labels, ["1"]).select(F.col("instance_id").alias("doc_id"), "text", "lang")


@query("SELECT o_orderkey AS instance_id, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def exclude_templated(spark, sf_dir):
    templates = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("template_id"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("instance_id"), "o_totalprice")
    return matching.exclude_templated(orders, templates)


@query("WITH n AS (SELECT DISTINCT substr(split_part(text, ' ', 2), 1, 9) AS name FROM benchmark UNION SELECT 'the' UNION SELECT 'er the ') SELECT conv_id * 1000 + turn AS text_id, name FROM conversations JOIN n ON contains(text, name) WHERE name <> ''")
def contains_join(spark, sf_dir):
    texts = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), "text")
    names = table(spark, sf_dir, "benchmark").select(F.substring(F.split_part("text", F.lit(" "), F.lit(2)), 1, 9).alias("name"))
    return matching.contains_join(texts, names.union(spark.createDataFrame([("the",), ("er the ",)], "name string")))


@query(f"WITH {V}, x AS (SELECT unnest([condition, 'all']) AS subset, cost FROM v) SELECT subset, count(*) AS n_rows, avg(cost) AS mean_cost FROM x WHERE subset IS NOT NULL GROUP BY subset")
def subset_means(spark, sf_dir):
    v = verdicts(spark, sf_dir).withColumn("instance_id", F.col("event_id"))
    named = matching.subset_names(v, "condition").groupBy("subset", "instance_id").count().drop("count")
    return named.join(v, "instance_id").groupBy("subset").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("cost").alias("mean_cost"))


@query(f"WITH {V} SELECT condition, count(*) AS n_rows, avg(reference_value) AS old_mean, avg(cost) AS new_mean, count(*) FILTER (WHERE verified) AS n_status_changed, count(*) FILTER (WHERE cost > reference_value) AS n_up, count(*) FILTER (WHERE cost < reference_value) AS n_down FROM v GROUP BY condition")
def rescore_summary(spark, sf_dir):
    v = verdicts(spark, sf_dir).select("condition", F.col("cost").alias("score"), F.when(F.col("verified"), "ok").otherwise("error").alias("status"), F.col("reference_value").alias("old_score"), F.lit("error").alias("old_status"))
    return matching.rescore_summary(v, ["condition"])


@query("SELECT lang, source, count(*) FILTER (WHERE doc_id % 10 <> 0) AS n_train, count(*) FILTER (WHERE doc_id % 10 = 0) AS n_validation FROM documents GROUP BY ROLLUP (lang, source)")
def distribution(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("split", F.when(F.pmod("doc_id", F.lit(10)) == 0, "validation").otherwise("train"))
    return matching.distribution(docs, ["lang", "source"], "split", ["train", "validation"])


@query(f"""WITH {V}, own AS (SELECT instance_id, condition, bool_or(verified) AS ok, min(CASE WHEN verified THEN cost END) AS c FROM v GROUP BY ALL),
    b AS (SELECT *, c = min(c) OVER (PARTITION BY instance_id) AS best FROM own)
    SELECT condition, count(*) AS n_tried, count(*) FILTER (WHERE ok) AS n_feasible, count(*) FILTER (WHERE best) AS n_best FROM b GROUP BY condition""")
def teacher_coverage(spark, sf_dir):
    return matching.teacher_coverage(verdicts(spark, sf_dir).withColumnRenamed("verified", "feasible"), "condition")


@query("WITH x AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, source, k <= greatest(3, n // 3) AS in_tail FROM x")
def tail_split(spark, sf_dir):
    return matching.tail_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")


@query("""WITH s AS (SELECT doc_id, lang, source, CASE WHEN lang = 'en' THEN CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END END AS split FROM documents),
    x AS (SELECT *, count(DISTINCT split) OVER (PARTITION BY lang) = 2 AS both_there, row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= floor(count(*) OVER (PARTITION BY lang) * 0.75) AS early FROM s)
    SELECT doc_id, lang, CASE WHEN both_there THEN split WHEN early THEN 'train' ELSE 'test' END AS part FROM x""")
def split_or_ratio(spark, sf_dir):
    own = F.when(F.col("lang") == "en", F.when(F.pmod("doc_id", F.lit(5)) == 0, "test").otherwise("train"))
    return matching.split_or_ratio(table(spark, sf_dir, "documents").select("doc_id", "lang").withColumn("split", own), "lang", "doc_id", 0.75).select("doc_id", "lang", "part")


@query("SELECT c_custkey AS instance_id, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) AND c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL AND event_type = 'purchase')")
def untouched(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("instance_id"), "c_nationkey")
    return matching.untouched(own, table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("instance_id")), table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("instance_id")))


@query(f"WITH {V} SELECT instance_id, min(cost) AS best_cost, arg_min(cost, (ts, cost)) AS first_cost FROM v WHERE verified AND cost IS NOT NULL GROUP BY instance_id")
def stream_best_known(spark, sf_dir):
    """The stream's transformation over the whole table; tests/test_operators.py runs it as a stream."""
    return results.stream_best_known(verdicts(spark, sf_dir))


D = "d AS (SELECT instance_id, b.score - a.score AS delta FROM m a JOIN m b USING (instance_id) WHERE a.half = 0 AND b.half = 1 AND b.score - a.score IS NOT NULL)"


@query(f"""WITH {MEANS}, {D}, g AS (SELECT DISTINCT instance_id, unnest([condition, 'all']) AS grp FROM v), x0 AS (SELECT grp, instance_id, instance_id % 10 = 0 AS demo, delta FROM d JOIN g USING (instance_id)),
    x AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY instance_id) - 1 AS k FROM x0), n AS (SELECT grp, count(*) AS n, avg(delta) AS mean, avg(delta) FILTER (NOT demo) AS rest FROM x GROUP BY 1),
    r0 AS (SELECT range AS round, (range + {mix32_of(42)}) % {RANGE} AS x FROM range(200)), r AS (SELECT round, {mix32_sql("x")} AS h FROM r0), q AS (SELECT range AS draw, {mix32_sql("(range + 1)")} AS m FROM range((SELECT max(n) FROM n))),
    y AS (SELECT grp, n, round, xor(h, m) AS x FROM n, r, q WHERE draw < n), p AS (SELECT grp, round, floor({mix32_sql("x")} * n / {RANGE})::BIGINT AS k FROM y),
    ms AS (SELECT p.grp, round, avg(delta) AS m FROM p JOIN x ON p.grp = x.grp AND p.k = x.k GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY m, round) - 1 AS i FROM ms),
    e AS (SELECT grp, max(CASE WHEN i = 5 THEN m END) AS lo, max(CASE WHEN i = 195 THEN m END) AS hi FROM i GROUP BY 1)
    SELECT grp, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, lo > 0 OR hi < 0 AS significant, round(rest, 6) AS mean_without_demos FROM e JOIN n USING (grp)""")
def diagnose_effects(spark, sf_dir):
    deltas = matching.paired_deltas(*halves(spark, sf_dir), ["instance_id"])
    v = verdicts(spark, sf_dir)
    named = {r[0]: v.where(F.col("condition") == r[0]) for r in v.select("condition").distinct().collect()}  # a few conditions
    groups = matching.exposure_groups(named | {"all": v}, v.where(F.pmod("instance_id", F.lit(10)) == 0))
    out = matching.diagnose_effects(deltas, groups, 200, 42)
    return out.select("grp", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi", "mean_without_demos")], "significant")
