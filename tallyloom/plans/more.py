"""Queries of scoring's early ends, summaries, selections and dataset checks, each beside SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import datasets, evaluation, matching, scoring, training
from tallyloom.plans.queries import SCORED, query, scored, table

FAULTS = """f0 AS (SELECT event_id, user_id AS instance_id, ts, event_type AS condition, event_type <> 'error' AS verified,
        CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 13 = 1 THEN 'inf'::DOUBLE WHEN event_id % 23 = 0 THEN 0.0 WHEN event_id % 29 = 0 THEN -value ELSE value END AS cost,
        CASE WHEN event_id % 17 = 3 THEN 'KeyError: ' || props WHEN event_id % 17 = 4 THEN 'Timeout' WHEN event_id % 17 = 5 THEN 'SyntaxError' WHEN event_id % 17 = 6 THEN 'RecursionError' END AS error,
        CASE WHEN event_id % 19 = 4 THEN 0.4 WHEN event_id % 19 = 5 THEN 0.0 WHEN event_id % 19 = 6 THEN 1.0 END AS partial_score,
        CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 7 = 1 THEN 0.0 WHEN user_id % 7 = 2 THEN -5.0 ELSE (user_id % 50 + 20)::DOUBLE END AS reference_value, event_id % 5 = 0 AS new_approach FROM events),
    f1 AS (SELECT *, error IS NULL AND partial_score IS NULL AND cost IS NOT NULL AND coalesce(abs(cost) < 'inf'::DOUBLE, false) AS usable FROM f0),
    f2 AS (SELECT *, least(reference_value, min(CASE WHEN usable AND verified THEN cost END) OVER (PARTITION BY instance_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS best FROM f1),
    f3 AS (SELECT *, coalesce(reference_value > 0 AND abs(cost) < reference_value * 0.05, false) AS sus, coalesce(reference_value > 0 AND cost > 0, false) AS anchored, CASE WHEN cost > 0 THEN best / cost ELSE 'inf'::DOUBLE END AS ratio, CASE WHEN cost <> 0 THEN reference_value / cost END AS to_anchor,
        coalesce((reference_value = 0 AND abs(cost) < 1e-6) OR (reference_value > 0 AND abs(cost - reference_value) < 1e-6), false) AS exact FROM f2),
    f4 AS (SELECT *, NOT exact AND coalesce(reference_value > 0 AND cost > 0 AND cost < reference_value, false) AS beat,
        CASE WHEN best IS NULL THEN 1.0 WHEN best <= 0 THEN CASE WHEN anchored THEN least(2.0, greatest(0.0, to_anchor)) ELSE 1.0 END ELSE greatest(0.0, least(2.0, 2 * (ratio - 0.5))) END AS base0,
        CASE WHEN best IS NULL THEN 'first_valid' WHEN best <= 0 THEN CASE WHEN anchored THEN CASE WHEN to_anchor > 1.01 THEN 'improved' WHEN to_anchor < 0.99 THEN 'worse' ELSE 'similar' END ELSE 'first_valid' END WHEN ratio > 1.01 THEN 'improved' WHEN ratio < 0.99 THEN 'worse' ELSE 'similar' END AS st0 FROM f3),
    f5 AS (SELECT *, CASE WHEN exact THEN greatest(base0 + 0.2, 1.5) WHEN beat THEN greatest(base0 + least(0.5, 0.2 + 0.3 * (reference_value - cost) / abs(reference_value)), 1.5) ELSE base0 END
        + CASE WHEN coalesce(best > 0 AND cost > 0 AND cost < best, false) THEN 0.15 + CASE WHEN best / cost <= 1.1 THEN 0.05 * (best / cost - 1) / 0.1 ELSE 0 END ELSE 0 END AS base1,
        CASE WHEN exact THEN 'exact_match' WHEN beat THEN 'beat_reference' ELSE st0 END AS st1 FROM f4),
    f6 AS (SELECT *, CASE WHEN sus THEN 0.3 ELSE least(base1, 2.5) END AS s, CASE WHEN sus THEN 'suspicious_zero' ELSE st1 END AS st FROM f5),
    f7 AS (SELECT *, CASE WHEN verified THEN s ELSE least(s, 1.0) END AS capped FROM f6),
    faults AS (SELECT event_id, condition, instance_id, cost, reference_value, error, partial_score, verified,
        CASE WHEN error IS NOT NULL THEN CASE event_id % 17 WHEN 4 THEN -0.3 WHEN 6 THEN -0.2 ELSE -0.5 END WHEN partial_score > 0 THEN least(0.3 * partial_score, 0.5) WHEN partial_score IS NOT NULL THEN 0.0 WHEN cost IS NULL THEN 0.1 WHEN NOT usable THEN -0.2 WHEN new_approach THEN least(capped + 0.03, 2.5) ELSE capped END AS score,
        CASE WHEN error IS NOT NULL THEN 'exec_error' WHEN partial_score > 0 THEN 'partial_feasible' WHEN partial_score IS NOT NULL THEN 'infeasible' WHEN cost IS NULL THEN 'invalid_solution' WHEN NOT usable THEN 'solver_failure'
            WHEN verified AND cost < coalesce(nullif(best, 0), 'inf'::DOUBLE) AND st NOT IN ('exact_match', 'beat_reference') THEN 'new_best' WHEN NOT verified THEN 'unverified' ELSE st END AS status,
        error IS NOT NULL AND event_id % 17 IN (3, 5) AS parse_error, CASE WHEN usable AND reference_value <> 0 THEN (cost - reference_value) / abs(reference_value) END AS gap_to_reference, CASE WHEN usable AND best <> 0 THEN (cost - best) / abs(best) END AS gap_to_best FROM f7)"""


def faults(spark, sf_dir):
    at = lambda m, k: F.pmod("event_id", F.lit(m)) == k
    user = lambda k: F.pmod("user_id", F.lit(7)) == k
    e = table(spark, sf_dir, "events")
    rows = e.select(
        "event_id", F.col("user_id").alias("instance_id"), "ts", F.col("event_type").alias("condition"), (F.col("event_type") != "error").alias("verified"),
        F.when(at(13, 0), None).when(at(13, 1), float("inf")).when(at(23, 0), 0.0).when(at(29, 0), -F.col("value")).otherwise(F.col("value")).alias("cost"),
        F.when(at(17, 3), F.concat(F.lit("KeyError: "), "props")).when(at(17, 4), "Timeout").when(at(17, 5), "SyntaxError").when(at(17, 6), "RecursionError").alias("error"),
        F.when(at(19, 4), 0.4).when(at(19, 5), 0.0).when(at(19, 6), 1.0).alias("partial_score"),
        F.when(user(0), None).when(user(1), 0.0).when(user(2), -5.0).otherwise((F.pmod("user_id", F.lit(50)) + 20).cast("double")).alias("reference_value"), at(5, 0).alias("new_approach"),
    )
    return scoring.evaluate_rows(rows, ["ts", "event_id"])


@query(f"WITH {FAULTS} SELECT event_id, round(score + 1e-9, 4) AS score, status, parse_error, round(gap_to_reference + 1e-9, 4) AS gap_to_reference, round(gap_to_best + 1e-9, 4) AS gap_to_best FROM faults")
def evaluate_faults(spark, sf_dir):
    return faults(spark, sf_dir).select("event_id", "status", "parse_error", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("score", "gap_to_reference", "gap_to_best")])


@query(f"""WITH {FAULTS}, k AS (SELECT *, CASE WHEN error IS NOT NULL THEN CASE event_id % 17 WHEN 3 THEN 'keyerror' WHEN 4 THEN 'timeout' WHEN 5 THEN 'syntax' ELSE 'runtime' END END AS kind FROM faults),
    c AS (SELECT condition, string_agg(kind || '=' || n, ',' ORDER BY kind || '=' || n) AS error_classes FROM (SELECT condition, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
    SELECT condition, count(*) AS n_rows, round(avg(score), 6) AS mean_all, round(avg(score) FILTER (score > 0), 6) AS mean_valid, count(*) FILTER (score > 0) AS n_valid, count(*) FILTER (parse_error) AS n_parse_errors, count(*) FILTER (status = 'exec_error') AS n_exec_errors, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, error_classes FROM k JOIN c USING (condition) GROUP BY condition, error_classes""")
def evaluate_summary(spark, sf_dir):
    s = evaluation.evaluate_summary(faults(spark, sf_dir), ["condition"])
    return s.withColumns({c: F.round(c, 6) for c in ("mean_all", "mean_valid", "min_score", "max_score")})


BAD = "('exec_error', 'infeasible', 'partial_feasible', 'invalid_solution', 'solver_failure', 'gen_error', 'unverified', 'suspicious_zero')"


@query(f"""WITH {FAULTS}, g AS (SELECT *, status NOT IN {BAD} AND cost IS NOT NULL AND reference_value IS NOT NULL AS ok, greatest(abs(reference_value), 1) * 1e-6 AS slack FROM faults),
    s AS (SELECT condition, status, count(*) AS n FROM g GROUP BY 1, 2), m AS (SELECT condition, string_agg(status || '=' || n, ',' ORDER BY status) AS statuses FROM s GROUP BY 1)
    SELECT condition, count(*) FILTER (status IN ('exact_match', 'beat_reference', 'new_best')) AS n_reference, count(*) FILTER (ok AND cost <= reference_value + slack) AS n_analysis, count(*) FILTER (ok AND cost < reference_value - slack) AS n_strict, statuses FROM g JOIN m USING (condition) GROUP BY condition, statuses""")
def reference_counts(spark, sf_dir):
    c = evaluation.reference_counts(faults(spark, sf_dir), ["condition"])
    return c.withColumn("statuses", F.array_join(F.transform(F.map_entries("statuses"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


@query(f"WITH {FAULTS} SELECT DISTINCT condition, instance_id FROM faults")
def result_ids(spark, sf_dir):
    return evaluation.result_ids(faults(spark, sf_dir), ["condition"])


@query(f"""WITH {FAULTS}, r AS (SELECT instance_id, status AS reason, count(*) AS n, count(*) FILTER (status NOT IN {BAD}) AS ok FROM faults WHERE event_id % 40 < 4 GROUP BY 1, 2)
    SELECT instance_id, sum(n)::BIGINT AS n_tried, string_agg(reason || '=' || n, ',' ORDER BY reason || '=' || n) AS reasons FROM r GROUP BY 1 HAVING sum(ok) = 0""")
def reject_table(spark, sf_dir):
    x = faults(spark, sf_dir).where("event_id % 40 < 4").withColumn("feasible", ~F.col("status").isin(*scoring.FAILED))
    return evaluation.reject_table(x, "instance_id", "status").select("instance_id", "n_tried", "reasons")


@query(f"WITH {SCORED} SELECT instance_id, condition, min(cost) AS cost FROM scored WHERE status <> 'unverified' GROUP BY 1, 2")
def feasible_costs(spark, sf_dir):
    return evaluation.feasible_costs(scored(spark, sf_dir).withColumn("feasible", F.col("status") != "unverified"), "instance_id", "cost", "condition")


@query("SELECT user_id, count(*) AS n_runs, count(*) FILTER (event_type = 'purchase') / count(*) AS repaired_rate, count(*) FILTER (event_type = 'error') / count(*) AS fallback_rate, count(*) FILTER (value > 50) / count(*) AS first_ok_rate FROM events GROUP BY user_id")
def agent_rates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "purchase").alias("repaired"), (F.col("event_type") == "error").alias("fallback"), (F.col("value") > 50).alias("first_ok"))
    return evaluation.agent_rates(e, ["user_id"])


@query("SELECT lang, count(*) AS n_start, count(*) FILTER (source IS NOT NULL) AS after_source, count(*) FILTER (source IS NOT NULL AND n_chars >= 300) AS after_length, count(*) FILTER (source IS NOT NULL AND n_chars >= 300 AND text NOT LIKE '%@%') AS after_mail FROM documents GROUP BY lang")
def funnel(spark, sf_dir):
    return evaluation.funnel(table(spark, sf_dir, "documents"), ["lang"], {"source": F.col("source").isNotNull(), "length": F.col("n_chars") >= 300, "mail": ~F.contains("text", F.lit("@"))})


@query(f"WITH {SCORED}, u AS (SELECT condition, instance_id, max(status) AS status FROM scored GROUP BY 1, 2) SELECT e.event_id, u.status FROM events e JOIN u ON e.event_type = u.condition AND e.user_id = u.instance_id WHERE u.status IN ('worse', 'unverified')")
def keep_verified(spark, sf_dir):
    verdict = scored(spark, sf_dir).groupBy("condition", "instance_id").agg(F.max("status").alias("status"))
    answers = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("condition"), F.col("user_id").alias("instance_id"))
    return matching.keep_verified(answers, verdict, ["worse", "unverified"]).select("event_id", "status")


@query(f"WITH {SCORED}, u AS (SELECT condition, instance_id, CASE WHEN bool_or(status = 'worse') THEN 'worse' ELSE 'unverified' END AS status FROM scored WHERE status IN ('worse', 'unverified') GROUP BY 1, 2) SELECT e.event_id, u.status FROM events e JOIN u ON e.event_type = u.condition AND e.user_id = u.instance_id")
def keep_verified_repeats(spark, sf_dir):
    """Many verdicts for each condition and instance, of which some are equal."""
    answers = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("condition"), F.col("user_id").alias("instance_id"))
    return matching.keep_verified(answers, scored(spark, sf_dir).select("condition", "instance_id", "status"), ["worse", "unverified"]).select("event_id", "status")


@query("""WITH x AS (SELECT 0 AS late, doc_id, lang, text FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT 1, doc_id, lang, text FROM documents WHERE doc_id % 4 = 0)
    SELECT doc_id, lang FROM x QUALIFY row_number() OVER (PARTITION BY lang, sha256(trim(text, ' ')) ORDER BY late, doc_id) = 1""")
def append_candidates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return matching.append_candidates(d.where("doc_id % 4 <> 0"), d.where("doc_id % 4 = 0"), ["lang"], "text", ["doc_id"]).select("doc_id", "lang")


@query("""WITH g AS (SELECT 'train' AS grp, o_custkey AS instance_id FROM orders WHERE o_orderpriority < '3' UNION SELECT 'val', o_custkey FROM orders WHERE o_orderpriority >= '3' UNION SELECT 'all', c_custkey FROM customer), d AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
    SELECT grp, instance_id, user_id IS NOT NULL AS in_demos FROM g LEFT JOIN d ON user_id = instance_id""")
def exposure_groups(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "instance_id")
    groups = {"train": o.where("o_orderpriority < '3'"), "val": o.where("o_orderpriority >= '3'"), "all": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("instance_id"))}
    return matching.exposure_groups(groups, table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("instance_id")))


@query(f"""WITH {SCORED}, s AS (SELECT status, count(*) AS n FROM scored GROUP BY 1)
    SELECT (SELECT count(*) FROM customer) AS n_instances, (SELECT count(*) FROM scored) AS n_pairs, (SELECT count(*) FROM scored WHERE score >= 1) AS n_kept, (SELECT string_agg(status || '=' || n, ',' ORDER BY status || '=' || n) FROM s) AS verdicts, (SELECT count(DISTINCT instance_id) FROM scored WHERE score >= 1) AS n_covered""")
def build_stats(spark, sf_dir):
    return matching.build_stats(table(spark, sf_dir, "customer"), scored(spark, sf_dir).withColumn("kept", F.col("score") >= 1))


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id * 7919 % 104729, doc_id) - 1 AS round FROM documents), g AS (SELECT *, row_number() OVER (ORDER BY round, lang) - 1 AS place FROM r)
    SELECT doc_id, lang, CASE WHEN place < 25 THEN 'validation' ELSE 'train' END AS split FROM g""")
def stratified_validation(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return datasets.stratified_validation(d, "lang", F.struct(F.pmod(F.col("doc_id") * 7919, F.lit(104729)), "doc_id"), 25)


@query("""WITH x AS (SELECT lang, n_chars % 5 AS k FROM documents UNION ALL SELECT lang, n_chars % 5 FROM documents WHERE doc_id % 2 = 0), g AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k) - 1 AS round FROM x), p AS (SELECT *, row_number() OVER (ORDER BY round, lang) - 1 AS place FROM g)
    SELECT lang, CASE WHEN place < 33 THEN 'validation' ELSE 'train' END AS split, count(*) AS n, min(k) AS least FROM p GROUP BY 1, 2""")
def stratified_validation_repeats(spark, sf_dir):
    """Rows without an id, most of them repeated."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.pmod("n_chars", F.lit(5)).alias("k"))
    x = datasets.stratified_validation(d.union(d.where("doc_id % 2 = 0")).drop("doc_id"), "lang", F.col("k"), 33)
    return x.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("least"))


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 3 AS base FROM documents")
def assign_bases(spark, sf_dir):
    return datasets.assign_bases(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], 3)


@query("SELECT lang, count(*) AS n_rows, 40::BIGINT AS wanted FROM documents GROUP BY lang HAVING count(*) <> 40")
def check_spec(spark, sf_dir):
    return datasets.check_spec(table(spark, sf_dir, "documents"), {"train": 30, "validation": 4, "test": 6}, "lang")


@query(r"WITH d AS (SELECT doc_id, text, regexp_extract(text, '[0-9]{1,4}') AS n FROM documents) SELECT doc_id FROM d WHERE n <> '' AND regexp_matches(text, '(^|[^0-9.])' || n || '($|[^0-9.]|\.($|[^0-9]))')")
def reference_leaks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("reference", F.nullif(F.regexp_extract("text", "[0-9]{1,4}", 0), F.lit("")))
    return datasets.reference_leaks(d, "text", "reference").select("doc_id")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 9")
def head_per_split(spark, sf_dir):
    return training.head_per_split(table(spark, sf_dir, "documents"), "lang", ["doc_id"], 9).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE doc_id % 10 = 0 OR length(text) <= 700")
def max_prompt_chars(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("split", F.when(F.pmod("doc_id", F.lit(10)) == 0, "validation").otherwise("train"))
    return training.max_prompt_chars(d, "text", 700).select("doc_id")


@query("SELECT event_id, CASE WHEN event_id % 6 NOT IN (0, 1, 2, 3) THEN 'tools_disabled' END AS tool_reason FROM events")
def filter_tools(spark, sf_dir):
    k = F.pmod("event_id", F.lit(6))
    tools = F.when(k == 0, None).when(k == 1, "").when(k == 2, " [] ").when(k == 3, "null").otherwise(F.concat(F.lit('[{"name": "t", "parameters": '), "props", F.lit("}]")))
    return training.filter_tools(table(spark, sf_dir, "events").withColumn("tools", tools)).select("event_id", "tool_reason")


@query("""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS n_labels, (length(text) - length(replace(text, ' ', '')) + 1) % 40 + 1 AS n FROM documents WHERE doc_id % 3 <> 0),
    b AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM x), t AS (SELECT batch, (ceil(max(n) / 8.0) * 8)::BIGINT AS target FROM b GROUP BY 1)
    SELECT doc_id AS key, batch, target AS n_ids, target AS n_labels, n::BIGINT AS n_mask, target - n + n - 1 AS n_masked FROM b JOIN t USING (batch)""")
def padded(spark, sf_dir):
    n = (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1) % 40 + 1
    rows = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("key"), n.cast("int").alias("n"))
    ids = F.array_repeat(F.lit(7), F.col("n"))
    rows = rows.select("key", ids.alias("input_ids"), F.concat(F.array_repeat(F.lit(training.MASKED), F.col("n") - 1), F.array(F.lit(7))).alias("labels"))
    out = training.padded(rows, 16, 8)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("key", "batch", F.size("input_ids").cast("long").alias("n_ids"), F.size("labels").cast("long").alias("n_labels"), total("attention_mask").alias("n_mask"), F.size(F.filter("labels", lambda x: x == training.MASKED)).cast("long").alias("n_masked"))


@query(f"WITH {SCORED}, e AS (SELECT event_id, score, CASE event_id WHEN 40 THEN 1 WHEN 7 THEN 2 WHEN 93 THEN 3 ELSE 4 END AS place FROM scored WHERE status = 'beat_reference' OR event_id IN (40, 7, 93)) SELECT event_id, round(score, 6) AS score FROM e QUALIFY row_number() OVER (ORDER BY place, event_id) <= 12")
def select_exemplars(spark, sf_dir):
    x = scored(spark, sf_dir)
    ok = (F.col("status") == "beat_reference") | F.col("event_id").isin(40, 7, 93)
    return datasets.select_exemplars(x, ok, [40, 7, 93], "event_id", 12).select("event_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, source FROM documents QUALIFY CASE WHEN coalesce(source, lang) = 'src0' THEN true WHEN coalesce(source, lang) < 'src2' THEN row_number() OVER (PARTITION BY coalesce(source, lang) ORDER BY doc_id) <= 3 ELSE row_number() OVER (PARTITION BY coalesce(source, lang) ORDER BY doc_id) <= 2 END")
def first_n_per_kind(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumns({"kind": F.col("source"), "core_type": F.col("lang")})
    kinds = [r[0] for r in d.select(F.coalesce("kind", "core_type")).distinct().collect()]  # sources are few
    return matching.first_n_per_kind(d, {k: 0 if k == "src0" else 3 if k < "src2" else 2 for k in kinds if k is not None}, "doc_id", 2).select("doc_id", "source")


@query("WITH s AS (SELECT p_partkey AS instance_id FROM part), g AS (SELECT DISTINCT l_orderkey * 100000 + l_linenumber AS instance_id, l_partkey AS template_id FROM lineitem) SELECT template_id, count(*) AS n FROM (SELECT instance_id, instance_id AS template_id FROM s UNION ALL SELECT * FROM g) GROUP BY 1")
def map_template(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 100000 + F.col("l_linenumber")).alias("instance_id"), F.col("l_partkey").alias("template_id")).distinct()
    return matching.map_template(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("instance_id")), g).groupBy("template_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT l_orderkey AS i, sum(l_quantity) AS recomputed, count(*) FILTER (l_returnflag = 'R') AS other FROM lineitem GROUP BY 1), d AS (SELECT o_orderkey AS i, round(o_totalprice / 5000)::DOUBLE AS declared FROM orders)
    SELECT d.i::VARCHAR AS instance_id, CASE WHEN coalesce(other = 0 AND abs(declared - recomputed) > 0.5, false) THEN recomputed ELSE declared END AS declared, coalesce(other = 0 AND abs(declared - recomputed) > 0.5, false) AS aligned FROM d LEFT JOIN s USING (i)""")
def align_declared(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    s = lines.groupBy(F.col("l_orderkey").alias("i")).agg(F.sum("l_quantity").alias("recomputed"), F.count_if(F.col("l_returnflag") == "R").alias("other"))
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.round(F.col("o_totalprice") / 5000).alias("declared")).join(s, "i", "left").withColumn("instance_id", F.col("i").cast("string"))
    found = v.where("abs(declared - recomputed) > 0.5").select("instance_id", F.lit("declared").alias("rule")).union(v.where("other > 0").select("instance_id", F.lit("returned")))
    return matching.align_declared(v.select("instance_id", "declared", "recomputed"), found)


@query("""WITH r AS (SELECT event_type AS condition, user_id AS instance_id, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS model FROM events WHERE event_type IN ('view', 'click')), n AS (SELECT condition, instance_id, count(*) AS n FROM r GROUP BY 1, 2)
    SELECT 'differs' AS problem, 'model' AS key UNION ALL SELECT 'repeated', condition || '/' || instance_id FROM n WHERE n > 1 UNION ALL SELECT 'missing', c.condition || '/' || c_custkey FROM customer, (SELECT unnest(['view', 'click']) AS condition) c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.condition = c.condition AND n.instance_id = c_custkey)""")
def merge_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("condition"), F.col("user_id").alias("instance_id"), F.when(F.pmod("user_id", F.lit(2)) == 0, "a").otherwise("b").alias("model"))
    expected = table(spark, sf_dir, "customer").select(F.explode(F.array(F.lit("view"), F.lit("click"))).alias("condition"), F.col("c_custkey").alias("instance_id"))
    return matching.merge_runs([e.where("condition = 'view'"), e.where("condition = 'click'")], ["model"], expected)[1]


@query("SELECT user_id AS instance_id, count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'view' UNION ALL SELECT o_custkey FROM orders) WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) GROUP BY 1")
def collect_answers(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("instance_id"))
    files, shards = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("instance_id"), "event_id"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("instance_id"))
    return matching.collect_answers(files, shards, known).groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT n_name AS subset, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey UNION SELECT r_name, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT subset, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total FROM orders JOIN s ON o_custkey = c_custkey GROUP BY subset""")
def with_subsets(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = c.select(F.explode(F.array("n_name", "r_name")).alias("subset"), F.array("c_custkey").alias("ids"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("instance_id"), "o_totalprice")
    return matching.with_subsets(rows, own).groupBy("subset").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT lang, min(doc_id) AS least, max(doc_id) AS greatest, count(*) AS n FROM documents GROUP BY lang")
def seeded_shuffle(spark, sf_dir):
    """Every row is there once; that the order is fixed is a test's."""
    return matching.seeded_shuffle(table(spark, sf_dir, "documents"), ["doc_id"], 7).groupBy("lang").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"), F.count(F.lit(1)).alias("n"))


@query("SELECT unnest(['digest', 'count']) AS problem")
def check_manifest(spark, sf_dir):
    """A data set that lacks a document of its manifest; against its own manifest it has no problem, as tests show."""
    d, cols = table(spark, sf_dir, "documents"), ["doc_id", "lang", "text"]
    return datasets.check_manifest(d.where("doc_id > 0"), datasets.dataset_digest(d, "doc_id", cols, 500), "doc_id", cols, 500)


@query(f"WITH {FAULTS}, x AS (SELECT condition, status, 0 AS b, 1 AS a FROM faults UNION ALL SELECT condition, CASE WHEN verified THEN 'ok' ELSE 'unverified' END, 1, 0 FROM faults) SELECT condition, status, sum(b)::BIGINT AS n_before, sum(a)::BIGINT AS n_after FROM x GROUP BY 1, 2")
def status_changes(spark, sf_dir):
    x = faults(spark, sf_dir).withColumn("old_status", F.when(F.col("verified"), "ok").otherwise("unverified"))
    return matching.status_changes(x, ["condition"])


@query("""WITH r AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS iteration, CASE l_linenumber % 4 WHEN 0 THEN 'KeyError: a' WHEN 1 THEN 'timeout' WHEN 2 THEN 'odd' END AS error FROM lineitem), x AS (SELECT *, lead(l_partkey) OVER w IS NOT NULL AND lead(error) OVER w IS NULL AS fixed FROM r WINDOW w AS (PARTITION BY l_partkey ORDER BY iteration))
    SELECT iteration, CASE error WHEN 'KeyError: a' THEN 'keyerror' WHEN 'timeout' THEN 'timeout' ELSE 'runtime' END AS error_class, count(*) AS n, count(*) FILTER (fixed) AS n_fixed FROM x WHERE error IS NOT NULL GROUP BY 1, 2""")
def revision_errors(spark, sf_dir):
    from pyspark.sql import Window

    k = F.pmod("l_linenumber", F.lit(4))
    x = table(spark, sf_dir, "lineitem").select("l_partkey", F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey")).alias("iteration"), F.when(k == 0, "KeyError: a").when(k == 1, "timeout").when(k == 2, "odd").alias("error"))
    return evaluation.revision_errors(x, "l_partkey")


@query("""WITH d AS (SELECT lang AS kind, CASE WHEN doc_id % 5 = 0 THEN source || '+own' WHEN doc_id % 7 > 0 THEN source END AS source, CASE WHEN doc_id % 2 = 0 THEN 'raw' END AS origin FROM documents), x AS (SELECT 'kind' AS level, coalesce(kind, 'unknown') AS name FROM d UNION ALL SELECT 'source/origin', coalesce(source, 'unknown') || '/' || coalesce(origin, 'unknown') FROM d UNION ALL SELECT 'merged', CASE WHEN contains(source, '+') THEN 'both' ELSE coalesce(source, 'unknown') END FROM d)
    SELECT level, name, count(*) AS n FROM x GROUP BY 1, 2""")
def composition_by_source(spark, sf_dir):
    source = F.when(F.pmod("doc_id", F.lit(5)) == 0, F.concat("source", F.lit("+own"))).when(F.pmod("doc_id", F.lit(7)) > 0, F.col("source"))
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("kind"), source.alias("source"), F.when(F.pmod("doc_id", F.lit(2)) == 0, "raw").alias("origin"))
    return matching.composition(d, "both")
