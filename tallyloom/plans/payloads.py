"""Queries of the payload and prompt operators, over JSON that Spark makes of the tables, each beside SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import payloads, prompts, suites
from tallyloom.plans.queries import query, table


def turn(col, n, *cases):
    """The case of a column's remainder."""
    out = F.lit(None).cast("string")
    for k, c in enumerate(cases):
        out = F.when(F.pmod(col, F.lit(n)) == k, F.format_string(*c) if isinstance(c, tuple) else F.lit(c)).otherwise(out)
    return out


def problems(spark, sf_dir):
    """An order as a problem record: its price is the reference, its key and a half the solution, in six forms."""
    x, z, i = F.col("o_totalprice").cast("string"), (F.col("o_orderkey") + 1.5).cast("string"), F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    return o.select(
        i.alias("instance_id"),
        turn(i, 6, ('{"objective_value": %s, "schedule": [1, 2, 3]}', x), ('{"num_items": 3, "total_cost": %s, "plan": {"a": 1, "b": 2}}', x), ('{"makespan": 1, "peak_usage": %s, "schedule": [{"t": 1}], "note": 5}', x), ('{"max_profit": %s, "items": [1, 2], "flag": true}', x), ('{"total_count": 2, "coverage_rate": %s, "rows": [1, 2]}', x), '{"feasible": true, "label": "7"}').alias("reference"),
        turn(i, 6, ('{"objective_value": %s, "schedule": [1]}', z), ('{"cost": %s, "plan": {"a": 1}}', z), ('{"peak_usage": %s, "other": []}', z), ('{"max_profit": %s, "items": [4]}', z), '{"coverage_rate": -1, "rows": [1]}', "{}").alias("solution"),
        turn(i, 6, "x", "費用を最小に", "ピークを最小化", "maximize profit", "", "x").alias("objective"),
    )


@query("""SELECT o_orderkey AS instance_id, ['objective_value', 'total_cost', 'peak_usage', 'max_profit', 'coverage_rate'][o_orderkey % 6 + 1] AS field, o_totalprice AS value, o_orderkey % 6 < 3 AS is_min, [1.0, 5.99, 6.99, 10.0, -0.01][o_orderkey % 6 + 1]::DOUBLE AS rank_score FROM orders WHERE o_orderkey % 6 <> 5""")
def rank_objective_fields(spark, sf_dir):
    return payloads.rank_objective_fields(problems(spark, sf_dir))


@query("SELECT o_orderkey AS instance_id, CASE WHEN o_orderkey % 6 <> 5 THEN o_totalprice END AS reference_value FROM orders")
def reference_value(spark, sf_dir):
    return payloads.reference_value(problems(spark, sf_dir))


@query("SELECT o_orderkey AS instance_id, round(CASE o_orderkey % 6 WHEN 0 THEN o_orderkey + 1.5 WHEN 1 THEN o_orderkey + 1.5 WHEN 3 THEN o_totalprice * o_totalprice / (o_orderkey + 1.5) WHEN 4 THEN o_totalprice * 10 END, 4) AS cost FROM orders")
def normalized_cost(spark, sf_dir):
    return payloads.normalized_cost(problems(spark, sf_dir)).withColumn("cost", F.round("cost", 4))


@query("SELECT o_orderkey AS instance_id, CASE WHEN o_orderkey % 6 < 3 THEN o_orderkey + 1.5 WHEN o_orderkey % 6 = 3 THEN 1 / (o_orderkey + 1.5) END AS cost FROM orders")
def reference_free_cost(spark, sf_dir):
    return payloads.reference_free_cost(problems(spark, sf_dir))


@query("SELECT o_orderkey AS instance_id, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey * 2.0 WHEN o_orderkey % 6 < 3 THEN o_orderkey + 1.5 WHEN o_orderkey % 6 = 3 THEN 1 / (o_orderkey + 1.5) END AS cost FROM orders")
def score_costs(spark, sf_dir):
    rows = problems(spark, sf_dir).withColumn("core_type", F.when(F.pmod("instance_id", F.lit(6)) == 0, "double_key").otherwise("other"))
    suites.scorer("double_key")(lambda r: r.select("instance_id", (F.col("instance_id") * 2.0).alias("cost")))
    return suites.score_costs(rows, payloads.reference_free_cost)


@query("""SELECT o_orderkey AS instance_id, CASE o_orderkey % 5 WHEN 0 THEN o_totalprice / (o_orderkey + 1) WHEN 1 THEN 2.0 WHEN 2 THEN -3.0 / (o_orderkey + 1) WHEN 3 THEN o_totalprice / 4 END AS ratio FROM orders""")
def generic_ratio(spark, sf_dir):
    i, x = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    z = (i + 1).cast("string")
    o = table(spark, sf_dir, "orders").select(i.alias("instance_id"), turn(i, 5, ('{"a": 9, "score": 5, "cost": %s}', z), '{"x": "0", "y": 0}', ("%s", z), '{"n": true, "y": 4, "z": 5}', '{"cost": 1}').alias("solution"), turn(i, 5, ('{"total_cost": %s, "other": 1}', x), '{"makespan": 3}', '{"makespan": -3}', ('{"total_delay": 1, "total_distance": %s}', x), '{"total_cost": 0}').alias("reference"))
    return payloads.generic_ratio(o)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE o_orderpriority END || '_' || CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE o_orderstatus END AS core_type, 'prob_' || CASE WHEN o_orderkey < 1000 THEN lpad(o_orderkey::VARCHAR, 3, '0') ELSE o_orderkey::VARCHAR END AS instance_id FROM orders")
def derive_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("id"), F.when(F.pmod("o_orderkey", F.lit(5)) != 0, F.col("o_orderpriority")).alias("domain"), F.when(F.pmod("o_orderkey", F.lit(7)) != 0, F.col("o_orderstatus")).alias("math_type"))
    return payloads.derive_keys(o).select("o_orderkey", "core_type", "instance_id")


@query("""WITH p AS (SELECT doc_id, unnest(['id', 'lang', 'words', 'grid', 'info', 'rows']) AS field FROM documents WHERE lang IS NOT NULL)
    SELECT doc_id, field, CASE field WHEN 'id' THEN 'number' WHEN 'lang' THEN 'string' WHEN 'info' THEN 'object' ELSE 'array' END AS kind, CASE field WHEN 'words' THEN doc_id % 3 + 1 WHEN 'grid' THEN 2 WHEN 'info' THEN 2 WHEN 'rows' THEN 1 END::INT AS size, CASE field WHEN 'words' THEN 'string' WHEN 'grid' THEN 'array' WHEN 'rows' THEN 'object' END AS element_kind,
        CASE field WHEN 'info' THEN 'b,n' WHEN 'rows' THEN 'a,z' END AS names, CASE field WHEN 'grid' THEN 3 END::INT AS n_columns FROM p""")
def profile_json(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    words = F.array_join(F.array_repeat(F.lit('"w"'), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")), ", ")
    made = F.format_string('{"id": %s, "lang": "%s", "words": [%s], "grid": [[1, 2, 3], [4]], "info": {"n": 1, "b": false}, "rows": [{"z": 1, "a": null}]}', F.col("doc_id").cast("string"), "lang", words)
    return payloads.profile_json(d.select("doc_id", made.alias("payload")), "doc_id", "payload")


def shapes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.pmod("doc_id", F.lit(4)).alias("template_id"), turn(F.col("doc_id"), 4, ('{"b": [1, 2, %s], "a": 1.5}', F.col("doc_id").cast("string")), ('{"%s": 2, "-7": 5}', F.col("doc_id").cast("string")), '{"m": [[1, 2], [3]], "t": "x", "f": true, "z": null}', "[]").alias("payload"))


SIGNS = "['{a:number,b:[3 number]}', 'map#2<number>', '{f:bool,m:[2 [1 number]|[2 number]],t:text,z:none}', '[0 ]']"


@query(f"SELECT doc_id, {SIGNS}[doc_id % 4 + 1] AS shape FROM documents")
def shape_signature(spark, sf_dir):
    return shapes(spark, sf_dir).select("doc_id", payloads.shape_signature(F.col("payload")).alias("shape"))


@query(f"SELECT doc_id, doc_id % 4 AS template_id, {SIGNS}[doc_id % 4 + 1] AS shape, '{{}}' AS expected FROM documents WHERE doc_id % 4 = 3")
def shape_drift(spark, sf_dir):
    x = shapes(spark, sf_dir)
    base = x.where("doc_id < 3").select("template_id", "payload").union(spark.createDataFrame([(3, "{}")], "template_id long, payload string"))
    return payloads.shape_drift(x, base, "doc_id", "template_id", "payload")


@query("SELECT event_id, ['vrptw_md', 'pdptw', 'crew_pairing', 'crew_pairing_seniority', 'fjsp', 'portfolio_cvar', NULL, NULL][event_id % 8 + 1] AS kind FROM events")
def suite_of(spark, sf_dir):
    """Payloads whose keys alone do not tell the kind: an absent key, a list's type, a value deep inside; and some of no kind."""
    p = turn(F.col("event_id"), 8, ('{"customers": [%s], "depots": [], "vehicle_types": []}', F.col("event_id").cast("string")), '{"pairs": [], "depots": [], "vehicle_types": []}', '{"flights": [], "bases": null}', '{"flights": [], "bases": [], "crews": []}', '{"machines": [], "jobs": [{"operations": [{"machine_options": {}}]}]}', '{"assets": [], "scenario_returns": [], "risk": {"measure": "CVaR"}}', '{"depots": {}, "customers": [], "vehicle_types": []}', "[1]")
    return table(spark, sf_dir, "events").select("event_id", suites.suite_of(p).alias("kind"))


@query("SELECT event_id, event_id % 3 < 2 AS has, CASE WHEN event_id % 3 < 2 THEN event_id::VARCHAR END AS customers, CASE WHEN event_id % 3 = 0 THEN 7.5 END::DOUBLE AS vehicle_capacity, CASE WHEN event_id % 3 = 1 THEN event_id END::DOUBLE AS total_distance FROM events")
def vrp_view(spark, sf_dir):
    k = F.col("event_id").cast("string")
    e = table(spark, sf_dir, "events").select("event_id", turn(F.col("event_id"), 3, ('{"Customers": %s, "truck_capacity": "7.5"}', k), ('{"initial_customers": %s, "vehicle_capacity": true}', k), "{}").alias("i"), turn(F.col("event_id"), 3, "{}", ('{"initial_routes": [], "total_initial_distance": %s}', k), "{}").alias("s"))
    x = payloads.vrp_view(e, "i", "s")
    return x.select("event_id", F.col("customers").isNotNull().alias("has"), "customers", "vehicle_capacity", "total_distance")


@query("""WITH u AS (SELECT event_id, unnest([0, 1]) AS j FROM events WHERE event_id % 4 < 3)
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN j WHEN 1 THEN j ELSE event_id + j END AS index, CASE WHEN j = 0 THEN '5' ELSE '[1]' END AS value, true AS readable FROM u UNION ALL SELECT event_id, NULL, NULL, false FROM events WHERE event_id % 4 = 3""")
def explode_index(spark, sf_dir):
    k, n = F.col("event_id"), (F.col("event_id") + 1).cast("string")
    p = turn(k, 4, '{"0": 5, "1": [1]}', "[5, [1]]", ('{"bin_%s": 5, "bin_%s": [1]}', k.cast("string"), n), '{"p0c1": 5, "x": 1}')
    return payloads.explode_index(table(spark, sf_dir, "events").select("event_id", p.alias("p")), "event_id", "p")


@query("""SELECT event_id, (event_id % 4) + 1 AS index, event_id::DOUBLE AS count, true AS readable FROM events WHERE event_id % 4 < 2 UNION ALL SELECT event_id, j, CASE WHEN j = 0 THEN 3 ELSE event_id END::DOUBLE, true FROM events, (SELECT unnest([0, 1]) AS j) WHERE event_id % 4 = 2
    UNION ALL SELECT event_id, NULL, NULL, false FROM events WHERE event_id % 4 = 3""")
def explode_counts(spark, sf_dir):
    k = F.col("event_id").cast("string")
    p = turn(F.col("event_id"), 4, ('{"1": %s}', k), ('[{"id": 2, "qty": "%s"}]', k), ("[3, %s]", k), '[{"id": 2}, 5]')
    return payloads.explode_counts(table(spark, sf_dir, "events").select("event_id", p.alias("p")), "event_id", "p")


@query("""SELECT event_id, j AS pos, CASE WHEN j = 0 THEN event_id ELSE 3 END AS a, CASE WHEN j = 0 THEN 1 ELSE 4 END AS b, true AS readable FROM events, (SELECT unnest([0, 1]) AS j) WHERE event_id % 3 < 2 UNION ALL SELECT event_id, NULL, NULL, NULL, false FROM events WHERE event_id % 3 = 2""")
def explode_pairs(spark, sf_dir):
    k = F.col("event_id").cast("string")
    p = turn(F.col("event_id"), 3, ("[[%s, 1], [3, 4]]", k), ('[{"left": %s, "right": 1}, {"i": 3, "right": "4"}]', k), "[[1, true]]")
    return payloads.explode_pairs(table(spark, sf_dir, "events").select("event_id", p.alias("p")), "event_id", "p", ["left", "i"], ["right"])


@query("SELECT event_id, 0 AS pos, event_id::VARCHAR AS src, 'b' AS dst, true AS readable FROM events WHERE event_id % 3 < 2 UNION ALL SELECT event_id, NULL, NULL, NULL, false FROM events WHERE event_id % 3 = 2")
def explode_edges(spark, sf_dir):
    k = F.col("event_id").cast("string")
    p = turn(F.col("event_id"), 3, ('[{"u": %s, "target": "b"}]', k), ('[[%s, "b", 9]]', k), '[{"from": 1}]')
    return payloads.explode_edges(table(spark, sf_dir, "events").select("event_id", p.alias("p")), "event_id", "p")


@query("SELECT event_id, j AS period, CASE WHEN j = 0 THEN 1.5 ELSE event_id END::DOUBLE AS value, true AS readable FROM events, (SELECT unnest([0, 1]) AS j) WHERE event_id % 4 < 3 UNION ALL SELECT event_id, NULL, NULL, false FROM events WHERE event_id % 4 = 3")
def explode_series(spark, sf_dir):
    k = F.col("event_id").cast("string")
    p = turn(F.col("event_id"), 4, ("[1.5, %s]", k), ('{"10": %s, "2": 1.5}', k), ('[{"amount": 1.5}, {"level": %s, "x": 0}]', k), '["a"]')
    return payloads.explode_series(table(spark, sf_dir, "events").select("event_id", p.alias("p")), "event_id", "p", ["amount", "level"])


@query("SELECT event_id, 0 AS a, j + 1 AS b, CASE WHEN j = 0 THEN event_id ELSE 2.5 END::DOUBLE AS value, true AS readable FROM events, (SELECT unnest([0, 1]) AS j) WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL, NULL, NULL, false FROM events WHERE event_id % 2 = 1")
def explode_flat_pairs(spark, sf_dir):
    p = turn(F.col("event_id"), 2, ('{"plant_0_to_1": %s, "plant_0_to_2": 2.5}', F.col("event_id").cast("string")), '{"plant_0": 1}')
    return payloads.explode_flat_pairs(table(spark, sf_dir, "events").select("event_id", p.alias("p")), "event_id", "p")


@query("""WITH j AS (SELECT event_id, unnest(['0', '1', '2']) AS job FROM events) SELECT event_id, job, CASE WHEN event_id % 2 = 0 THEN CASE job WHEN '0' THEN 0 WHEN '1' THEN 1 ELSE 1 END ELSE CASE job WHEN '2' THEN 1 ELSE 0 END END AS machine, event_id % 4 IN (1, 2) AS zero_based FROM j""")
def normalize_assignment(spark, sf_dir):
    p = turn(F.col("event_id"), 4, '{"0": 1, "1": 2, "2": 2}', '{"0": ["0", "1"], "1": ["2"]}', "[0, 1, 1]", '{"1": [0, 1], "2": [2]}')
    return payloads.normalize_assignment(table(spark, sf_dir, "events").select("event_id", F.lit(2).alias("machines"), p.alias("p")), "event_id", "p", "machines")


def records(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("instance_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), F.col("lang").alias("domain"), F.col("source").alias("math_type"), F.lit(None).cast("string").alias("difficulty"), F.substring("text", 1, 700).alias("description"), F.lit("least cost").alias("objective"),
                    F.when(F.pmod("doc_id", F.lit(2)) == 0, F.array(F.lit("one"), F.lit("two"))).alias("constraints"), F.col("text").alias("instance"), F.when(F.pmod("doc_id", F.lit(3)) == 0, F.col("n_chars") / 4).alias("reference_value"), F.array(F.lit("a"), F.lit("b")).alias("fields"))


HEAD = "'## doc ' || doc_id || chr(10) || coalesce(lang, 'unknown') || ' / ' || coalesce(source, 'unknown') || ' / N/A'"
GOAL = "chr(10) || chr(10) || '## Requirements' || chr(10) || 'Objective: least cost' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '- one' || chr(10) || '- two' ELSE '' END"
FIELDS = "chr(10) || chr(10) || '## Fields to return' || chr(10) || 'a, b'"


@query(f"""WITH t AS (SELECT *, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, {HEAD} || CASE WHEN t <> '' THEN chr(10) || chr(10) || '## Description' || chr(10) || substr(t, 1, 700) ELSE '' END || {GOAL}
        || CASE WHEN t <> '' THEN chr(10) || chr(10) || '## Data' || chr(10) || CASE WHEN length(t) > 6000 THEN substr(t, 1, 6000) || ' ... (cut; the whole data is there at run time)' ELSE t END ELSE '' END
        || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || '## Reference value' || chr(10) || printf('%.2f', n_chars / 4.0) ELSE '' END || {FIELDS} AS prompt FROM t) SELECT doc_id AS instance_id, sha256(prompt) AS prompt FROM p""")
def render_prompt(spark, sf_dir):
    return prompts.render_prompt(records(spark, sf_dir)).select("instance_id", F.sha2("prompt", 256).alias("prompt"))


@query(f"""WITH t AS (SELECT *, substr(coalesce(text, ''), 1, 700) AS t FROM documents), p AS (SELECT doc_id, {HEAD} || CASE WHEN t <> '' THEN chr(10) || chr(10) || '## Description' || chr(10) || CASE WHEN length(t) > 500 THEN substr(t, 1, 500) || ' ...' ELSE t END ELSE '' END || {GOAL} || {FIELDS} AS prompt FROM t)
    SELECT doc_id AS instance_id, sha256(prompt) AS prompt FROM p""")
def render_compact_prompt(spark, sf_dir):
    return prompts.render_prompt(records(spark, sf_dir), hide_reference=True, compact=True).select("instance_id", F.sha2("prompt", 256).alias("prompt"))


@query("SELECT d.doc_id AS instance_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1")
def export_prompts(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("instance_id"))
    return prompts.export_prompts(records(spark, sf_dir), ids).where(~F.contains("prompt", F.lit("## Reference value"))).select("instance_id")


@query("""SELECT event_id, '{"requirement":"r' || event_id || '"}' AS demo FROM events WHERE event_id % 3 < 2 UNION ALL SELECT event_id, '{"requirement":"deep"}' FROM events WHERE event_id % 3 = 1""")
def explode_demos(spark, sf_dir):
    k = F.col("event_id").cast("string")
    p = turn(F.col("event_id"), 3, ('{"demos": [{"requirement": "r%s"}, 5]}', k), ('{"a": {"demos": [{"requirement": "r%s"}]}, "b": [{"c": {"demos": [{"requirement": "deep"}]}}]}', k), '{"demos": 3}')
    return prompts.explode_demos(table(spark, sf_dir, "events").select("event_id", p.alias("p")), "event_id", "p")


@query("""WITH x AS (SELECT *, ['similar', 'worse', 'suspicious_zero', 'partial_feasible', 'first_valid', 'beat_reference'][event_id % 6 + 1] AS status, (event_id % 40 - 20) / 100.0 AS gap FROM events), t AS (SELECT event_id,
    CASE WHEN status = 'partial_feasible' THEN 'Constraints are violated:' || chr(10) || '- v' WHEN status = 'beat_reference' THEN 'Better than or as good as before. The cost is ' || printf('%.4f', value) || '.' ELSE 'Feasible, with room to improve. The cost is ' || printf('%.4f', value) || '.' END AS a,
    CASE status WHEN 'similar' THEN 'It is as good as the best before.' WHEN 'worse' THEN 'Try another method, such as local search after a greedy one, or give a solver more time and a start.' WHEN 'suspicious_zero' THEN 'The cost is far below what is known, so the solution may be empty: assign every job or customer.' WHEN 'partial_feasible' THEN 'Most constraints hold: check the one that fails before each step.' WHEN 'first_valid' THEN 'It is the first valid solution, from which to improve.' ELSE 'It is better than the reference; go on below the best that is known.' END AS b,
    CASE WHEN event_id % 7 > 0 THEN ' Against the best before: ' || printf('%+.1f', gap * 100) || ' %.' ELSE '' END AS c, CASE WHEN event_id % 5 = 0 THEN ' Bonuses: exact +0.20, new +0.15.' ELSE '' END AS d, CASE WHEN status IN ('first_valid', 'beat_reference') THEN '' ELSE ' Hint: sort first' END AS e, CASE WHEN status = 'suspicious_zero' THEN ' Fields of the instance: jobs, machines.' ELSE '' END AS f FROM x) SELECT event_id, a || ' ' || b || c || d || e || f || ' Score 0.50.' AS feedback FROM t""")
def feedback_details(spark, sf_dir):
    """Texts without references, with gaps, bonuses, hints and fields."""
    i = F.col("event_id")
    status = turn(i, 6, "similar", "worse", "suspicious_zero", "partial_feasible", "first_valid", "beat_reference")
    e = table(spark, sf_dir, "events").select("event_id", status.alias("status"), F.lit(0.5).alias("score"), F.col("value").alias("cost"), F.lit(20.0).alias("reference_value"), F.lit(0.3).alias("gap_to_reference"), F.lit(None).cast("string").alias("error"), F.array(F.lit("v")).alias("violations"), F.when(F.pmod(i, F.lit(7)) > 0, (F.pmod(i, F.lit(40)) - 20) / 100.0).alias("gap_to_best"), F.lit("sort first").alias("hint"), F.array(F.lit("jobs"), F.lit("machines")).alias("keys"))
    e = e.withColumn("bonuses", F.when(F.pmod(i, F.lit(5)) == 0, F.create_map(F.lit("new"), F.lit(0.15), F.lit("exact"), F.lit(0.2), F.lit("none"), F.lit(0.0))))
    return prompts.feedback_text(e, use_reference=False, detailed=True).select("event_id", "feedback")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'The code failed (keyerror): KeyError: ' || props || '. To mend it: read optional fields with a default.' WHEN 1 THEN 'Constraints are violated:' || chr(10) || '- v' || array_to_string(range(1, 7), chr(10) || '- v') || chr(10) || 'and 3 more'
    WHEN 2 THEN 'The solution is empty or has not the fields that are asked for.' WHEN 3 THEN 'Better than or as good as before. The cost is ' || printf('%.4f', value) || ', the reference 20.00.' ELSE 'Feasible, with room to improve. The cost is ' || printf('%.4f', value) || '.' END || ' Score 0.50.' AS feedback FROM events""")
def feedback_text(spark, sf_dir):
    k = F.pmod("event_id", F.lit(5))
    e = table(spark, sf_dir, "events").select("event_id", turn(F.col("event_id"), 5, "exec_error", "infeasible", "invalid_solution", "new_best", "worse").alias("status"), F.lit(0.5).alias("score"), F.col("value").alias("cost"), F.when(k == 3, 20.0).alias("reference_value"), F.when(k == 0, F.concat(F.lit("KeyError: "), "props")).alias("error"), F.when(k == 1, F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.concat(F.lit("v"), i.cast("string")))).alias("violations"))
    return prompts.feedback_text(e).select("event_id", "feedback")
