"""Small frames that reach the branches of operators, beside the queries on the tables."""

import importlib
import random
import sys

import numpy as np
import math

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.numbers import close, close_soft, le_soft, mix32, mix32_of, num
from tallyloom.functions.tables import ranked
from tallyloom.operators import audit, checks, datasets, evaluation, matching, payloads, prompts, rules, scoring, suites, training
from tallyloom.sources import files
from tallyloom.streaming import results

SEED = 42


@pytest.mark.parametrize("n", [13, 25, 100, 1000])
def test_bootstrap_spreads_like_a_library_one(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(0.1, 1.0, n)
    rounds = 2000
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "grp int, k long, delta double")
    got = scoring.paired_bootstrap(df, rounds, SEED).first()
    means = np.sort(x[rng.integers(0, n, (20_000, n))].mean(axis=1))
    lo, hi = means[int(0.025 * 20_000)], means[int(0.975 * 20_000)]
    assert abs((got.hi - got.lo) / (hi - lo) - 1) < 0.07 and abs(got.lo - lo) < 0.1 * (hi - lo) and abs(got.mean - x.mean()) < 1e-12
    # The spread of the resampled means themselves, by the same hash in numpy.
    mix = lambda v: np.array([mix32_of(int(a)) for a in v], np.uint64)
    h, m = mix((np.arange(500) + mix32_of(SEED)) % 2**32), mix(np.arange(1, n + 1))
    k = (mix((h[:, None] ^ m[None, :]).ravel()).reshape(500, n) * np.uint64(n) >> np.uint64(32)).astype(int)
    assert abs(x[k].mean(axis=1).std() / (x.std() / n**0.5) - 1) < 0.1


def test_bootstrap_of_constants_has_no_width_and_repeats(spark):
    df = spark.createDataFrame([("a", i, 0.25) for i in range(7)] + [("b", i, float(i)) for i in range(5)], "grp string, k long, delta double")
    a, b = (scoring.paired_bootstrap(df, 300, 1).orderBy("grp").collect() for _ in range(2))
    assert a == b and a[0].lo == a[0].hi == a[0].mean == 0.25 and a[1].lo <= a[1].mean <= a[1].hi
    assert scoring.paired_bootstrap(df, 300, 2).orderBy("grp").collect() != a


def test_mixer_is_one_to_one(spark):
    got = [r[0] for r in spark.range(5000).select(mix32(F.col("id") * 859_433 % 2**32)).collect()]
    assert len(set(got)) == 5000 and got == [mix32_of(i * 859_433 % 2**32) for i in range(5000)] and abs(np.mean(got) / 2**32 - 0.5) < 0.02


def test_numbers(spark):
    rows = [("5", 5.0), ('"5.5"', 5.5), ("true", None), ("1e3", 1000.0), ("1e999", None), ("x", None), (" 7 ", 7.0), (None, None), ("-.5", -0.5), ("NaN", None)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string, v double").select(num(F.col("t"))).collect()] == [v for _, v in rows]
    pairs = spark.createDataFrame([(1.0, 1.0 + 5e-7), (1.0, 1.001), (1.0, 1.1), (1.1, 1.0), (100.0, 100.15)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    assert [tuple(r) for r in pairs.select(close(a, b), close_soft(a, b), le_soft(a, b)).collect()] == [(True, True, True), (False, True, True), (False, False, True), (False, False, False), (False, True, True)]


def test_ranked_any_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(50)) for i in range(500)]
    got = ranked(spark.createDataFrame(rows, "g string, id int, v int").repartition(7), ["g"], ["v", "id"], "k").collect()
    want = {}
    for g in ("a", "b", None):
        for k, (_, i, _) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))):
            want[i] = k
    assert {r.id: r.k for r in got} == want and len(got) == 500
    assert ranked(spark.createDataFrame([], "g string, id int"), ["g"], ["id"], "k").count() == 0


def test_only_usable_rows_move_the_best(spark):
    rows = [(1, "p", 10.0, True, None, 0.5), (2, "p", 90.0, True, None, None), (3, "p", 5.0, True, "KeyError: 'x'", None), (4, "p", 50.0, False, None, None), (5, "p", 80.0, True, None, None), (6, "p", float("inf"), True, None, None), (7, "p", None, True, None, None)]
    x = spark.createDataFrame([(*r, 100.0) for r in rows], "n int, instance_id string, cost double, verified boolean, error string, partial_score double, reference_value double")
    got = {r.n: (r.status, r.best_before, round(r.score, 4)) for r in scoring.evaluate_rows(x, ["n"]).collect()}
    assert got[1] == ("partial_feasible", 100.0, 0.15) and got[2][:2] == ("beat_reference", 100.0) and got[3] == ("exec_error", 90.0, -0.5)
    assert got[4][:2] == ("unverified", 90.0) and got[4][2] <= 1.0 and got[5][1] == 90.0 and got[6] == ("solver_failure", 80.0, -0.2) and got[7] == ("invalid_solution", 80.0, 0.1)
    free = {r.n: r for r in scoring.evaluate_rows(x, ["n"], use_reference=False).collect()}
    assert free[2].best_before is None and free[2].status == "new_best" and free[5].best_before == 90.0 and free[2].baseline == 90.0


def test_gap_is_for_feasible_statuses(spark):
    rows = [("exact_match", 10.0, 10.0, 0.0), ("partial_feasible", 10.0, 10.0, None), ("unverified", 10.0, 10.0, None), ("similar", 1e-9, 0.0, 0.0), ("similar", 1.0, 0.0, float("inf")), ("worse", 15.0, 10.0, 0.5), ("odd status", 1.0, 1.0, None), ("worse", None, 1.0, None)]
    x = spark.createDataFrame(rows, "status string, cost double, reference_value double, want double")
    assert [r[0] for r in x.select(scoring.gap(F.col("cost"), F.col("reference_value"), F.col("status"))).collect()] == [r[3] for r in rows]
    s = evaluation.summarize_run(x.withColumns({"score": F.lit(1.0), "output_tokens": F.lit(None).cast("int")}), [], 0.1).first()
    assert (s.n_problems, s.n_correct, s.n_at_least_reference, s.n_feasible, s.mean_tokens) == (8, 2, 1, 4, 0.0)


def test_names_are_found_anywhere(spark):
    texts = spark.createDataFrame([(1, "we solve the Knapsack, fast"), (2, "xbinpackingx"), (3, None), (4, "")], "text_id int, text string")
    names = spark.createDataFrame([("Knapsack",), ("bin",), ("",), ("solve the Knapsack, f",), ("absent",)], "name string")
    assert sorted(map(tuple, matching.contains_join(texts, names).collect())) == [(1, "Knapsack"), (1, "solve the Knapsack, f"), (2, "bin")]
    assert matching.contains_join(texts, names.where("name = ''")).count() == 0


def test_split_without_valid_rows_is_an_error(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a b"), (2, 0, "user", "c"), (2, 1, "assistant", "d e")], "conv_id long, turn long, role string, text string")
    rows, counts = training.prepare_split(turns, 10)
    assert [r.conv_id for r in rows.collect()] == [2] and {(r.reason, r.n_rows) for r in counts.collect()} == {("valid", 1), ("no_supervised_tokens", 1)}
    with pytest.raises(ValueError, match="no_supervised_tokens 1"):
        training.prepare_split(turns, 10, limit=1)
    tools = spark.createDataFrame([(2, '[{"name": "t"}]')], "conv_id long, tools string")
    with pytest.raises(ValueError, match="tools_disabled 1"):
        training.prepare_split(turns, 10, tools=tools)
    assert training.prepare_split(turns, 10, tools=tools, include_tools=True)[0].count() == 1


def test_spans_marked_as_untrainable(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "a b", None), (1, 1, "assistant", "c", False), (1, 2, "assistant", "d", True)], "conv_id long, turn long, role string, text string, trainable boolean")
    assert [r.supervised for r in training.supervised_spans(turns, F.col("trainable")).orderBy("turn").collect()] == [True, False, True]


def test_rejects_and_padding_errors(spark):
    v = spark.createDataFrame([(1, True, 2, 1.0, 1.0), (2, True, 0, None, 1.0), (3, True, 0, 1.0, None), (4, False, 0, 1.0, 1.0), (5, True, 0, 0.0, 0.0)], "id int, verified boolean, violations int, cost double, reference_value double")
    assert [r.reject for r in training.select_correct(v, 0.1).orderBy("id").collect()] == ["violations", "no_cost", "no_reference", "unverified", None]
    rows = spark.createDataFrame([(1, [5, 6], [-100, 6]), (2, [7], [7])], "key int, input_ids array<int>, labels array<int>")
    got = training.padded(rows, 2, 4).orderBy("key").collect()
    assert [(r.input_ids, r.labels, r.attention_mask) for r in got] == [([5, 6, 0, 0], [-100, 6, -100, -100], [1, 1, 0, 0]), ([7, 0, 0, 0], [7, -100, -100, -100], [1, 0, 0, 0])]
    with pytest.raises(Exception, match="no label"):
        training.padded(rows.withColumn("labels", F.array(F.lit(-100))), 2, 4).collect()
    m = spark.createDataFrame([(1, [("user", "x")])], "id int, messages array<struct<role:string,content:string>>")
    assert training.with_system(m, None).collect() == m.collect()


def test_ids_past_their_range_are_an_error(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)], "g string, id int")
    assert datasets.assign_ids(df, "g", ["id"], 100, 5).count() == 5
    with pytest.raises(Exception, match="more than 4 rows"):
        datasets.assign_ids(df, "g", ["id"], 100, 4).collect()


def test_digest_tree(spark):
    df = spark.createDataFrame([(i % 400, f"t{i % 400}") for i in range(401)], "id int, text string")
    one, two = (datasets.dataset_digest(df.repartition(k), "id", ["id", "text"], 5).first() for k in (1, 6))
    assert one == two and one.n_records == 401 and not one.unique_keys
    assert datasets.dataset_digest(df.where("id <> 7"), "id", ["id", "text"], 5).first().digest != one.digest
    assert datasets.check_manifest(df.dropDuplicates(), datasets.dataset_digest(df.dropDuplicates(), "id", ["text"]), "id", ["text"]).count() == 0
    assert {r[0] for r in datasets.check_manifest(df, datasets.dataset_digest(df.dropDuplicates(), "id", ["text"]), "id", ["text"]).collect()} == {"digest", "count", "keys"}


def test_repeated_rows_keep_their_number(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 3), (None, None), (None, None)], "s string, id int")
    out = datasets.stratified_validation(df, "s", F.col("id"), 3).collect()
    assert len(out) == 6 and sorted(r.split for r in out) == ["train"] * 3 + ["validation"] * 3 and {r.s for r in out if r.split == "validation"} == {"a", "b", None}
    verdicts = spark.createDataFrame([("c", 1, "good"), ("c", 1, "good"), ("c", 1, "fair"), ("c", 2, "bad")], "condition string, instance_id int, status string")
    answers = spark.createDataFrame([("c", 1, "x"), ("c", 1, "x"), ("c", 2, "y"), ("d", 1, "z")], "condition string, instance_id int, answer string")
    assert sorted(tuple(r) for r in matching.keep_verified(answers, verdicts, ["fair", "good"]).collect()) == [("c", 1, "x", "fair")] * 2


def test_each_instance_has_its_radius(spark):
    p = spark.createDataFrame([(1, 1, 5.0, 0.0), (2, 1, 5.0, 0.0)], "instance_id int, item int, x double, y double")
    c = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], "instance_id int, cx double, cy double")
    r = spark.createDataFrame([(1, 10.0), (2, 1.0)], "instance_id int, radius double")
    assert [(v.instance_id, v.limit) for v in audit.RULES["radius"]({"points": p, "centres": c, "radius": r}).collect()] == [("2", 1.0)]


def test_no_tour_is_shorter_than_its_bound(spark):
    import itertools
    import random

    rng = random.Random(1)
    d = {(a, b): rng.randrange(1, 40) for a, b in itertools.combinations(range(6), 2)}
    e = spark.createDataFrame([(1, a, b, float(x)) for (a, b), x in d.items()] + [(2, 0, 1, 3.0), (2, 1, 0, 3.0)], "instance_id int, u int, v int, length double")
    got = {r.instance_id: r.bound for r in checks.tour_bound(e).collect()}
    near = sum(sum(sorted(x for k, x in d.items() if n in k)[:2]) for n in range(6)) / 2
    best = min(sum(d[tuple(sorted(p))] for p in zip((0, *t), (*t, 0))) for t in itertools.permutations(range(1, 6)))
    assert got == {1: near, 2: 6.0} and near <= best


def test_strips_meet_only_what_is_near(spark):
    import random

    rng = random.Random(4)
    rows = [(1, 0, i, rng.uniform(0, 90), rng.uniform(0, 90), *rng.choice([(0.1, 80.0), (80.0, 0.1), (1.0, 1.0), (7.0, 3.0)])) for i in range(150)]
    got = {(r.item, r.other) for r in checks.overlapping_rectangles(spark.createDataFrame(rows, "instance_id int, bin int, item int, x double, y double, w double, h double")).collect()}
    want = {(a[2], b[2]) for a in rows for b in rows if a[2] < b[2] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5] and a[4] < b[4] + b[6] and b[4] < a[4] + a[6]}
    assert got == want and len(want) > 100


def test_deep_demos_and_shapes(spark):
    deep, wide = '{"x": ' * 8 + '{"demos": [{"a": {"demos": [{"b": 1}]}}]}' + "}" * 8, '{"k": ' * 6 + "%s" + "}" * 6
    p = spark.createDataFrame([(1, deep), (2, "[[[" + deep + "]]]"), (3, None)], "id int, p string")
    assert sorted((r.id, r.demo) for r in prompts.explode_demos(p, "id", "p").collect()) == [(i, d) for i in (1, 2) for d in ('{"a":{"demos":[{"b":1}]}}', '{"b":1}')]
    s = spark.createDataFrame([(1, wide % "1"), (2, wide % '"1"'), (3, wide % "2.5"), (4, "[" * 900), (5, "NaN")], "id int, p string").select("id", payloads.shape_signature(F.col("p")).alias("s"))
    got = {r.id: r.s for r in s.collect()}
    assert got[1] == got[3] != got[2] and got[4] is None and got[5] is None


@pytest.mark.parametrize("block, draws", [(1 << 20, 1 << 26), (7, 40), (100, 1)])
def test_bootstrap_blocks_do_not_change_digits(spark, block, draws):
    import numpy as np
    from tallyloom.functions.numbers import RANGE, mix32_of

    rng = np.random.default_rng(3)
    own = {g: rng.normal(size=n) for g, n in (("a", 1), ("b", 30), ("c", 101))}
    df = spark.createDataFrame([(g, k, float(v)) for g, x in own.items() for k, v in enumerate(x)], "grp string, k long, delta double")
    got = {r.grp: (r.mean, r.lo, r.hi) for r in scoring.paired_bootstrap(df, 40, 5, block, draws).collect()}
    for g, x in own.items():
        means = sorted(np.mean([x[int(mix32_of(mix32_of((r + mix32_of(5)) % RANGE) ^ mix32_of(d)) * len(x) / RANGE)] for d in range(1, len(x) + 1)]) for r in range(40))
        assert got[g] == pytest.approx((x.mean(), means[1], means[39]))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    puts = []
    monkeypatch.setattr(checks.Shelf, "put", lambda self, df, name, own=checks.Shelf.put: puts.append(name) or own(self, df, name))
    n = 10_000
    e = spark.range(n).select(F.lit(1).alias("instance_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(2.0).alias("length"))
    ring = spark.createDataFrame([(1, 90_000, 90_001, 1.0), (1, 90_001, 90_000, 1.0), (1, 5000, 5001, 7.0)], "instance_id int, src long, dst long, length double")
    got = {r.node: r.value for r in checks.path_values(e.union(ring), spark.createDataFrame([(1, 0)], "instance_id int, node long")).collect()}
    assert got == {i: 2.0 * i for i in range(n + 1)} and len(puts) < 24


def test_paths_equal_a_plain_search(spark):
    import random

    rng = random.Random(6)
    rows = [(i, rng.randrange(30), rng.randrange(30), float(rng.randrange(1, 9))) for i in range(3) for _ in range(38)]
    got = {(r.instance_id, r.node): r.value for r in checks.path_values(spark.createDataFrame(rows, "instance_id int, src int, dst int, length double"), spark.createDataFrame([(i, i) for i in range(3)] + [(0, 7)], "instance_id int, node int")).collect()}
    want = {(0, 0): 0.0, (0, 7): 0.0, (1, 1): 0.0, (2, 2): 0.0}
    for _ in range(40):
        for i, a, b, d in rows:
            if (i, a) in want and want[i, a] + d < want.get((i, b), math.inf):
                want[i, b] = want[i, a] + d
    assert got == want


def test_degenerate_validation_is_all_train(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "s string, id int")
    for n in (0, 2, 5):
        assert {r.split for r in datasets.stratified_validation(df, "s", F.col("id"), n).collect()} == {"train"}
    assert sorted(r.split for r in datasets.stratified_validation(df, "s", F.col("id"), 1).collect()) == ["train", "validation"]


def test_shuffle_is_fixed_by_its_seed(spark):
    df = spark.range(200)
    a, b, c = ([r.id for r in matching.seeded_shuffle(df.repartition(k), ["id"], s).collect()] for k, s in ((2, 1), (5, 1), (5, 2)))
    assert a == b != c and sorted(c) == list(range(200)) and a != sorted(a)


def test_errors_by_their_own_words(spark):
    said = ["invalid syntax here", "'solve' is not defined", "Timeout after KeyError", "import of os is not allowed", "Banned import: x", "AttributeError", "TypeError", "IndexError: x", "", None]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "t string").select(scoring.classify_error(F.col("t"))).collect()]
    assert got == ["syntax", "no_solve", "keyerror", "import", "import", "attribute", "type", "index", "runtime", "runtime"]


def test_code_of_answers(spark):
    said = [("a\n```python\nx\n```\n```\nlonger\n```", "longer"), ("```py\nopen tail", "open tail"), ("  bare  ", "bare"), ("```\n```", ""), (None, None)]
    got = [r[0] for r in spark.createDataFrame(said, "t string, w string").select(datasets.extract_code(F.col("t"))).collect()]
    assert got[:3] == [w for _, w in said[:3]] and got[4] is None


def test_recursions_equal_loops(spark):
    rng = random.Random(3)
    for _ in range(3):
        flow = [(0, 0, i, float(rng.randrange(9)), float(rng.randrange(9))) for i in range(40)]
        level, want = 0.0, []
        for *_, a, b in flow:
            level = max(0.0, level + a - b)
            want.append(level)
        df = spark.createDataFrame(flow, "instance_id int, entity int, period int, inflow double, outflow double")
        assert [r.level for r in audit.clipped(df).orderBy("period").collect()] == want
        stops = [(0, 0, i, float(rng.randrange(5)), float(rng.randrange(3)), float(rng.randrange(60)), float(rng.randrange(40, 90))) for i in range(12)]
        now, late, waited = 0.0, 0, 0.0
        for *_, travel, service, lo, hi in stops:
            now += travel
            waited += max(0.0, lo - now)
            now = max(now, lo)
            late += now > hi
            now += service
        c = checks.route_clock(spark.createDataFrame(stops, "instance_id int, route int, pos int, travel double, service double, tw_start double, tw_end double")).first()
        assert (c.end, c.n_late, c.waited) == (now, late, waited)
        jobs = [(0, i, *(float(rng.randrange(1, 9)) for _ in range(4))) for i in range(9)]
        done = [0.0] * 5
        for _, _, *times in jobs:
            for s, v in enumerate(times, 1):
                done[s] = max(done[s], done[s - 1]) + v
            done[0] = 0.0
        assert rules.flow_shop(spark.createDataFrame(jobs, "instance_id int, pos int, t_1 double, t_2 double, t_3 double, t_4 double"), 4).first().makespan == done[4]


def test_paths_stop_on_a_cycle_that_improves(spark):
    e = spark.createDataFrame([(0, 1, 2, -1.0), (0, 2, 1, 0.5)], "instance_id int, src int, dst int, length double")
    with pytest.raises(ValueError):
        checks.path_values(e, spark.createDataFrame([(0, 1)], "instance_id int, node int"), rounds=4)


def test_unreadable_payloads_are_no_violations(spark):
    x = spark.createDataFrame([(1, '{"a1b2": 3}'), (2, "oops"), (3, None), (4, '{"m_3": 1.5}'), (5, "[]")], "id int, p string")
    got = {r.id: (r["index"], r.readable) for r in payloads.explode_index(x, "id", "p").collect()}
    assert got == {1: (None, False), 2: (None, False), 3: (None, False), 4: (3, True), 5: (None, False)}
    assert {r.id: r.k for r in x.select("id", payloads.detect_kind(F.col("p"), [("m", ["m_3"])]).alias("k")).collect()} == {1: None, 2: None, 3: None, 4: "m", 5: None}
    p = spark.createDataFrame([('{"B": 1, "a": null}',)], "p string")
    assert tuple(p.select(payloads.pick(F.col("p"), "b"), payloads.pick(F.col("p"), "x", "B"), payloads.pick(F.col("p"), "y")).first()) == ("1", "1", None)


@pytest.mark.parametrize("name", sorted(suites.SUITES))
def test_suites_are_made_of_rules(name):
    assert set(suites.SUITES[name].rules) <= set(audit.RULES)


def triple(spark):
    """A schedule that is right, one with an overlap and a wrong makespan, and one that cannot be read."""
    ops = [(1, 0, 0, 0, 0, 3), (1, 0, 1, 1, 3, 5), (1, 1, 0, 0, 3, 4), (2, 0, 0, 0, 0, 3), (2, 0, 1, 1, 2, 4), (2, 1, 0, 0, 2, 3)]
    o = spark.createDataFrame(ops, "instance_id int, job int, pos int, machine int, t_start int, t_end int")
    allowed = o.select("instance_id", "job", "pos", "machine", (F.col("t_end") - F.col("t_start")).alias("duration"))
    makespan = o.groupBy("instance_id").agg(F.max("t_end").cast("double").alias("value")).withColumn("field", F.lit("makespan"))
    return {"operations": o, "allowed": allowed, "jobs": o.select("instance_id", "job", F.lit(0).alias("release")).distinct(), "spans": o.select("instance_id", F.col("machine").alias("resource"), F.concat_ws("/", "job", "pos").alias("item"), "t_start", "t_end"), "recomputed": makespan, "declared": makespan.withColumn("value", F.when(F.col("instance_id") == 2, 9.0).otherwise(F.col("value")))}


def test_job_shop_suite(spark):
    instances = spark.createDataFrame([(1,), (2,)], "instance_id int")
    got = {r.instance_id: r for r in suites.run_suite("job_shop", triple(spark), instances, 6).collect()}
    assert got["1"].feasible and got["1"].verified and got["1"].partial_score == 1.0
    assert not got["2"].feasible and sorted(got["2"].messages) == ["declared:makespan", "operations:0/1", "overlap:1/0"] and got["2"].violation_count == 3 and got["2"].partial_score == 0.5
    lost = suites.run_suite("job_shop", {k: v for k, v in triple(spark).items() if k != "allowed"}, instances).collect()
    assert not any(r.verified for r in lost)


def test_an_unreadable_answer_touches_no_other_row(spark):
    instances = spark.createDataFrame([(1, 6), (2, 12), (3, 6)], "instance_id int, total int")
    read = spark.createDataFrame([(1, True), (2, True), (3, False)], "instance_id int, readable boolean")
    got = {r.instance_id: r for r in suites.run_suite("job_shop", triple(spark) | {"readable": read}, instances).collect()}
    assert [(r.feasible, r.verified, r.violation_count, r.partial_score) for _, r in sorted(got.items())] == [(True, True, 0, 1.0), (False, True, 3, 0.75), (True, False, 0, 1.0)]


def test_a_fault_inside_a_rule_is_not_hidden(spark, monkeypatch):
    def broken(t):
        return {}["no such key"]

    monkeypatch.setitem(audit.RULES, "overlap", broken)
    with pytest.raises(KeyError):
        suites.run_suite("job_shop", triple(spark), spark.createDataFrame([(1,)], "instance_id int"))


def test_prompts_and_demos(spark):
    p = spark.createDataFrame([(1, '{"x": [{"demos": [{"a": 1}, 2]}], "demos": [{"b": 2}]}'), (2, "no json"), (3, None)], "id int, p string")
    assert sorted((r.id, r.demo) for r in prompts.explode_demos(p, "id", "p").collect()) == [(1, '{"a":1}'), (1, '{"b":2}')]
    v = spark.createDataFrame([("infeasible", 0.0, 1.0, 2.0, None, ["x" * 2000]), ("exact_match", 1.5, 1.0, 2.0, None, None)], "status string, score double, cost double, reference_value double, error string, violations array<string>")
    a, b = (r.feedback for r in prompts.feedback_text(v, use_reference=False).collect())
    assert a.endswith("(cut)") and len(a) < 1300 and "reference" not in b and "1.0000" in b


def test_sources_without_tests_so_far(spark, tmp_path):
    (tmp_path / "prob_001.json").write_text('{"id": 1, "name": "n", "domain": "d", "instance": {"a": [1, 2]}, "reference_solution": {"objective_value": 3}}')
    got = files.read_problems(spark, str(tmp_path)).select("id", "file", F.to_json("instance").alias("i")).first()
    assert tuple(got) == (1, "prob_001.json", '{"a":[1,2]}')
    foreign = spark.createDataFrame([(1, 5.0, "{}"), (2, 6.0, "{}")], "id long, objective double, solution string")
    over = spark.createDataFrame([(2, 7.0, "wrong")], "id long, objective double, reason string")
    rows = files.import_records(foreign, 300, over).orderBy("id").collect()
    assert [(r.id, r.reference_solution.objective_value, r.audit and r.audit.reason) for r in rows] == [(301, 5.0, None), (302, 7.0, "wrong")]
    files.write_stats(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int"), f"{tmp_path}/stats", ["k"], ["v"])
    assert sorted(map(tuple, spark.read.json(f"{tmp_path}/stats").select("k", "n_rows", "v").collect())) == [("a", 2, 3), ("b", 1, 3)]
    r = spark.createDataFrame([(1, "n", None, None, None, "d", None, None, "{}", 3.5, ["f"])], "instance_id int, name string, domain string, math_type string, difficulty string, description string, objective string, constraints array<string>, instance string, reference_value double, fields array<string>")
    files.export_prompts(prompts.export_prompts(r), f"{tmp_path}/prompts")
    text = spark.read.json(f"{tmp_path}/prompts").first().prompt
    assert "## n" in text and "3.50" not in text and "Fields to return\nf" in text


def test_best_known_and_counts_as_streams(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1, 5.0, True, "a", 1.0), ("p", 2, 3.0, True, "a", 0.0), ("q", 3, 1.0, False, "b", 1.0), ("q", 4, 8.0, True, "b", 2.0)], "instance_id string, ts int, cost double, verified boolean, condition string, score double")
    rows.where("ts < 3").coalesce(1).write.parquet(f"{tmp_path}/in")
    rows.where("ts >= 3").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    feed = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for name, df in (("best", results.stream_best_known(feed())), ("counts", results.running_counts(feed()))):
        run = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        assert run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("best").collect())) == [("p", 3.0, 5.0), ("q", 8.0, 8.0)]
    assert sorted(map(tuple, spark.table("counts").collect())) == [("a", 2, 1.0, 1), ("b", 2, 3.0, 2)]


def test_entry_works_without_the_pipeline(monkeypatch):
    import importlib.util as util

    import __spark_entry__ as entry

    whole, own = set(entry.queries()), util.find_spec
    monkeypatch.setattr(util, "find_spec", lambda name, *a: None if name.startswith(("corpus_pipeline", "tallyloom.llm")) else own(name, *a))
    importlib.reload(entry)
    rest = set(entry.queries())
    monkeypatch.undo()
    importlib.reload(entry)
    assert "pipeline" not in rest and not any(n.startswith("op") and n[2].isdigit() for n in rest) and rest <= whole and set(entry.oracle_sql()) <= set(entry.queries())
    assert sys.modules["__spark_entry__"] is entry
