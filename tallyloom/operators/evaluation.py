"""Evaluation analytics: aggregates by condition and subset, effects, ranks, paired comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import classify_error

from .scoring import AT_LEAST_REFERENCE, beat_flags, gap, is_correct


def aggregate_results(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means, valid counts and rates, and a status map of result rows (score, status)."""
    status = rows.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.count_if(F.col("score") > 0).alias("v"))
    return status.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), (F.sum("s") / F.sum("n")).alias("mean_score"), F.sum("v").alias("n_valid"), (F.sum("v") / F.sum("n")).alias("valid_rate"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "status", F.col("n").cast("string")))), ",").alias("status_counts"),
    )


def reference_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose status is at least the reference's, rows that the costs say are at least as good, and strictly better ones; statuses as a map."""
    least, strict = beat_flags(F.col("cost"), F.col("reference_value"), F.col("status"))
    own = rows.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"), F.count_if(least).alias("a"), F.count_if(strict).alias("s"))
    return own.groupBy(*keys).agg(F.sum(F.when(F.col("status").isin(*AT_LEAST_REFERENCE), F.col("n")).otherwise(0)).alias("n_reference"), F.sum("a").alias("n_analysis"), F.sum("s").alias("n_strict"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses"))


def result_ids(rows: DataFrame, keys: list[str], key: str = "instance_id") -> DataFrame:
    """(*keys, instance_id): which results each condition has, a row for each rather than a list that grows."""
    return rows.select(*keys, key).distinct()


def evaluate_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means over all and over valid rows, least and greatest score, parse and execution errors, and classes of error, of rows (score, status, parse_error, error)."""
    from .scoring import classify_error

    kind = F.when(F.col("status") == "exec_error", classify_error(F.col("error")))
    own = rows.withColumn("_kind", kind).groupBy(*keys, "status", "_kind").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.sum(F.when(F.col("score") > 0, F.col("score"))).alias("vs"), F.count_if(F.col("score") > 0).alias("v"), F.count_if("parse_error").alias("p"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    classes = F.array_join(F.array_sort(F.collect_list(F.when(F.col("_kind").isNotNull(), F.concat_ws("=", "_kind", F.col("n").cast("string"))))), ",")
    return own.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), (F.sum("s") / F.sum("n")).alias("mean_all"), F.try_divide(F.sum("vs"), F.sum("v")).alias("mean_valid"), F.sum("v").alias("n_valid"), F.sum("p").alias("n_parse_errors"),
        F.sum(F.when(F.col("status") == "exec_error", F.col("n")).otherwise(0)).alias("n_exec_errors"), F.min("lo").alias("min_score"), F.max("hi").alias("max_score"), classes.alias("error_classes"),
    )


def summarize_run(rows: DataFrame, keys: list[str], max_gap: float) -> DataFrame:
    """Problems, correct ones, those at least as good as the reference by status, feasible ones (with a gap), and means, of rows (status, score, cost, reference_value, output_tokens). Rows without tokens do not count in their mean, which is 0 without any."""
    cost, reference, status = F.col("cost"), F.col("reference_value"), F.col("status")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_problems"), F.count_if(is_correct(cost, reference, max_gap, status)).alias("n_correct"), F.count_if(status.isin(*AT_LEAST_REFERENCE)).alias("n_at_least_reference"),
        F.count(gap(cost, reference, status)).alias("n_feasible"), F.avg("score").alias("mean_score"), F.coalesce(F.avg("output_tokens"), F.lit(0.0)).alias("mean_tokens"),
    )


def threshold_table(rows: DataFrame, keys: list[str], gaps: list[float]) -> DataFrame:
    """Numbers of correct rows at several gap limits, in one pass."""
    return rows.groupBy(*keys).agg(*[F.count_if(is_correct(F.col("cost"), F.col("reference_value"), g, F.col("status"))).alias(f"correct_{round(100 * g)}") for g in gaps])


def factorial_effects(means: DataFrame, key: str) -> DataFrame:
    """Prompt effect of each model, model effect of each prompt, and interaction, from means (key, model a/b, prompt 0/1, mean)."""
    p = means.groupBy(key).pivot("cell", ["a0", "a1", "b0", "b1"]).agg(F.first("mean"))
    return p.select(key, (F.col("a1") - F.col("a0")).alias("prompt_effect_a"), (F.col("b1") - F.col("b0")).alias("prompt_effect_b"), (F.col("b0") - F.col("a0")).alias("model_effect_0"), (F.col("b1") - F.col("a1")).alias("model_effect_1"), ((F.col("b1") - F.col("b0")) - (F.col("a1") - F.col("a0"))).alias("interaction"))


def rank_models(means: DataFrame, score: str, label: str) -> DataFrame:
    """Competition ranks: ties share one; place orders ties by label. means has a row for each model."""
    return means.withColumns({"rank": F.rank().over(Window.orderBy(F.col(score).desc())), "place": F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(label)))})


def paired_outcomes(base: DataFrame, run: DataFrame, keys: list[str]) -> DataFrame:
    """On shared keys: both correct, only the base, only the other, neither. Both: (*keys, correct)."""
    both = base.select(*keys, F.col("correct").alias("x")).join(run.select(*keys, F.col("correct").alias("y")), keys)
    return both.groupBy().agg(F.count(F.lit(1)).alias("n_shared"), F.count_if(F.col("x") & F.col("y")).alias("both"), F.count_if(F.col("x") & ~F.col("y")).alias("base_only"), F.count_if(~F.col("x") & F.col("y")).alias("other_only"), F.count_if(~F.col("x") & ~F.col("y")).alias("neither"))


def best_of_n(rows: DataFrame, key: str, cost: str, source: str) -> DataFrame:
    """Per instance the source of the least feasible cost, its cost, and the numbers tried and feasible."""
    ok = F.when(F.col("feasible"), F.struct(F.col(cost), F.col(source)))
    return rows.groupBy(key).agg(F.min(ok).alias("b"), F.count(F.lit(1)).alias("n_tried"), F.count_if("feasible").alias("n_feasible")).select(key, F.col(f"b.{source}").alias("best_source"), F.col(f"b.{cost}").alias("best_cost"), "n_tried", "n_feasible")


def reject_table(rows: DataFrame, key: str, reason: str) -> DataFrame:
    """(key, n_tried, reasons) of instances without any feasible row: how often each reason was given. rows: (key, feasible, reason)."""
    own = rows.groupBy(key, reason).agg(F.count(F.lit(1)).alias("n"), F.count_if("feasible").alias("ok"))
    said = F.when(F.col(reason).isNotNull(), F.concat_ws("=", reason, F.col("n").cast("string")))
    return own.groupBy(key).agg(F.sum("ok").alias("ok"), F.sum("n").alias("n_tried"), F.array_join(F.array_sort(F.collect_list(said)), ",").alias("reasons")).where("ok = 0").drop("ok")


def feasible_costs(rows: DataFrame, key: str, cost: str, source: str) -> DataFrame:
    """(key, source, cost): the least feasible cost of each source, a row each."""
    return rows.where("feasible").groupBy(key, source).agg(F.min(cost).alias(cost))


def agent_rates(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of runs (repaired, fallback, first_ok) that were repaired, fell back, and were right at first."""
    share = lambda c: (F.count_if(c) / F.count(F.lit(1))).alias(f"{c}_rate")
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_runs"), share("repaired"), share("fallback"), share("first_ok"))


def attempts_summary(attempts: DataFrame, key: str) -> DataFrame:
    """First and last attempt, and whether a failed first one was repaired. attempts: (key, attempt, ok, kind)."""
    x = attempts.groupBy(key).agg(F.min_by(F.struct("ok", "kind"), "attempt").alias("f"), F.max_by(F.struct("ok", "kind"), "attempt").alias("l"), F.count(F.lit(1)).alias("n_attempts"))
    return x.select(key, F.col("f.ok").alias("first_ok"), F.col("f.kind").alias("first_kind"), F.col("l.ok").alias("last_ok"), F.col("l.kind").alias("last_kind"), (~F.col("f.ok") & F.col("l.ok")).alias("repaired"), "n_attempts")


def revision_outcome(rows: DataFrame, key: str) -> DataFrame:
    """Per iteration after the first: rows, better ones, the mean of the better of it and the one before, and valid ones (kept score above 0). rows: (key, iteration, score)."""
    before = F.lag("score").over(Window.partitionBy(key).orderBy("iteration"))
    kept = F.greatest("score", "old")
    x = rows.withColumn("old", before).where("old IS NOT NULL")
    return x.groupBy("iteration").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("score") > F.col("old")).alias("n_better"), F.avg(kept).alias("mean_kept"), F.count_if(kept > 0).alias("n_valid"))


def revision_errors(rows: DataFrame, key: str) -> DataFrame:
    """(iteration, error_class, n): the classes of the errors of each iteration, and of those the fixed ones: rows whose next iteration has none. rows: (key, iteration, error), error null where there is none."""
    after = F.lead(F.struct("error")).over(Window.partitionBy(key).orderBy("iteration"))
    x = rows.withColumn("_after", after).where("error IS NOT NULL").withColumn("error_class", classify_error(F.col("error")))
    return x.groupBy("iteration", "error_class").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_after").isNotNull() & F.col("_after.error").isNull()).alias("n_fixed"))


def schema_audit(df: DataFrame, required: list[str], key: str, numeric: Column | None = None) -> DataFrame:
    """Rows without each required field, rows whose objective is a number, and whether keys are unique."""
    number = F.count_if(F.coalesce(numeric.isNotNull(), F.lit(False))) if numeric is not None else F.lit(None).cast("long")
    return df.groupBy().agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in required], number.alias("n_numeric"), (F.countDistinct(key) == F.count(F.lit(1))).alias("unique_keys"))


def funnel(rows: DataFrame, keys: list[str], stages: dict[str, Column]) -> DataFrame:
    """Rows at the start and after each of the stages, which are conditions that rows must meet one after the other."""
    so_far, counts = F.lit(True), []
    for name, condition in stages.items():
        so_far = so_far & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(so_far).alias(f"after_{name}"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_start"), *counts)
