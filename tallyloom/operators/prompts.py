"""Prompts and feedback as columns: rendering of problem records, their export, demos of programs, texts about verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tables import Shelf

from .scoring import classify_error, error_score

DATA_CHARS, SHORT_CHARS, FEEDBACK_CHARS, SHOWN = 6000, 500, 1200, 6
CUT = " ... (cut; the whole data is there at run time)"


def cut_at(text: Column, n: int, mark: str = CUT) -> Column:
    """A text, cut at n characters with a mark."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def render_prompt(records: DataFrame, hide_reference: bool = False, compact: bool = False) -> DataFrame:
    """A column prompt of records (name, domain, math_type, difficulty, description, objective, constraints array, instance, reference_value, fields array).

    Parts that are null or empty are left out. Hidden references leave the value out and keep the names of the fields to return. Compact prompts cut the description and have no data.
    """
    part = lambda title, body: F.when(F.coalesce(F.length(body), F.lit(0)) > 0, F.concat(F.lit(f"## {title}\n"), body))
    head = F.concat(F.lit("## "), F.coalesce("name", F.lit("Unknown")), F.lit("\n"), F.concat_ws(" / ", F.coalesce("domain", F.lit("unknown")), F.coalesce("math_type", F.lit("unknown")), F.coalesce("difficulty", F.lit("N/A"))))
    rules = F.array_join(F.transform(F.coalesce("constraints", F.array().cast("array<string>")), lambda c: F.concat(F.lit("- "), c)), "\n")
    goal = F.concat_ws("\n", F.when(F.length("objective") > 0, F.concat(F.lit("Objective: "), F.col("objective"))), F.when(F.length(rules) > 0, rules))
    parts = [head, part("Description", cut_at(F.col("description"), SHORT_CHARS, " ...") if compact else F.col("description")), part("Requirements", goal)]
    if not compact:
        parts.append(part("Data", cut_at(F.col("instance"), DATA_CHARS)))
    if not hide_reference:
        parts.append(F.when(F.col("reference_value").isNotNull(), part("Reference value", F.format_string("%.2f", F.col("reference_value").cast("double")))))
    parts.append(part("Fields to return", F.array_join("fields", ", ")))
    return records.withColumn("prompt", F.concat_ws("\n\n", *parts))


def export_prompts(records: DataFrame, ids: DataFrame | None = None, hide_reference: bool = True) -> DataFrame:
    """(instance_id, prompt) of all records, or of those whose id is in ids."""
    own = records if ids is None else records.join(ids.select("instance_id").distinct(), "instance_id", "left_semi")
    return render_prompt(own, hide_reference).select("instance_id", "prompt")


def explode_demos(programs: DataFrame, key: str, program: str) -> DataFrame:
    """(key, demo): the objects in lists under any key demos of a program's JSON, at any depth; demo is JSON text. Demos inside of demos are demos too.

    Levels are taken one after the other, each written before the next, until none is left.
    """
    children = F.coalesce(F.map_values(F.try_variant_get("v", "$", "map<string,variant>")), F.try_variant_get("v", "$", "array<variant>"))
    held = F.coalesce(F.try_variant_get("v", "$.demos", "array<variant>"), F.array().cast("array<variant>"))
    nested = lambda x: F.schema_of_variant(x).rlike("^(OBJECT|ARRAY)")
    shelf, found = Shelf(programs.sparkSession, "demos"), []
    level = shelf.put(programs.select(key, F.try_parse_json(program).alias("v")).where(nested("v")), "level")
    while not level.isEmpty():
        demos = level.select(key, F.explode(held).alias("d")).where(F.schema_of_variant("d").startswith("OBJECT"))
        found.append(shelf.put(demos.select(key, F.to_json("d").alias("demo")), "found"))
        deeper = shelf.put(level.select(key, F.explode(children).alias("v")).where(nested("v")), "level")
        shelf.drop(level)
        level = deeper
    return reduce(DataFrame.union, found) if found else programs.select(key, F.lit(None).cast("string").alias("demo")).where(F.lit(False))


#: What a status asks for.
ACTIONS = {
    "infeasible": "See to capacities, time windows, order and coverage, and that each item is there once.", "partial_feasible": "Most constraints hold: check the one that fails before each step.",
    "suspicious_zero": "The cost is far below what is known, so the solution may be empty: assign every job or customer.", "invalid_solution": "Fill the assignment for every job, customer or activity, under the names that are asked for.",
    "solver_failure": "Use a greedy method in the solver's place.", "first_valid": "It is the first valid solution, from which to improve.", "exact_match": "It equals the reference.", "beat_reference": "It is better than the reference; go on below the best that is known.",
    "new_best": "It is better than all before; search deeper.", "improved": "More rounds, another heuristic or a tuned solver may help.", "similar": "It is as good as the best before.", "worse": "Try another method, such as local search after a greedy one, or give a solver more time and a start.",
}


def details(rows: DataFrame, use_reference: bool) -> Column:
    """What is to be done, how far the best known and the reference are, bonuses, hints and fields of the instance; each as far as the rows have it."""
    has = lambda c: c in rows.columns
    action = F.coalesce(*[F.when(F.col("status") == k, v) for k, v in ACTIONS.items()])
    parts = [action]
    percent = lambda c: F.format_string("%+.1f %%", F.col(c).cast("double") * 100)
    if has("gap_to_best"):
        parts.append(F.when(F.col("gap_to_best").isNotNull(), F.concat(F.lit("Against the best before: "), percent("gap_to_best"), F.lit("."))))
    if has("best_before"):
        parts.append(F.when(F.col("best_before").isNotNull(), F.format_string("The best before is %.4f.", F.col("best_before").cast("double"))))
    if has("gap_to_reference") and use_reference:
        parts.append(F.when(F.col("gap_to_reference").isNotNull(), F.concat(F.lit("Against the reference: "), percent("gap_to_reference"), F.lit("."))))
    if has("bonuses"):
        given = F.filter(F.map_entries("bonuses"), lambda e: e["value"] > 0)
        parts.append(F.when(F.size(given) > 0, F.concat(F.lit("Bonuses: "), F.array_join(F.array_sort(F.transform(given, lambda e: F.format_string("%s +%.2f", e["key"], e["value"].cast("double")))), ", "), F.lit("."))))
    if has("hint"):
        parts.append(F.when(~F.col("status").isin("exact_match", "beat_reference", "new_best", "improved", "first_valid"), F.concat(F.lit("Hint: "), F.col("hint"))))
    if has("keys"):
        lost = F.col("status").isin("suspicious_zero", "invalid_solution") | classify_error(F.col("error")).isin("keyerror", "attribute")
        parts.append(F.when(lost & (F.size("keys") > 0), F.concat(F.lit("Fields of the instance: "), F.array_join("keys", ", "), F.lit("."))))
    return F.concat_ws(" ", *parts)


def feedback_text(rows: DataFrame, use_reference: bool = True, detailed: bool = False) -> DataFrame:
    """A column feedback for each verdict (status, score, cost, reference_value, error, violations array), FEEDBACK_CHARS long at most. Without references none is named.

    Detailed texts say what the status asks for, and the gaps (gap_to_best, best_before, gap_to_reference), bonuses (a map), hint and keys (an array) that the rows have.
    """
    kind = classify_error(F.col("error"))
    _, _, fix = error_score(kind)
    shown = F.slice(F.coalesce("violations", F.array().cast("array<string>")), 1, SHOWN)
    listed = F.array_join(F.transform(shown, lambda x: F.concat(F.lit("- "), x)), "\n")
    more = F.when(F.size("violations") > SHOWN, F.concat(F.lit("\nand "), (F.size("violations") - SHOWN).cast("string"), F.lit(" more"))).otherwise("")
    points = F.format_string("Score %.2f.", F.col("score").cast("double"))
    against = F.when(F.col("reference_value").isNotNull(), F.format_string(" The cost is %.4f, the reference %.2f.", F.col("cost").cast("double"), F.col("reference_value").cast("double"))) if use_reference else F.lit(None).cast("string")
    own = F.coalesce(against, F.when(F.col("cost").isNotNull(), F.format_string(" The cost is %.4f.", F.col("cost").cast("double"))), F.lit(""))
    text = (
        F.when(F.col("status") == "exec_error", F.concat(F.lit("The code failed ("), kind, F.lit("): "), F.coalesce("error", F.lit("")), F.lit(". To mend it: "), fix, F.lit(".")))
        .when(F.col("status").isin("infeasible", "partial_feasible"), F.concat(F.lit("Constraints are violated:\n"), listed, more))
        .when(F.col("status") == "invalid_solution", F.lit("The solution is empty or has not the fields that are asked for."))
        .when(F.col("status") == "solver_failure", F.lit("The solver found no solution; use a simpler method or a time limit."))
        .when(F.col("status") == "unverified", F.concat(F.lit("The solution's form could not be checked."), own))
        .when(F.col("status").isin("exact_match", "beat_reference", "new_best", "improved"), F.concat(F.lit("Better than or as good as before."), own))
        .otherwise(F.concat(F.lit("Feasible, with room to improve."), own))
    )
    return rows.withColumn("feedback", cut_at(F.trim(F.concat_ws(" ", text, *([F.nullif(details(rows, use_reference), F.lit(""))] if detailed else []), points)), FEEDBACK_CHARS, " (cut)"))
