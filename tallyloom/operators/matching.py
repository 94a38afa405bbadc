"""Joins, subsets and comparisons of runs: results with problems, deltas, exposure groups, merged and rescored runs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.tables import ranked

from .datasets import dedup_keep_first
from .scoring import paired_bootstrap


def join_problems(results: DataFrame, problems: DataFrame) -> DataFrame:
    """Results with the columns of their problem; rescored is false where the problem or the code is missing."""
    known = problems.withColumn("_known", F.lit(True))
    x = results.join(known, "instance_id", "left")
    return x.withColumn("rescored", F.coalesce("_known", F.lit(False)) & F.col("code").isNotNull()).drop("_known")


def map_template(shipped: DataFrame, generated: DataFrame) -> DataFrame:
    """(instance_id, template_id): shipped ids are their own templates, generated ones name theirs."""
    return shipped.select("instance_id", F.col("instance_id").alias("template_id")).unionByName(generated.select("instance_id", "template_id"))


def paired_deltas(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """after - before on shared keys; null scores have no delta."""
    x = before.select(*keys, F.col("score").alias("_b")).join(after.select(*keys, F.col("score").alias("_a")), keys)
    return x.select(*keys, (F.col("_a") - F.col("_b")).alias("delta")).where("delta IS NOT NULL")


def only_kinds(results: DataFrame, problems: DataFrame, kinds: list[str]) -> DataFrame:
    """Results of problems of the listed kinds."""
    return results.join(problems.where(F.col("kind").isin(*kinds)).select("instance_id"), "instance_id", "left_semi")


def exclude_templated(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """Rows whose instance is no template."""
    return rows.join(templates.select(F.col("template_id").alias("instance_id")), "instance_id", "left_anti")


def contains_join(texts: DataFrame, names: DataFrame, block: int = 8 << 20) -> DataFrame:
    """(text_id, name) of names that are found in a text, at any place. An empty or missing name is found nowhere, and a name that is listed twice once.

    Names are taken in blocks of about block characters, one automaton each, that is sent to all tasks and finds all of its names in one pass over a
    text. So nothing is shuffled but the names, and rows are made for hits only. text_id passes as it is.
    """
    own = names.where("name <> ''").select("name").distinct()
    size = own.agg(F.sum(F.length("name") + 16)).first()[0]
    if not size:
        return texts.select("text_id", F.lit("").alias("name")).where(F.lit(False))
    blocks = -(-size // block)
    kind = texts.schema["text_id"].dataType.simpleString()

    def finder(block_names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = ahocorasick.Automaton()
            for name in block_names:
                tree.add_word(name, name)
            tree.make_automaton()
            for batch in batches:
                at, found = [], []
                for i, text in enumerate(batch.column(1)):
                    hits = sorted({name for _, name in tree.iter(text.as_py() or "")})
                    at += [i] * len(hits)
                    found += hits
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["text_id", "name"])

        return texts.select("text_id", "text").mapInArrow(run, f"text_id {kind}, name string")

    parts = (own.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k).collect() for k in range(blocks))  # one block each
    return reduce(DataFrame.union, [finder([r.name for r in rows]) for rows in parts if rows])


def cost_mismatches(old: DataFrame, new: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Keys whose costs, both present, differ by more than the tolerance."""
    x = old.select(*keys, F.col("cost").alias("old_cost")).join(new.select(*keys, F.col("cost").alias("new_cost")), keys)
    return x.where(F.abs(F.col("old_cost") - F.col("new_cost")) > tolerance)


def keep_verified(answers: DataFrame, verdicts: DataFrame, ok: list[str]) -> DataFrame:
    """Answers whose verdict (condition, instance_id, status) is one of ok, with the status; of several verdicts the first of ok counts, and each answer is there once."""
    place = F.array_position(F.array(*map(F.lit, ok)), F.col("status"))
    good = verdicts.where(F.col("status").isin(*ok)).groupBy("condition", "instance_id").agg(F.min_by("status", place).alias("status"))
    return answers.join(good, ["condition", "instance_id"])


def append_candidates(first: DataFrame, extra: DataFrame, keys: list[str], text: str, order: list[str]) -> DataFrame:
    """first, then the rows of extra whose trimmed text its group does not have yet; of equal texts the earliest by order is kept."""
    both = first.withColumn("_late", F.lit(0)).unionByName(extra.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    return dedup_keep_first(both, keys, text, ["_late", *order]).drop("_late")


def exposure_groups(groups: dict[str, DataFrame], demos: DataFrame) -> DataFrame:
    """(grp, instance_id, in_demos) of named groups of ids, which may overlap; demos: (instance_id)."""
    named = reduce(DataFrame.union, [g.select(F.lit(n).alias("grp"), "instance_id").distinct() for n, g in groups.items()])
    known = demos.select("instance_id", F.lit(True).alias("_d")).distinct()
    return named.join(known, "instance_id", "left").select("grp", "instance_id", F.coalesce("_d", F.lit(False)).alias("in_demos"))


def build_stats(instances: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: instances, pairs checked, pairs kept, instances that a kept pair covers, and verdicts by status. pairs: (instance_id, status, kept)."""
    by_status = pairs.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("k"))
    sums = by_status.agg(F.sum("n").alias("n_pairs"), F.sum("k").alias("n_kept"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "status", F.col("n").cast("string")))), ",").alias("verdicts"))
    covered = pairs.where("kept").agg(F.countDistinct("instance_id").alias("n_covered"))
    one = instances.agg(F.count(F.lit(1)).alias("n_instances"))
    return one.join(sums, F.lit(True)).join(covered, F.lit(True))  # three tables of one row


def with_subsets(rows: DataFrame, subsets: DataFrame) -> DataFrame:
    """A row for each subset that has the row's instance. subsets: (subset, ids)."""
    member = subsets.select("subset", F.explode("ids").alias("instance_id")).distinct()
    return rows.join(member, "instance_id")


def subset_names(rows: DataFrame, group: str) -> DataFrame:
    """(subset, instance_id): each group by name, and everything as all."""
    return rows.select(F.explode(F.array(F.col(group).cast("string"), F.lit("all"))).alias("subset"), "instance_id").where("subset IS NOT NULL")


def rescore_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means and numbers of changed rows before and after rescoring. rows: (score, status, old_score, old_status)."""
    moved = ~F.col("status").eqNullSafe(F.col("old_status"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("old_score").alias("old_mean"), F.avg("score").alias("new_mean"), F.count_if(moved).alias("n_status_changed"), F.count_if(F.col("score") > F.col("old_score")).alias("n_up"), F.count_if(F.col("score") < F.col("old_score")).alias("n_down"))


def status_changes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, status, n_before, n_after): how many rows have each status before and after rescoring. rows: (status, old_status)."""
    both = rows.select(*keys, F.explode(F.array(F.struct(F.col("old_status").alias("status"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct("status", F.lit(0).alias("b"), F.lit(1).alias("a")))).alias("x"))
    return both.groupBy(*keys, F.col("x.status").alias("status")).agg(F.sum("x.b").alias("n_before"), F.sum("x.a").alias("n_after"))


def align_declared(values: DataFrame, found: DataFrame) -> DataFrame:
    """(instance_id, declared, aligned): the recomputed value where every violation of the instance is a wrong declared value."""
    only = found.groupBy("instance_id").agg(F.bool_and(F.col("rule") == "declared").alias("_only"))
    x = values.join(only, "instance_id", "left")
    return x.select("instance_id", F.when(F.coalesce("_only", F.lit(False)), F.col("recomputed")).otherwise(F.col("declared")).alias("declared"), F.coalesce("_only", F.lit(False)).alias("aligned"))


def merge_runs(runs: list[DataFrame], fixed: list[str], expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The union of partial runs (condition, instance_id, ...), and its problems: fields that differ, repeated and missing pairs."""
    if len(runs) < 2:
        raise ValueError("a merge needs two runs at least")
    union = reduce(DataFrame.unionByName, runs)
    odd = union.groupBy().agg(*[F.countDistinct(c).alias(c) for c in fixed])
    differ = odd.select(F.explode(F.array(*[F.when(F.col(c) > 1, F.lit(c)) for c in fixed])).alias("key")).where("key IS NOT NULL").select(F.lit("differs").alias("problem"), "key") if fixed else None
    pair = F.concat_ws("/", "condition", F.col("instance_id").cast("string")).alias("key")
    repeated = union.groupBy("condition", "instance_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated").alias("problem"), pair)
    missing = expected.join(union, ["condition", "instance_id"], "left_anti").select(F.lit("missing").alias("problem"), pair)
    return union, reduce(DataFrame.union, [d for d in (differ, repeated, missing) if d is not None])


def composition(rows: DataFrame, merged: str = "") -> DataFrame:
    """(level, name, n) of rows (kind, source, origin): counts by kind, by source/origin, and by source after the merge, which is the source, or merged where a row has more than one (a text joined by +). Nulls are unknown."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    after = F.when(F.contains(part("source"), F.lit("+")), merged).otherwise(part("source")) if merged else part("source")
    one = lambda level, name: F.struct(F.lit(level).alias("level"), name.alias("name"))
    named = F.explode(F.array(one("kind", part("kind")), one("source/origin", F.concat_ws("/", part("source"), part("origin"))), one("merged", after)))
    return rows.select(named.alias("x")).groupBy("x.level", "x.name").agg(F.count(F.lit(1)).alias("n"))


def distribution(rows: DataFrame, keys: list[str], split: str, splits: list[str]) -> DataFrame:
    """Rows by keys, with a column for each split; totals have null keys."""
    return rows.rollup(*keys).agg(*[F.count_if(F.col(split) == s).alias(f"n_{s}") for s in splits])


def teacher_coverage(rows: DataFrame, source: str) -> DataFrame:
    """By source: instances tried, instances with a feasible row, and instances where it has the least feasible cost."""
    own = rows.groupBy("instance_id", source).agg(F.max("feasible").alias("ok"), F.min(F.when(F.col("feasible"), F.col("cost"))).alias("c"))
    least = F.min("c").over(Window.partitionBy("instance_id"))
    return own.withColumn("best", F.col("c") == least).groupBy(source).agg(F.count(F.lit(1)).alias("n_tried"), F.count_if("ok").alias("n_feasible"), F.count_if("best").alias("n_best"))


def first_n_per_kind(rows: DataFrame, limits: dict[str, int], key: str, default: int = 0) -> DataFrame:
    """The first rows of each kind (core_type where null) by key; a limit of 0 keeps all.

    Rows of kinds without a limit are not ranked. Of the others, each task keeps as many of a kind as the largest limit before they meet.
    """
    kind = F.coalesce("kind", "core_type")
    limit = F.coalesce(F.create_map(*[F.lit(v) for kv in limits.items() for v in kv])[kind], F.lit(default)) if limits else F.lit(default)
    most = max([*limits.values(), default])
    if not most:
        return rows
    ranked_rows = rows.where(limit > 0).withColumn("_k", F.row_number().over(Window.partitionBy(kind).orderBy(key))).where(F.col("_k") <= most)
    return rows.where(limit == 0).unionByName(ranked_rows.where(F.col("_k") <= limit).drop("_k"))


def with_sizes(rows: DataFrame, group: str, *more: Column) -> DataFrame:
    """rows with _n, the number of rows of their group, and more aggregates; groups are a small table beside the rows."""
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"), *more)
    return rows.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def tail_split(rows: DataFrame, group: str, key: str) -> DataFrame:
    """A column in_tail: the last max(3, n // 3) rows of each group by key."""
    x = with_sizes(ranked(rows, [group], [key], "_k"), group)
    return x.withColumn("in_tail", F.col("_n") - F.col("_k") <= F.greatest(F.lit(3), F.floor(F.col("_n") / 3))).drop("_k", "_n")


def split_or_ratio(rows: DataFrame, group: str, key: str, ratio: float) -> DataFrame:
    """A column part: the own split where a group has both train and test, else train for the first int(n * ratio) rows by key."""
    has = lambda part: F.max((F.col("split") == part).cast("int")).alias(f"_{part}")
    x = with_sizes(ranked(rows, [group], [key], "_k"), group, has("train"), has("test"))
    both = F.coalesce(F.col("_train") + F.col("_test") == 2, F.lit(False))
    part = F.when(both, F.col("split")).otherwise(F.when(F.col("_k") < F.floor(F.col("_n") * ratio), "train").otherwise("test"))
    return x.withColumn("part", part).drop("_k", "_n", "_train", "_test")


def seeded_shuffle(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Rows in an order that the seed and the keys fix."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)


def untouched(everything: DataFrame, *used: DataFrame, key: str = "instance_id") -> DataFrame:
    """Rows whose key is in none of the used tables."""
    return everything.join(reduce(DataFrame.union, [u.select(key) for u in used]), key, "left_anti")


def collect_answers(files: DataFrame, shards: DataFrame, known: DataFrame) -> DataFrame:
    """Answers of both sources for known instances."""
    return files.unionByName(shards, allowMissingColumns=True).join(known.select("instance_id"), "instance_id", "left_semi")


def diagnose_effects(deltas: DataFrame, groups: DataFrame, rounds: int, seed: int) -> DataFrame:
    """(grp, mean, lo, hi, significant, mean_without_demos): the bootstrap of each exposure group, and its mean without demos (null if none are left).

    deltas (instance_id, delta); groups (grp, instance_id) may overlap, and may have in_demos.
    """
    own = groups if "in_demos" in groups.columns else groups.withColumn("in_demos", F.lit(False))
    x = deltas.join(own.select("grp", "instance_id", "in_demos").distinct(), "instance_id")
    out = paired_bootstrap(ranked(x, ["grp"], ["instance_id"], "k").select("grp", "k", "delta"), rounds, seed)
    rest = x.groupBy("grp").agg(F.avg(F.when(~F.col("in_demos"), F.col("delta"))).alias("mean_without_demos"))
    return out.withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0)).join(rest, "grp")
