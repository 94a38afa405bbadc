"""Sources and sinks: problem records, chat rows, evaluation shards, rescored reports, answers, best-known costs, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROBLEM = "id long, name string, domain string, math_type string, difficulty string, split string, description string, requirements struct<objective: string, constraints: array<string>>, instance variant, reference_solution variant, provenance struct<generator: string, version: string, template_id: string, kind: string, base_id: long, seed: long>"
CHAT = "messages array<struct<role: string, content: string, trainable: boolean>>, tools string, instance_id string, template_id string, kind string, source string, origin string, written_for string, gap double"
#: The fields of a result, inside a struct.
RESULT = "instance_id: string, name: string, core_type: string, status: string, score: double, cost: double, reference_value: double, detail: string, error_category: string, feasibility_verified: boolean, code: string, usage: struct<completion_tokens: long>, elapsed: double, beat_reference_analysis: boolean"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or a pattern matches a file, by the file system that Spark uses for it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_problems(spark: SparkSession, path: str) -> DataFrame:
    """The problem records prob_*.json of a folder, one for each file, with the file's name."""
    return spark.read.schema(PROBLEM).option("multiLine", True).json(f"{path}/prob_*.json").withColumn("file", F.col("_metadata.file_name"))


def read_sft(spark: SparkSession, path: str, splits: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    """Chat rows of <split>.jsonl with a column split. A missing split is an error that names the files; blank lines are no rows."""
    files = {s: f"{path}/{s}.jsonl" for s in splits}
    missing = [f for f in files.values() if not exists(spark, f)]
    if missing:
        raise FileNotFoundError("missing splits: " + ", ".join(missing))
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1)
    return spark.read.schema(CHAT).json(list(files.values())).where("messages IS NOT NULL").withColumn("split", name)


def condition_of(path: Column) -> Column:
    """The folder of a shard file, without what follows __shard."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -2), "__shard.*$", "")


def read_eval_shards(spark: SparkSession, runs: list[str]) -> DataFrame:
    """The rows of test.results of <run>/<condition>__shardNNofMM/<file>.json, with their condition."""
    shards = spark.read.schema(f"test struct<results: array<struct<{RESULT}>>>").option("multiLine", True).json([f"{r}/*/*.json" for r in runs])
    return shards.select(condition_of(F.col("_metadata.file_path")).alias("condition"), F.explode("test.results").alias("r")).select("condition", "r.*")


def read_rescored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a report's map records from condition to rows."""
    report = spark.read.schema(f"records map<string, array<struct<{RESULT}, old_score: double, old_status: string>>>").option("multiLine", True).json(path)
    return report.select(F.explode("records").alias("condition", "rows")).select("condition", F.explode("rows").alias("r")).select("condition", "r.*")


def read_answers(spark: SparkSession, path: str, problems: DataFrame) -> DataFrame:
    """A row for each problem (instance_id): its answer, from the text file of that name, or status gen_error with a score of -0.5."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    answers = spark.read.text(path, wholetext=True).select(name.alias("instance_id"), F.col("value").alias("answer"))
    lost = F.col("answer").isNull()
    return problems.select("instance_id").join(answers, "instance_id", "left").select("instance_id", "answer", F.when(lost, "gen_error").alias("status"), F.when(lost, -0.5).alias("score"))


def load_best_known(spark: SparkSession, path: str) -> DataFrame:
    """(instance_id, best_cost): the least cost of each instance in the JSON lines."""
    return spark.read.schema("instance_id string, best_cost double").json(path).groupBy("instance_id").agg(F.min("best_cost").alias("best_cost"))


def save_best_known(best: DataFrame, path: str) -> None:
    """Writes JSON lines, sorted by instance over all files; an older registry at the path is replaced."""
    best.select("instance_id", "best_cost").orderBy("instance_id").write.mode("overwrite").json(path)


def import_records(records: DataFrame, offset: int, overrides: DataFrame) -> DataFrame:
    """Foreign records (id, objective, solution as JSON) under new ids. overrides (id, objective, reason) replace objectives; a column audit tells so."""
    o = overrides.select("id", F.col("objective").alias("_to"), F.col("reason").alias("_why"))
    x = records.join(o, "id", "left")
    value = F.coalesce("_to", "objective")
    audit = F.when(F.col("_to").isNotNull(), F.struct(F.col("objective").alias("was"), F.col("_to").alias("now"), F.col("_why").alias("reason")))
    return x.select((F.col("id") + offset).alias("id"), F.col("id").alias("foreign_id"), F.struct(value.alias("objective_value"), F.col("solution")).alias("reference_solution"), audit.alias("audit"))


def write_guarded(df: DataFrame, path: str, force: bool = False, form: str = "parquet") -> None:
    """Writes df; a target that exists is an error unless forced."""
    df.write.mode("overwrite" if force else "errorifexists").format(form).save(path)


def write_splits(df: DataFrame, path: str, order: list[str], force: bool = False, files: int = 32) -> None:
    """JSON lines in split=<name> folders. A split is spread over range-sorted files, so that one hot split is not one task."""
    ranged = df.repartitionByRange(files, "split", *order).sortWithinPartitions("split", *order)
    ranged.write.mode("overwrite" if force else "errorifexists").partitionBy("split").json(path)


def write_stats(rows: DataFrame, path: str, keys: list[str], sums: list[str] | None = None) -> None:
    """Counts of rows (and sums of columns) by keys, as one file of JSON lines."""
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).alias(c) for c in sums or []])
    stats.orderBy(*keys).coalesce(1).write.mode("overwrite").json(path)


def export_prompts(prompts: DataFrame, path: str, ids: DataFrame | None = None) -> None:
    """Prompts (instance_id, prompt) as JSON lines; only those of ids, if given."""
    own = prompts.join(ids.select("instance_id"), "instance_id", "left_semi") if ids is not None else prompts
    own.select("instance_id", "prompt").write.mode("errorifexists").json(path)
