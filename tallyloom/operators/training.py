"""Training-row preparation: supervised spans, labels, validity, counts, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.tables import ranked

MASKED = -100


def n_tokens(text: Column) -> Column:
    """Tokens of a text by the rule of this engine: runs between single blanks, none for a null or empty text."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(text, " ")))


def supervised_spans(turns: DataFrame, trainable: Column | None = None) -> DataFrame:
    """Each turn's token span in its conversation, and whether it is supervised: an assistant's, not marked as untrainable."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    sized = turns.withColumn("n_tokens", n_tokens(F.col("text")).cast("long"))
    end = F.sum("n_tokens").over(before)
    marked = F.coalesce(trainable, F.lit(True)) if trainable is not None else F.lit(True)
    return sized.select("conv_id", "turn", "role", "n_tokens", (end - F.col("n_tokens")).alias("span_start"), end.alias("span_end"), ((F.col("role") == "assistant") & marked).alias("supervised"))


def label_arrays(turns: DataFrame) -> DataFrame:
    """input_ids and labels of each conversation: a label is its token where supervised, MASKED elsewhere. One conversation is one row."""
    tokens = F.when(F.coalesce("text", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("text", " "))
    ids = F.transform(tokens, lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long") % 50_000 + 1).cast("int"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", ids.alias("ids"), (F.col("role") == "assistant").alias("on")))).alias("t"))
    labels = F.transform("t", lambda x: F.when(x["on"], x["ids"]).otherwise(F.transform(x["ids"], lambda _: F.lit(MASKED))))
    return rows.select("conv_id", F.flatten(F.transform("t", lambda x: x["ids"])).alias("input_ids"), F.flatten(labels).alias("labels"))


def validate_rows(spans: DataFrame, max_length: int) -> DataFrame:
    """valid and invalid_reason of each conversation; one that is over the limit is dropped whole."""
    sums = spans.groupBy("conv_id").agg(F.sum("n_tokens").alias("length"), F.sum(F.when(F.col("supervised"), F.col("n_tokens")).otherwise(0)).alias("n_supervised"))
    reason = F.when(F.col("length") > max_length, F.concat(F.lit("overlength:"), F.col("length").cast("string"))).when(F.col("n_supervised") == 0, "no_supervised_tokens")
    return sums.withColumns({"valid": reason.isNull(), "invalid_reason": reason})


def reason_counts(validated: DataFrame) -> DataFrame:
    """Rows by reason, without what follows a colon; valid rows count as valid."""
    reason = F.coalesce(F.split_part("invalid_reason", F.lit(":"), F.lit(1)), F.lit("valid"))
    return validated.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("length").alias("n_tokens"))


def head_per_split(rows: DataFrame, split: str, order: list, n: int) -> DataFrame:
    """The first n rows of each split by order; Spark limits each task's rows to n before the shuffle."""
    place = F.row_number().over(Window.partitionBy(split).orderBy(*order))
    return rows.withColumn("_k", place).where(F.col("_k") <= n).drop("_k")


def max_prompt_chars(rows: DataFrame, prompt: str, n: int, split: str = "split") -> DataFrame:
    """Training rows whose prompt has n characters at most, and all other rows."""
    return rows.where((F.col(split) != "train") | F.col(split).isNull() | (F.length(prompt) <= n))


def prepare_split(turns: DataFrame, max_length: int, limit: int | None = None, tools: DataFrame | None = None, include_tools: bool = False) -> tuple[DataFrame, DataFrame]:
    """The valid conversations with their labels, and the counts by reason. No valid row at all is an error.

    limit: the first conversations by key; tools: (conv_id, tools), whose rows with tools are left out unless included, with the reason tools_disabled.
    """
    if limit is not None:
        turns = turns.join(turns.select("conv_id").distinct().orderBy("conv_id").limit(limit), "conv_id", "left_semi")
    checked = validate_rows(supervised_spans(turns), max_length)
    if tools is not None:
        said = filter_tools(tools, include_tools).where("tool_reason IS NOT NULL").select("conv_id", "tool_reason")
        checked = checked.join(said, "conv_id", "left").withColumn("invalid_reason", F.coalesce("tool_reason", "invalid_reason")).drop("tool_reason").withColumn("valid", F.col("invalid_reason").isNull())
    counts = reason_counts(checked)
    if checked.where("valid").isEmpty():
        raise ValueError("no valid row: " + ", ".join(f"{r.reason} {r.n_rows}" for r in counts.collect()))  # a row for each reason
    return label_arrays(turns).join(checked.where("valid").select("conv_id"), "conv_id", "left_semi"), counts


def sample_per_reason(validated: DataFrame, k: int) -> DataFrame:
    """The first k rows of each reason, by key."""
    reason = F.coalesce(F.split_part("invalid_reason", F.lit(":"), F.lit(1)), F.lit("valid"))
    order = Window.partitionBy("reason").orderBy("conv_id")
    return validated.withColumn("reason", reason).withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)


def padding_plan(lengths: DataFrame, batch: int, multiple: int) -> DataFrame:
    """Batches of rows in key order within a shard, their padded length, and the padding in each. lengths: (shard, key, length)."""
    rows = ranked(lengths, ["shard"], ["key"], "_k").withColumn("batch", F.floor(F.col("_k") / batch))
    target = F.ceil(F.max("length") / multiple) * multiple
    return rows.groupBy("shard", "batch").agg(F.count(F.lit(1)).alias("n_rows"), target.cast("long").alias("target"), (target * F.count(F.lit(1)) - F.sum("length")).cast("long").alias("padding"))


def padded(rows: DataFrame, batch: int, multiple: int) -> DataFrame:
    """Rows (key, input_ids, labels) with batch, input_ids and labels padded by 0 and MASKED to their batch's target, and attention_mask. A row without any label is an error when it is read."""
    x = ranked(rows, [], ["key"], "_k").withColumn("batch", F.floor(F.col("_k") / batch))
    target = x.groupBy("batch").agg((F.ceil(F.max(F.size("input_ids")) / multiple) * multiple).cast("int").alias("target"))
    x = x.join(target, "batch")
    labelled = F.exists("labels", lambda v: v != MASKED)
    more = F.col("target") - F.size("input_ids")
    ids = F.when(labelled, F.concat("input_ids", F.array_repeat(F.lit(0), more))).otherwise(F.raise_error(F.lit("a row has no label")).cast("array<int>"))
    mask = F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), more))
    return x.select("key", "batch", ids.alias("input_ids"), F.concat("labels", F.array_repeat(F.lit(MASKED), more)).alias("labels"), mask.alias("attention_mask"))


def filter_tools(rows: DataFrame, include: bool = False) -> DataFrame:
    """Rows with tools get the reason tools_disabled unless included; null, blank and empty lists are no tools."""
    has = F.coalesce(~F.trim("tools").isin("", "[]", "null"), F.lit(False))
    return rows.withColumn("tool_reason", F.when(has & F.lit(not include), "tools_disabled"))


def first_by_role(turns: DataFrame) -> DataFrame:
    """The first system, user and assistant text of each conversation."""
    own = [F.min_by("text", F.when(F.col("role") == r, F.col("turn"))).alias(f"{r}_text") for r in ("system", "user", "assistant")]
    return turns.groupBy("conv_id").agg(*own)


def to_messages(rows: DataFrame, instruction: str, prompt: str = "prompt", code: str = "code") -> DataFrame:
    """A column messages: system, user and assistant, the last with the code fenced."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    fenced = F.concat(F.lit("```python\n"), F.trim(F.col(code)), F.lit("\n```"))
    return rows.withColumn("messages", F.array(turn("system", F.lit(instruction)), turn("user", F.col(prompt)), turn("assistant", fenced)))


def with_system(rows: DataFrame, text: str | None) -> DataFrame:
    """Null keeps the messages; else their system turns go and one with the text comes first."""
    if text is None:
        return rows
    rest = F.filter("messages", lambda m: m["role"] != "system")
    return rows.withColumn("messages", F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(text).alias("content"))), rest))


def select_correct(verdicts: DataFrame, max_gap: float) -> DataFrame:
    """A column reject: null for a verified row without violations whose cost is within max_gap of the reference, else why not."""
    gap = (F.col("cost") - F.col("reference_value")) / F.greatest(F.abs("reference_value"), F.lit(1e-9))
    why = F.when(~F.col("verified"), "unverified").when(F.col("violations") > 0, "violations").when(F.col("cost").isNull(), "no_cost").when(F.col("reference_value").isNull(), "no_reference").when(gap > max_gap, "gap")
    return verdicts.withColumn("gap", gap).withColumn("reject", why)
