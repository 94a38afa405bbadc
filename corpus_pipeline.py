"""The training corpus, from raw documents to encoded ones: each stage is written as Parquet and read by the next.

Stages decide by row, not by doc_id: a row is known by 128 bits of all its columns, so rows without a doc_id, or with that
of another, are judged each; rows that are equal as a whole are one for the decisions. Columns may have any names but
those of documents and that of the stage's result (token_ids). Null texts are empty ones for all decisions and
stay null, as do nulls in other columns. Very long texts are read whole. Ties are broken by the least doc_id, then by the
row's key. Without documents each stage gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, minhash, mixing, pii, quality
from tallyloom.llm.common import stored


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with 128 bits of the whole row in a new column, and that column's name."""
    name = "_key"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    cols = [docs[f"`{c}`"] for c in docs.columns]
    whole = [*cols, *[c.isNull() for c in cols]]
    return docs.withColumn(name, F.struct(F.xxhash64(*whole).alias("k1"), F.xxhash64(F.lit(1), *whole).alias("k2"))), name


def judged(docs: DataFrame, key: str) -> DataFrame:
    """What a stage judges: the row's key is its doc_id."""
    return docs.select(F.col(key).alias("doc_id"), "text", "lang")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    rows, key = keyed(docs)
    kept = quality.quality(judged(rows, key)).where("kept").select(F.col("doc_id").alias(key))
    return rows.join(kept, key, "left_semi").drop(key)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, that with the least doc_id (none is the last, and the row's key breaks ties)."""
    rows, key = keyed(docs)
    classes = minhash.near_duplicates(judged(rows, key)).select(F.col("doc_id").alias(key), "class_id")
    ids = rows.select(key, F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"))
    first = classes.join(ids, key).groupBy("class_id").agg(F.min(F.struct("last", "id", key)).alias("m")).select(F.col(f"m.{key}").alias(key))
    return rows.join(first, key, "left_semi").dropDuplicates([key]).drop(key)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms in place of personal data."""
    return pii.pseudonymised(docs, pii.session_key(spark)).select(*[f"`{c}`" for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    return mixing.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_dedup), ("personal data", private_data), ("source mix", source_mix), ("BPE", encoding)]
#: Sketches, Feistel networks, hashes of the mix and BPE are beyond SQL; the tests hold each stage, and the chain of all, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
