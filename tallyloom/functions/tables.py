"""Tables in the folder that driver and executors share, and exact ranks of any number of rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the session's spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder; a cluster session is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage, and is safe when executors are lost."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """df as a side of joins that grows with the input: it is shuffled. Spark guesses sizes from compressed files, and would send millions of short rows through the driver."""
    return df.hint("merge")


class Shelf:
    """Stored tables of one piece of work: put() writes and rereads one, drop() deletes those whose readers are done, or all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.places = spark, shared_dir(spark, name), {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{len(self.places)}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.places[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in [self.places[id(t)][1] for t in tables] or [self.path]:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def ranked(df: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    """df with the column name: each row's place, from 0, in its group (null is one) by order.

    Rows are sorted in ranges of group and order, and numbered in each; places follow from the numbers of rows in the ranges before. So a group
    of any size is sorted by many tasks, and only a row for each range and group meets in one.
    """
    keys: list[str | Column] = [*by, *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = stored(rows, "ranked").withColumn("_part", F.shiftright("_at", 33))
    runs = rows.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")
    runs = runs.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), start.alias("_start"))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return rows.join(runs, same).withColumn(name, F.col("_at") + F.col("_start")).select(*df.columns, name)
