"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.functions.tables import shared_dir, stored

__all__ = ["WORD", "Shelf", "doc_id", "id_kind", "lean_session", "shared_dir", "stored", "text_or_empty"]

#: Bytes that separate words, as a character class for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


class Shelf:
    """Tables in the shared folder: put() writes and rereads one, drop() deletes those whose readers have been written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.places = spark, shared_dir(spark, name), {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{len(self.places)}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.places[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self.places[id(t)]
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def lean_session(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, and lets the shuffle files of finished actions go at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def doc_id(docs: DataFrame) -> Column:
    """The doc_id as a long; one that is a struct, such as a key of two hashes, stays."""
    own = docs.schema["doc_id"].dataType
    return F.col("doc_id") if isinstance(own, StructType) else F.col("doc_id").cast("long").alias("doc_id")


def id_kind(rows: DataFrame) -> str:
    return rows.schema["doc_id"].dataType.simpleString()


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
