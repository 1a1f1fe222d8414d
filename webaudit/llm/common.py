"""Helpers that several operators share."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path

HEAVY_KEYS = 1024  # a lookup broadcasts at most this many keys
BATCH_ROWS = 512   # rows of an Arrow batch: bounds a Python worker's memory with long texts

__all__ = ["cut_lineage", "drop_folder", "lookup", "parts_for", "prepared", "scratch_path", "stored",
           "table"]


def prepared(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches small enough for tables of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(rows: int, per_part: int) -> int:
    """Partitions that hold about ``per_part`` rows each."""
    return max(1, math.ceil(rows / per_part))


def lookup(left: DataFrame, right: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """``left`` with the columns of ``right`` (NULL without a partner), safe from hot keys.

    ``right`` has one row per key and says in ``n`` how many left rows have it. At most
    ``HEAVY_KEYS`` keys can hold ``total / HEAVY_KEYS`` rows each: these are broadcast, so
    their left rows never meet in one task. All other keys join by a shuffle.
    """
    cut = max(64, total // HEAVY_KEYS)
    heavy = F.broadcast(right.where(F.col(n) >= cut))
    light = right.where(F.col(n) < cut)
    hot = left.join(heavy, key)
    rest = left.join(heavy, key, "left_anti").join(light, key, "left")
    return hot.unionByName(rest)


def drop_folder(spark: SparkSession, uri: str) -> None:
    """Delete a scratch folder of this run, wherever it is stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` written to the shared folder and read again, and how to delete it once it was read."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), lambda: drop_folder(spark, path)


def text_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra ones, whatever they are called, take no part."""
    return docs.select(*[F.col(f"`{c}`") for c in names])


def columns_of(names: Sequence[str]) -> list:
    return [F.col(f"`{c}`") for c in names]
