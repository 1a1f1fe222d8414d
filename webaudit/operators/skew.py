"""Joins and top-k that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 8


def salt(columns: Sequence[str | Column], buckets: int = SALTS) -> Column:
    """A bucket derived from row content, so a re-run task computes the same one."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Sequence[str | Column],
    how: str = "inner", buckets: int = SALTS,
) -> DataFrame:
    """Join where ``left`` may pile up on few keys and ``right`` has one row per key.

    Left rows of one key are spread over ``buckets`` by the content of ``spread``; each right
    row is repeated once per bucket. Exact for inner, left, left_semi and left_anti joins.
    """
    salted = left.withColumn("_salt", salt(spread, buckets))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | Column,
    spread: Sequence[str | Column], rank: str = "rank", buckets: int = 16,
) -> DataFrame:
    """The first ``k`` rows per key with their ``rank``.

    Two rounds: each bucket of a key keeps its own first ``k``, then the survivors (at most
    ``k * buckets`` per key) compete. Spark prunes each round before its shuffle.
    """
    first = W.partitionBy(*keys, "_salt").orderBy(*order)
    last = W.partitionBy(*keys).orderBy(*order)
    survivors = (df.withColumn("_salt", salt(spread, buckets))
                 .withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= k)
                 .drop(rank, "_salt"))
    return survivors.withColumn(rank, F.row_number().over(last)).where(F.col(rank) <= k)


def first_k_list(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, k: int,
    name: str, spread: Sequence[str | Column],
) -> DataFrame:
    """Per key, the list of the first ``k`` values in order (never more than ``k`` per group)."""
    ranked = top_k(df, keys, order, k, spread, rank="_rank")
    pairs = F.array_sort(F.collect_list(F.struct("_rank", F.col(value).alias("v"))))
    return ranked.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias(name))
