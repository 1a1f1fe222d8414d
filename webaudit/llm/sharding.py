"""Sharding by longest-processing-time scheduling: copies stay together, shards weigh the same."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, parts_for, table, text_columns

ITEMS = 1 << 15           # a group of a 1/ITEMS part of all bytes or more is an item of its own
ROWS_PER_BUCKET = 50_000  # rows numbered in one sort


def lpt(items: Iterable[tuple[str, int]], shards: int) -> dict[str, int]:
    """Heaviest first, each item to the least-loaded shard (ties: name, then shard number)."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for name, weight in sorted(items, key=lambda i: (-i[1], i[0])):
        load, shard = heap[0]
        placed[name] = shard
        heapq.heapreplace(heap, (load + weight, shard))
    return placed


def shard_by_size(docs: DataFrame, shards: int = 8, items: int = ITEMS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row; equal texts share a shard.

    Size is the UTF-8 length plus 1. The heap sees at most ``2 * items`` items, whatever the
    corpus: groups with at least a ``1/items`` part of all bytes (there are at most ``items``)
    are items of their own; the lighter ones go, by hash of the text, into ``items`` bundles. On
    up to ``items`` equal groups or so this is plain scheduling of all groups. A group heavier
    than an even share makes its shard as heavy as itself: it is not cut.

    A NULL text is an empty one. NULL or repeated doc_ids are rows like any other. Empty
    input gives no rows. Slots are gapless from 0 in each shard, in an order by hash bucket.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = cut_lineage(text_columns(docs, "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")), "shard-base")
    spark = docs.sparkSession
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    cut = max(1, -(-total // items))
    bundle = F.concat(F.lit("z"), F.pmod(F.xxhash64("digest"), F.lit(items)).cast("string"))
    groups = base.groupBy("digest").agg(F.sum("size").alias("weight")).select(
        "digest", "weight",
        F.when(F.col("weight") >= cut, F.hex("digest")).otherwise(bundle).alias("item"))
    weights = groups.groupBy("item").agg(F.sum("weight").alias("weight")).collect()
    placed = lpt(((r["item"], r["weight"]) for r in weights), shards)
    shard_of = F.broadcast(spark.createDataFrame(
        list(placed.items()), "item string, shard int"))
    # Both halves of the plan table have at most `items` rows.
    alone = F.broadcast(shard_of.where(~F.col("item").startswith("z")).select(
        F.unhex("item").alias("digest"), F.col("shard").alias("own_shard")))
    assigned = (base.withColumn("item", bundle).join(alone, "digest", "left")
                .join(shard_of, "item", "left")
                .select("doc_id", "size", "text_crc32",
                        F.coalesce("own_shard", "shard").alias("shard")))
    buckets = parts_for(rows, ROWS_PER_BUCKET)
    row = F.xxhash64("doc_id", "size", "text_crc32")
    assigned = assigned.withColumn("bucket", F.pmod(row, F.lit(buckets)).cast("int"))
    counts = assigned.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    return (assigned.withColumn("at", F.row_number().over(within) - 1)
            .join(starts, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("start") + F.col("at")).cast("long").alias("slot")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near-equal bytes."""
    return shard_by_size(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
