"""Queries against their SQL on tables as they are at size: folders of files, and URLs that repeat."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from webaudit.plans import derived as D
from webaudit.plans.catalog import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
NAMES = ["consent_landing", "dedupe_keys", "page_attempt_reduce", "probe_reduce", "sitemap_walk", "run_totals", "stream_checks", "stream_dedupe", "stream_link_issues", "stream_page_sink",
         "stream_retry"]


@pytest.fixture(scope="module")
def sized(spark, tmp_path_factory):
    """The pages of the smallest table, and again under other keys with the URLs of some of them."""
    folder = tmp_path_factory.mktemp("sized")
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    again = pages.where("page_id % 3 > 0").withColumn("page_id", F.col("page_id") + 1003)
    pages.unionByName(again).repartition(2).write.parquet(str(folder / "pages.parquet"))
    return folder


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """One site of more pages than a crawl takes by default."""
    folder = tmp_path_factory.mktemp("wide")
    spark.range(13_000).select(
        F.col("id").alias("page_id"), F.concat(F.lit("https://wide.example/en/"), "id").alias("url"),
        F.lit("").alias("html")).write.parquet(str(folder / "pages.parquet"))
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_query_at_size(spark, sized, name):
    same(spark, sized, name)


@pytest.mark.parametrize("name", ["crawl_frontier", "seed_offers"])
def test_no_page_cap(spark, wide, name):
    same(spark, wide, name)


def test_large_groups_of_titles_are_whole(spark, tmp_path):
    spark.range(2_300).select(
        F.col("id").alias("page_id"), F.concat(F.lit("https://wide.example/en/"), "id").alias("url"),
        F.lit("<html><head><title>Same</title></head></html>").alias("html")).write.parquet(
        str(tmp_path / "pages.parquet"))
    same(spark, tmp_path, "duplicate_titles")
    rows = QUERIES["duplicate_titles"](spark, str(tmp_path)).collect()
    assert sorted(u for r in rows for u in r.urls.split("\n")) == sorted(
        f"https://wide.example/en/{i}" for i in range(2_300))


def test_derived_captures_are_dealt_over_all_cores(spark, sized):
    captures = D.captures(spark, str(sized), hreflang=True)
    assert captures.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_blocked_page_takes_no_finding_of_another_page_with_its_url(spark, tmp_path):
    spark.range(800, 1000).select(
        F.col("id").alias("page_id"),
        F.concat(F.lit("https://wide.example/fr/"), F.col("id") % 37).alias("url"),
        F.lit("").alias("html")).write.parquet(str(tmp_path / "pages.parquet"))
    same(spark, tmp_path, "custom_check")


def same(spark, folder, name):
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = Counter(tuple(str(r[c]) for c in columns) for r in df.collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{Path(folder) / 'pages.parquet' / '*.parquet'}'")
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = Counter(tuple(str(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want and got
