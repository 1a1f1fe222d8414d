"""Reading page captures and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import site_of
from ..schemas import CAPTURE, ISSUE, RUN


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Scan a directory of page captures with the contract's schema (no inference)."""
    return spark.read.schema(CAPTURE).format(fmt).load(path)


def with_site(df: DataFrame, url: str = "url") -> DataFrame:
    """Add the ``site`` a row belongs to (host without ``www.``)."""
    return df.withColumn("site", site_of(url))


ISSUES = "array<struct<" + ISSUE.replace(" string", ":string").replace(", ", ",") + ">>"
REPORT = (f"{RUN}, site string, issues {ISSUES}, pages array<struct<issues:{ISSUES}>>, "
          f"globalIssues {ISSUES}")


def read_report(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Runs stored as JSON under ``<path>/<run>/``; a corrupt or half-written run is no run.

    By default each file is one document; ``multi_line=False`` reads JSON lines, which Spark
    can split: some line of the run tells when it started, others may hold issues only. A run
    with a line that is no JSON goes as a whole; ``broken_reports`` names it. ``issues``
    holds the flat list, those of ``pages`` and ``globalIssues`` together.
    """
    raw = _raw_reports(spark, path, multi_line)
    whole = _runs_seen(raw).where("corrupt = 0 AND started > 0").select("_folder")
    none = F.array().cast(ISSUES)
    every = F.concat(
        F.coalesce("issues", none),
        F.flatten(F.coalesce(F.transform("pages", lambda p: F.coalesce(p["issues"], none)),
                             F.array().cast(f"array<{ISSUES}>"))),
        F.coalesce("globalIssues", none))
    return (raw.join(whole, "_folder", "left_semi").withColumn("issues", every)
            .withColumn("run", F.coalesce("run", "_folder"))
            .drop("_corrupt", "_folder", "pages", "globalIssues"))


def broken_reports(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``run, corrupt, started``: the folders that ``read_report`` leaves out, and why."""
    seen = _runs_seen(_raw_reports(spark, path, multi_line))
    return seen.where("corrupt > 0 OR started = 0").withColumnRenamed("_folder", "run")


def _runs_seen(raw: DataFrame) -> DataFrame:
    return raw.groupBy("_folder").agg(F.count("_corrupt").alias("corrupt"),
                                      F.count("startedAt").alias("started"))


def _raw_reports(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    raw = (spark.read.schema(REPORT + ", _corrupt string")
           .option("multiLine", str(multi_line).lower()).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt")
           .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path))
    folder = F.regexp_extract("_metadata.file_path", "/(?:run=)?([^/]+)/[^/]+$", 1)
    return raw.select("*", folder.alias("_folder"))


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """Issue rows written by ``write_report`` (partitioned by site and run)."""
    return spark.read.parquet(path)
