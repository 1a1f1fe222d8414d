"""Counting, ranking, searching and storing findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AuditConfig
from ..functions.texts import slug
from ..rules import PRIORITIES, priority_rank, selected_rules
from ..schemas import ISSUE_FIELDS
from .skew import top_k

SEVERITIES = ("error", "warning", "info")
LEAKS_SHOWN, ERRORS_SHOWN, PAGE_ROWS, DETAIL_CAP = 25, 15, 200, 400  # fixed values


def counts_by_severity(issues: DataFrame, *by: str) -> DataFrame:
    return issues.groupBy(*by).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def counts_by_priority(classified: DataFrame, *by: str) -> DataFrame:
    """One column per priority, zeros kept."""
    return classified.groupBy(*by).agg(
        *[F.count_if(F.col("priority") == p).alias(p) for p in PRIORITIES])


def counts_by_rule(classified: DataFrame, *by: str) -> DataFrame:
    """Rules with their counts, most urgent and then most frequent first."""
    return classified.groupBy(*by, "rule", "priority", "category").agg(
        F.count("*").alias("n")).orderBy(*by, priority_rank(F.col("priority")), F.desc("n"), "rule")


def page_scorecard(issues: DataFrame) -> DataFrame:
    return issues.groupBy("pageUrl").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"))


def priority_matrix(classified: DataFrame) -> DataFrame:
    """Counts per priority and category with all subtotals (NULL = all)."""
    return classified.cube("priority", "category").agg(F.count("*").alias("n"))


def filter_issues(issues: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Keep what the run was asked about: AND across axes, OR within one, empty = all."""
    custom = {rule: meta for c in cfg.customChecks for rule, meta in c.rules.items()}
    return issues.where(selected_rules(cfg.rules, cfg.priorities, cfg.categories, custom))


def top_findings(issues: DataFrame, by: Sequence[str], order: Sequence[Column],
                 leaks: int = LEAKS_SHOWN, errors: int = ERRORS_SHOWN) -> DataFrame:
    """Per group: the first leaks and the first other errors, with how many more there are.

    Adds ``part`` (``leak`` or ``error``), ``rank`` and ``more``.
    """
    part = F.when(F.col("check") == "forbidden-hosts", "leak").when(
        F.col("severity") == "error", "error")
    parted = issues.withColumn("part", part).where("part IS NOT NULL")
    keys = [*by, "part"]
    shown = F.when(F.col("part") == "leak", leaks).otherwise(errors)
    first = top_k(parted, keys, order, max(leaks, errors), [F.col(c) for c in ISSUE_FIELDS],
                  rank="rank").where(F.col("rank") <= shown)
    totals = parted.groupBy(*keys).agg(F.count("*").alias("total"))
    return first.join(totals, keys).withColumn(
        "more", F.greatest(F.col("total") - shown, F.lit(0))).drop("total")


def search_issues(classified: DataFrame, priorities: Sequence[str] = (), category: str = "",
                  severity: str = "", term: str = "") -> DataFrame:
    """The report's filters. A term found in the rule or category keeps the whole group."""
    keep = F.lit(True)
    if priorities:
        keep = keep & F.col("priority").isin(*priorities)
    if category:
        keep = keep & (F.col("category") == category)
    if severity:
        keep = keep & (F.col("severity") == severity)
    needle = term.strip().lower()
    if needle:
        group = F.lower(F.concat_ws(" ", "rule", "category"))
        row = F.lower(F.concat_ws(" ", "message", "pageUrl", F.coalesce("target", F.lit(""))))
        keep = keep & (group.contains(needle) | row.contains(needle))
    return classified.where(keep)


def report_page(issues: DataFrame, by: Sequence[str], order: Sequence[Column], page: int,
                rows: int = PAGE_ROWS) -> DataFrame:
    """Page ``page`` (from 0) of each group, ``rows`` rows long, details cut for display."""
    first = top_k(issues, by, order, (page + 1) * rows, [F.col(c) for c in ISSUE_FIELDS],
                  rank="row_no").where(F.col("row_no") > page * rows)
    return first.withColumn("detail", F.left(F.col("detail"), F.lit(DETAIL_CAP)))


def quality_gate(counts: DataFrame, fail_on: str = "error") -> DataFrame:
    """Add ``exit_code`` to severity counts."""
    bad = {"error": F.col("error") > 0,
           "warning": F.col("error") + F.col("warning") > 0}.get(fail_on, F.lit(False))
    return counts.withColumn("exit_code", F.when(bad, 1).otherwise(0))


def run_index(runs: DataFrame, classified: DataFrame) -> DataFrame:
    """One summary row per run, newest first."""
    totals = classified.groupBy("run").agg(
        F.count("*").alias("issues"),
        *[F.count_if(F.col("priority") == p).alias(p) for p in PRIORITIES])
    columns = ["issues", *PRIORITIES]
    return runs.join(totals, "run", "left").na.fill(0, columns).orderBy(
        F.desc("startedAt"), "run")


def run_name(name: Column, include_paths: Column) -> Column:
    """The run's own name, else the paths it was limited to, else ``main``."""
    return (F.when(F.coalesce(name, F.lit("")) != "", slug(name))
            .when(F.coalesce(F.array_size(include_paths), F.lit(0)) > 0,
                  slug(F.array_join(include_paths, "-"))).otherwise("main"))


def write_report(issues: DataFrame, runs: DataFrame, path: str, run: str) -> None:
    """Issue rows by site and run as Parquet, and the run as JSON lines.

    The lines are the summary rows and one line for each page and rule with issues, so no line
    holds a whole run; ``read_report(…, multi_line=False)`` reads them back.
    """
    issues.withColumn("run", F.lit(run)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("run", "site").parquet(f"{path}/issues")
    lines = issues.groupBy("site", "pageUrl", "rule").agg(
        F.collect_list(F.struct(*ISSUE_FIELDS)).alias("issues")).select(
        F.lit(run).alias("run"), "site", "issues")
    runs.unionByName(lines, allowMissingColumns=True).write.mode("overwrite").json(f"{path}/{run}")


def slim(captures: DataFrame) -> DataFrame:
    """Drop what no cross-page check reads."""
    empty = {"requestUrls": "array<string>", "console": "array<struct<type:string,text:string,location:string>>",
             "failedRequests": "array<struct<url:string,status:int,method:string,resourceType:string,failure:string>>"}
    out = captures.withColumns({c: F.array().cast(t) for c, t in empty.items()})
    dom = F.col("dom")
    for name in ("links", "images", "resources", "inlineScripts"):
        kind = captures.schema["dom"].dataType[name].dataType
        dom = dom.withField(name, F.array().cast(kind))
    return out.withColumn("dom", F.when(F.col("dom").isNotNull(), dom))
