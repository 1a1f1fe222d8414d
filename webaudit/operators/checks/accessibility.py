"""Recorded accessibility violations, ranked by their impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...config import AuditConfig
from ...functions.texts import is_blank, join_lines, wcag_of
from ...schemas import AXE
from .common import explode_issues, issue

CHECK = "accessibility"
NODE_CAP = 8  # fixed value: nodes kept per violation; nodeCount still counts them all


def cap_nodes(violation: Column) -> Column:
    """What a capture keeps of a raw violation: the first nodes, their total, an impact."""
    return (violation
            .withField("nodeCount", F.size(violation["nodes"]))
            .withField("nodes", F.slice(violation["nodes"], 1, NODE_CAP))
            .withField("impact", F.coalesce(violation["impact"], F.lit("minor"))))


def violation_issue(v: Column) -> Column:
    total, listed = v["nodeCount"], F.size(v["nodes"])
    extra = F.when(total > listed, F.concat(
        F.lit(" (+"), (total - listed).cast("string"), F.lit(" more)"))).otherwise("")
    criteria = F.coalesce(
        F.nullif(F.array_join(wcag_of(v["tags"]), ", "), F.lit("")), F.lit("n/a"))
    return issue(
        CHECK, F.when(v["impact"].isin("critical", "serious"), "error").otherwise("warning"),
        F.concat(F.lit("a11y-"), v["impact"]),
        F.concat(v["id"], F.lit(": "), v["help"], F.lit(" — "), total.cast("string"),
                 F.when(total == 1, " element").otherwise(" elements")),
        target=v["helpUrl"], where=F.get(v["nodes"], F.lit(0)),
        detail=join_lines(F.concat(F.array_join(v["nodes"], "\n"), extra), v["failureSummary"],
                          F.concat(F.lit("WCAG: "), criteria), sep="\n\n"))


def accessibility_issues(cfg: AuditConfig) -> Column:
    failed = issue(
        CHECK, "error", "a11y-audit-failed",
        "axe-core could not audit this page — its accessibility is unknown, not clean",
        detail=F.col("axeError"))
    return F.when(~is_blank(F.col("axeError")), F.array(failed)).otherwise(
        F.transform(F.coalesce(F.col("axe"), F.array().cast(AXE)), violation_issue))


def check_accessibility(captures: DataFrame, cfg: AuditConfig) -> DataFrame:
    return explode_issues(captures, accessibility_issues(cfg))
