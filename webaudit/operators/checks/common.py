"""How a check emits findings.

A per-page check is one Column: an array of issue structs built from the capture row alone.
All checks of a run are concatenated and exploded once, so any number of rules costs a
single scan with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.lets import compact
from ...schemas import ISSUE_FIELDS


def issue(
    check: str, severity: Column | str, rule: Column | str, message: Column | str,
    target: Column | None = None, where: Column | str | None = None,
    detail: Column | None = None, page_url: Column | None = None,
) -> Column:
    """One issue struct; fields in contract order."""
    def col(value: Column | str | None) -> Column:
        if value is None:
            return F.lit(None).cast("string")
        return F.lit(value) if isinstance(value, str) else value

    values = (check, severity, rule, message,
              F.col("url") if page_url is None else page_url, target, where, detail)
    return F.struct(*[col(v).alias(n) for v, n in zip(values, ISSUE_FIELDS)])


def issue_type() -> str:
    return "array<struct<" + ",".join(f"`{n}`:string" for n in ISSUE_FIELDS) + ">>"


def no_issues() -> Column:
    return F.array().cast(issue_type())


def issues_when(*pairs: tuple[Column, Column]) -> Column:
    """Array of the issues whose condition holds, in order."""
    return compact(F.array(*[F.when(cond, item) for cond, item in pairs]))


def explode_issues(captures: DataFrame, issues: Column, *keep: str) -> DataFrame:
    """One row per issue, with the page's ``site`` and ``seq``."""
    return captures.select("site", "seq", *keep, F.explode(issues).alias("i")).select(
        "site", "seq", *keep, "i.*")


def found_on() -> Column:
    """Where the page was found, unless it was a seed."""
    source = F.col("source")
    return F.when(source.isNotNull() & ~source.isin("", "seed"),
                  F.concat(F.lit("found on: "), source))
