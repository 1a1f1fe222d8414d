"""Give each issue its priority, category and reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import FALLBACK, rule_meta_df


def classify_issues(issues: DataFrame, rule_meta: DataFrame | None = None) -> DataFrame:
    """Left join with the rule dimension; unranked rules get the fallback rank.

    The builtin dimension has one row per rule the engine knows, so it is broadcast; a
    caller's own table is joined as its size suggests.
    """
    meta = F.broadcast(rule_meta_df(issues.sparkSession)) if rule_meta is None else rule_meta
    joined = issues.join(meta, "rule", "left")
    filled = {name: F.coalesce(F.col(name), F.lit(value)) for name, value in
              zip(("priority", "category", "rationale"), FALLBACK)}
    return joined.withColumns(filled)
