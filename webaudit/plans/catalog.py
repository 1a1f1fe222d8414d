"""All named queries (importing a module registers its queries)."""

from . import check_queries, page_queries, report_queries, stream_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
