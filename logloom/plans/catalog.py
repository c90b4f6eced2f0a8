"""All queries and their SQL."""

from __future__ import annotations

from logloom.plans import protocol_queries, record_queries, score_queries, stream_queries  # noqa: F401  registering is their import
from logloom.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
