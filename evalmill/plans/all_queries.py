"""All registered queries of the library proper."""

from __future__ import annotations

from evalmill.plans import curate_queries, job_queries, metric_queries, more_queries, reader_queries, source_queries, stat_queries  # noqa: F401
from evalmill.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
