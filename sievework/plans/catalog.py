"""The queries over the reference's operators, with their SQL."""

from __future__ import annotations

from . import dedup_queries, filter_queries, near_score_queries, pipeline_queries, sampling_queries, stats_queries  # noqa: F401
from .registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
