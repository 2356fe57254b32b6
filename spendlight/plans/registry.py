"""Every query of the library by name, and the SQL that checks it."""

from __future__ import annotations

from spendlight.plans import anomaly_queries, case_queries, flow_queries, graph_queries, text_queries  # noqa: F401
from spendlight.plans.catalog import QUERIES, SQL


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
