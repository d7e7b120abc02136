"""All named queries of the screening side, from their groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit_queries, case_queries, document_queries, field_queries, image_queries, ledger_queries, report_queries, risk_queries, search_queries

GROUPS = (search_queries, audit_queries, document_queries, risk_queries, case_queries, field_queries, image_queries, ledger_queries, report_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for group in GROUPS for name, run in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.SQL.items()}
