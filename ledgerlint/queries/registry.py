"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlint.operators.findings import RowKey

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXPECTED: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with the SQL for its expected result if there is one."""
    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            EXPECTED[name] = sql
        return function

    return register


TRACKER_KEY = RowKey(("row_index",), "row_index")
LINE_KEY = RowKey(("l_orderkey", "l_linenumber"))


def flat(findings: DataFrame, with_detail: bool = False) -> DataFrame:
    """Findings with the column list as text, for comparison."""
    columns = ["check_id", "finding_type", F.concat_ws(",", "columns").alias("columns"), "row_key", "severity"]
    return findings.select(*columns, *(["detail"] if with_detail else []))


def finding_sql(check_id, finding_type, columns, source, condition, row_key, severity="MEDIUM", extra="") -> str:
    """SQL for the findings of one row rule."""
    severity = severity if severity.startswith("(") else f"'{severity}'"
    return (
        f"SELECT '{check_id}' AS check_id, '{finding_type}' AS finding_type, '{columns}' AS columns, "
        f"{row_key} AS row_key, {severity} AS severity{extra} FROM {source} WHERE {condition}"
    )


TRACKER_ROW = "CAST(row_index AS VARCHAR)"
LINE_ROW = "CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)"
