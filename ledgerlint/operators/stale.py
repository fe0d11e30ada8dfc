"""Overdue, forgotten and long-running records. The date of the audit is always a parameter."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlint.functions.values import named, parse_date
from ledgerlint.operators.findings import RowRule
from ledgerlint.settings import (
    DATE_FORMATS,
    DONE_STATUSES,
    DUE_NAMES,
    START_NAMES,
    UPDATED_NAMES,
    ColumnRoles,
    Thresholds,
    name_has,
)

AGENT = "stale_records"


@dataclass(frozen=True)
class StaleColumns:
    due: str | None = None
    updated: str | None = None
    start: str | None = None
    status: str | None = None


def stale_columns(df: DataFrame, roles: ColumnRoles) -> StaleColumns:
    """The first column of each kind."""
    def first(parts):
        return next((c for c in df.columns if name_has(c, parts)), None)

    return StaleColumns(
        first(DUE_NAMES),
        first(UPDATED_NAMES),
        first(START_NAMES),
        next((c for c in roles.of_type("status") if c in df.columns), None),
    )


def due_aggregates(df: DataFrame, due: str, formats=DATE_FORMATS) -> list:
    return [F.count("*").alias("n_rows"), F.count(parse_date(df, due, formats)).alias("n_due")]


def due_fill(df: DataFrame, due: str, formats=DATE_FORMATS, counted: DataFrame | None = None) -> DataFrame:
    """One row: rows, readable due dates, share. No rows give a NULL share."""
    if counted is None:
        counted = df.agg(*due_aggregates(df, due, formats))
    return counted.select("n_rows", "n_due", F.try_divide(F.col("n_due").cast("double"), F.col("n_rows")).alias("fill"))


def missing_deadline_rules(
    df: DataFrame, due: str, formats=DATE_FORMATS, limits: Thresholds = Thresholds(), counted: DataFrame | None = None
) -> list[RowRule]:
    """Rows without a readable due date, where most rows have one. Reads one small row back."""
    fill = due_fill(df, due, formats, counted).first()["fill"]
    if fill is None or fill <= limits.due_fill:
        return []
    return [RowRule(
        "T1", AGENT, "missing_deadline", (due,), parse_date(df, due, formats).isNull(), "MEDIUM",
        named(due).cast("string"),
    )]


def stale_rules(
    df: DataFrame, columns: StaleColumns, as_of: dt.date, formats=DATE_FORMATS,
    limits: Thresholds = Thresholds(), done=DONE_STATUSES,
) -> list[RowRule]:
    """Overdue, zombie, finished-before-start and long-running records. A missing status is not done."""
    if not columns.status:
        return []
    today = F.lit(as_of).cast("date")
    is_done = F.lower(F.coalesce(named(columns.status).cast("string"), F.lit(""))).isin(*done)

    def days_before(n):
        return F.lit(as_of - dt.timedelta(days=n)).cast("date")

    rules = []

    def rule(check_id, finding_type, column, condition):
        rules.append(RowRule(
            check_id, AGENT, finding_type, (column, columns.status), condition, "MEDIUM",
            named(column).cast("string"),
        ))

    if columns.due:
        rule("T2", "overdue_tasks", columns.due, ~is_done & (parse_date(df, columns.due, formats) < today))
    if columns.updated:
        rule("T3", "zombie_records", columns.updated,
             ~is_done & (parse_date(df, columns.updated, formats) < days_before(limits.zombie_days)))
    if columns.start:
        start = parse_date(df, columns.start, formats)
        rule("T4", "future_start_done", columns.start, is_done & (start > today))
        rule("T5", "long_running_tasks", columns.start, ~is_done & (start < days_before(limits.long_running_days)))
    return rules
