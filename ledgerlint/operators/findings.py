"""The findings table that every check writes, and its roll-up.

One row per violating row:

    check_id, agent, finding_type, columns, group_key, row_key, row_order, severity, detail

``group_key`` separates several findings of one check on the same columns (for instance one per
status spelling); it is NULL where the columns alone identify the finding. ``row_key`` is NULL for
findings about a whole column, which then carry their size in ``weight``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlint.functions.values import any_of, column_list, holds, key_text, named, severity_rank
from ledgerlint.settings import PREVIEW_ROWS

FINDING_SCHEMA = (
    "check_id string, agent string, finding_type string, columns array<string>, group_key string, "
    "row_key string, row_order bigint, severity string, detail string, weight bigint"
)
FINDING_COLUMNS = [part.split()[0] for part in FINDING_SCHEMA.split(", ")]
FINDING_ID = ["check_id", "agent", "finding_type", "columns", "group_key"]


@dataclass(frozen=True)
class RowKey:
    """How findings name a row: readable key columns, and a number that gives the row order."""

    columns: tuple
    order: str | None = None

    @property
    def needed(self) -> list[str]:
        """The columns that name and order a row, each once."""
        return list(dict.fromkeys([*self.columns, *([self.order] if self.order else [])]))

    def text(self) -> Column:
        return key_text(*self.columns)

    def position(self) -> Column:
        return (named(self.order) if self.order else F.lit(None)).cast("bigint")


@dataclass(frozen=True)
class RowRule:
    """A check that looks at one row at a time."""

    check_id: str
    agent: str
    finding_type: str
    columns: tuple
    condition: Column
    severity: str = "MEDIUM"
    detail: Column | None = None
    group_key: str | None = None

    def hit(self) -> Column:
        detail = F.lit(None) if self.detail is None else self.detail
        return F.struct(
            F.lit(self.check_id).alias("check_id"),
            F.lit(self.agent).alias("agent"),
            F.lit(self.finding_type).alias("finding_type"),
            column_list(*self.columns).alias("columns"),
            F.lit(self.group_key).cast("string").alias("group_key"),
            F.lit(self.severity).alias("severity"),
            detail.cast("string").alias("detail"),
        )


def empty_findings(df: DataFrame) -> DataFrame:
    """No findings, planned as an empty projection of the input so that it works on any session."""
    return df.sparkSession.createDataFrame([], FINDING_SCHEMA)


def row_findings(df: DataFrame, rules: list[RowRule], key: RowKey) -> DataFrame:
    """Apply every row rule in one pass over the table; no shuffle.

    Rows that break no rule are dropped by a plain filter first, so that simple rules reach the scan.
    """
    if not rules:
        return empty_findings(df)
    hits = F.array_compact(F.array(*[F.when(r.condition, r.hit()) for r in rules]))
    return (
        df.where(any_of(r.condition for r in rules))
        .select(key.text().alias("row_key"), key.position().alias("row_order"), F.explode(hits).alias("hit"))
        .select("hit.*", "row_key", "row_order", F.lit(1).cast("bigint").alias("weight"))
        .select(*FINDING_COLUMNS)
    )


def rule_counts(df: DataFrame, rules: list[RowRule]) -> DataFrame:
    """How many rows break each rule: one pass, one small row of partial counts per task."""
    counted = df.agg(*[F.count_if(holds(r.condition)).alias(f"n{i}") for i, r in enumerate(rules)])
    rows = [
        F.struct(
            F.lit(r.check_id).alias("check_id"),
            F.lit(r.finding_type).alias("finding_type"),
            F.lit(",".join(r.columns)).alias("columns"),
            F.col(f"n{i}").alias("n_rows"),
        )
        for i, r in enumerate(rules)
    ]
    return counted.select(F.inline(F.array(*rows)))


def member_findings(
    rows: DataFrame,
    key: RowKey,
    check_id: str,
    agent: str,
    finding_type: str,
    columns,
    severity: Column | str = "MEDIUM",
    detail: Column | None = None,
    group_key: Column | None = None,
) -> DataFrame:
    """Findings for rows that are already known to violate a check."""
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select(
        F.lit(check_id).alias("check_id"),
        F.lit(agent).alias("agent"),
        F.lit(finding_type).alias("finding_type"),
        column_list(*columns).alias("columns"),
        (F.lit(None) if group_key is None else group_key).cast("string").alias("group_key"),
        key.text().alias("row_key"),
        key.position().alias("row_order"),
        severity.alias("severity"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
        F.lit(1).cast("bigint").alias("weight"),
    )


def column_findings(
    facts: DataFrame, check_id: str, agent: str, finding_type: str,
    column: Column, count: Column, severity: Column | str, detail: Column | None = None,
) -> DataFrame:
    """Findings about whole columns: one row each, the number of rows in ``weight``."""
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return facts.select(
        F.lit(check_id).alias("check_id"),
        F.lit(agent).alias("agent"),
        F.lit(finding_type).alias("finding_type"),
        F.array(column).alias("columns"),
        F.lit(None).cast("string").alias("group_key"),
        F.lit(None).cast("string").alias("row_key"),
        F.lit(None).cast("bigint").alias("row_order"),
        severity.alias("severity"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
        count.cast("bigint").alias("weight"),
    )


def summarise(findings: DataFrame, preview_rows: int = PREVIEW_ROWS) -> DataFrame:
    """One row per finding: its size, and the first rows concerned in row order.

    The counts combine inside each task before the shuffle. The preview keeps at most
    ``preview_rows`` rows per finding inside each task as well (a window group limit), so a finding
    that covers a third of the table sends a hundred rows per task, not all of them.
    """
    counts = findings.groupBy(*FINDING_ID).agg(
        F.sum("weight").alias("count"),
        F.min_by("severity", severity_rank(F.col("severity"))).alias("severity"),
        F.min("detail").alias("detail"),
    )
    first = Window.partitionBy(*FINDING_ID).orderBy(F.col("row_order").asc_nulls_last(), "row_key")
    preview = (
        findings.where(F.col("row_key").isNotNull())
        .select(*FINDING_ID, F.row_number().over(first).alias("rn"), "row_key")
        .where(F.col("rn") <= preview_rows)
    )
    # One row with the totals and at most a preview's worth of rows per finding come together here.
    shown = F.array_compact(F.collect_list(F.when(F.col("rn").isNotNull(), F.struct("rn", "row_key"))))
    return (
        counts.unionByName(preview, allowMissingColumns=True)
        .groupBy(*FINDING_ID)
        .agg(
            F.max("count").alias("count"),
            F.max("severity").alias("severity"),
            F.max("detail").alias("detail"),
            F.transform(F.array_sort(shown), lambda r: r["row_key"]).alias("affected_rows"),
        )
    )
