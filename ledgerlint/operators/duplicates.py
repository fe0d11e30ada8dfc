"""Exact duplicate rows and duplicate keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlint.functions.values import named, row_digest
from ledgerlint.operators.findings import RowKey, member_findings
from ledgerlint.operators.skew import join_to_groups
from ledgerlint.settings import Thresholds


def duplicate_groups(df: DataFrame, columns=None) -> DataFrame:
    """(digest, members) for every set of rows that agree in the columns, nulls counting as equal.

    Rows travel as a 32-byte digest, combined inside each task: wide rows do not cross the network
    and a hot group arrives as one partial count per task.
    """
    names = list(columns or df.columns)
    return (
        df.select(row_digest(df, names).alias("digest"))
        .groupBy("digest")
        .agg(F.count("*").alias("members"))
        .where(F.col("members") > 1)
    )


def duplicate_totals(df: DataFrame, columns=None) -> DataFrame:
    """One row: groups, members, members beyond the first of each group, and members div 2."""
    return duplicate_groups(df, columns).agg(
        F.count("*").alias("n_groups"),
        F.coalesce(F.sum("members"), F.lit(0)).alias("n_members"),
        F.coalesce(F.sum(F.col("members") - 1), F.lit(0)).alias("n_excess"),
        F.coalesce(F.floor(F.sum("members") / 2), F.lit(0)).alias("halved_count"),
    )


def duplicate_members(df: DataFrame, columns, key: RowKey) -> DataFrame:
    """All rows that share their values in the columns with another row, with the group size."""
    names = list(columns or df.columns)
    rows = df.select(*map(named, key.needed), row_digest(df, names).alias("digest"))
    return join_to_groups(
        rows, duplicate_groups(df, names), ["digest"], "members", key.needed,
    )


def exact_duplicates(df: DataFrame, key: RowKey, columns=None) -> DataFrame:
    """Findings for every row that has an exact copy. ``columns`` defaults to all but the row order."""
    names = list(columns or [c for c in df.columns if c != key.order])
    members = duplicate_members(df, names, key)
    return member_findings(members, key, "D1", "duplicate_hunter", "exact_duplicates", [], detail=F.col("members"))


def duplicate_keys(df: DataFrame, key_columns, key: RowKey) -> DataFrame:
    """Findings for every row whose key occurs more than once; missing keys count as equal."""
    present = [c for c in key_columns if c in df.columns]
    members = duplicate_members(df, present, key)
    return member_findings(
        members, key, "D2", "duplicate_hunter", "duplicate_primary_keys", present, detail=F.col("members")
    )


def duplicate_severity(count, n_rows, limits: Thresholds = Thresholds()):
    """HIGH when more than 5% of the rows are concerned, else MEDIUM."""
    return F.when(count > n_rows * limits.duplicate_share_high, "HIGH").otherwise("MEDIUM")
