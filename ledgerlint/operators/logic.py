"""Contradictions inside a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlint.functions.values import is_numeric, is_text, named, parse_date, parse_date_text, parse_number
from ledgerlint.operators.findings import RowRule
from ledgerlint.settings import AMOUNT_NAMES, COMPLETE_STATUSES, PERCENT_NAMES, ColumnRoles, name_has

AGENT = "business_logic"


def date_order_rules(df: DataFrame, pairs, formats) -> list[RowRule]:
    """The end is not after the start. Dates that cannot be read break no rule here."""
    return [
        RowRule(
            "L1", AGENT, "date_pair_violation", (s, e),
            parse_date(df, e, formats) <= parse_date(df, s, formats), "HIGH",
            F.concat_ws(" -> ", named(s).cast("string"), named(e).cast("string")),
        )
        for s, e in pairs
        if s in df.columns and e in df.columns
    ]


def amount_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f) and name_has(f.name, AMOUNT_NAMES)]


def negative_amount_rules(df: DataFrame, columns=None) -> list[RowRule]:
    names = amount_columns(df) if columns is None else columns
    return [
        RowRule("L2", AGENT, "negative_amount", (c,), named(c) < 0, "HIGH", named(c)) for c in names
    ]


def over_budget_rules(df: DataFrame, actual: str, budget: str) -> list[RowRule]:
    if not all(c in df.columns and is_numeric(df.schema[c]) for c in (actual, budget)):
        return []
    return [
        RowRule(
            "L3", AGENT, "over_budget", (actual, budget), named(actual) > named(budget), "MEDIUM",
            named(actual) - named(budget),
        )
    ]


def status_percentage_rules(df: DataFrame, roles: ColumnRoles, status=None, percentage=None) -> list[RowRule]:
    """Finished by status, unfinished by percentage."""
    status = status or next((c for c in roles.of_type("status") if c in df.columns), None)
    percentage = percentage or next((c for c in df.columns if name_has(c, PERCENT_NAMES)), None)
    if status is None or percentage is None:
        return []
    number = named(percentage) if is_numeric(df.schema[percentage]) else parse_number(named(percentage).cast("string"))
    return [
        RowRule(
            "L4", AGENT, "status_pct_mismatch", (status, percentage),
            F.lower(named(status)).isin(*COMPLETE_STATUSES) & (number < 100), "MEDIUM",
            F.concat_ws(" ", named(status), number.cast("string")),
        )
    ]


def date_format_rules(df: DataFrame, columns, formats) -> list[RowRule]:
    """Text in a date column that no accepted format reads."""
    return [
        RowRule(
            "L5", AGENT, "invalid_date_format", (c,),
            named(c).isNotNull() & parse_date(df, c, formats).isNull(), "MEDIUM", named(c),
        )
        for c in columns
        if c in df.columns and is_text(df.schema[c])
    ]


def date_format_audit(df: DataFrame, columns, formats) -> DataFrame:
    """(column, format, n_rows): values each format reads, and those that none does. One aggregate."""
    agg, rows = [], []
    for i, c in enumerate(columns):
        text = named(c).cast("string")
        for j, f in enumerate(formats):
            agg.append(F.count(parse_date_text(text, (f,))).alias(f"n_{i}_{j}"))
            rows.append(F.struct(
                F.lit(c).alias("column"), F.lit(f).alias("format"), F.col(f"n_{i}_{j}").alias("n_rows")
            ))
        agg.append(F.count_if(text.isNotNull() & parse_date(df, c, formats).isNull()).alias(f"none_{i}"))
        rows.append(F.struct(
            F.lit(c).alias("column"), F.lit("unreadable").alias("format"), F.col(f"none_{i}").alias("n_rows")
        ))
    return df.agg(*agg).select(F.inline(F.array(*rows)))
