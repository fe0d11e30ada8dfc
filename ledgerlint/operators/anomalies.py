"""Outliers, skewed columns and impossible values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlint.functions.values import any_of, named, numeric_columns
from ledgerlint.operators.findings import RowRule, column_findings
from ledgerlint.operators.profile import numeric_stats
from ledgerlint.operators.quantiles import exact_quantiles
from ledgerlint.settings import NON_NEGATIVE_NAMES, Thresholds, name_has

AGENT = "anomaly_detector"


def column_limits(
    df: DataFrame, columns=None, limits: Thresholds = Thresholds(), counted: DataFrame | None = None
) -> dict:
    """{column: facts} with mean, deviation, quartile fences and skewness; one row per column.

    One aggregate over the table, unless an earlier pass has it, and the quartiles. Only these numbers reach the driver, where they become literals
    of the second pass, so that pass is a plain filter without a join.
    """
    names = list(columns or numeric_columns(df))
    if not names:
        return {}
    facts = {r["column"]: r.asDict() for r in numeric_stats(df, names, counted).collect()}
    usable = [c for c in names if facts[c]["count"] >= limits.min_values]
    quartiles = exact_quantiles(df, usable, [0.25, 0.75]) if usable else {}
    for c in usable:
        q1, q3 = quartiles[c]
        spread = limits.iqr_k * (q3 - q1)
        facts[c].update(q1=q1, q3=q3, low=q1 - spread, high=q3 + spread)
    return {c: facts[c] for c in usable}


def z_score(column: str, fact: dict):
    """NULL where the column does not vary."""
    if not fact["std_pop"]:
        return F.lit(None).cast("double")
    return (named(column).cast("double") - F.lit(fact["mean"])) / F.lit(fact["std_pop"])


def z_condition(column: str, fact: dict, limits: Thresholds = Thresholds()):
    return F.abs(z_score(column, fact)) > limits.z


def fence_condition(column: str, fact: dict):
    value = named(column).cast("double")
    return (value < F.lit(fact["low"])) | (value > F.lit(fact["high"]))


def outlier_condition(column: str, fact: dict, limits: Thresholds = Thresholds()):
    # Within the fences, a z-score beyond the limit still counts: the checks are joined by OR.
    return F.coalesce(z_condition(column, fact, limits), F.lit(False)) | fence_condition(column, fact)


def outlier_facts(df: DataFrame, facts: dict, limits: Thresholds = Thresholds()) -> DataFrame:
    """Per column: outliers by z-score, by quartile fences and by either, largest |z|, severity."""
    agg, rows = [], []
    for i, (c, fact) in enumerate(facts.items()):
        agg += [
            F.count_if(z_condition(c, fact, limits)).alias(f"z_{i}"),
            F.count_if(fence_condition(c, fact)).alias(f"f_{i}"),
            F.count_if(outlier_condition(c, fact, limits)).alias(f"u_{i}"),
            F.max(F.abs(z_score(c, fact))).alias(f"m_{i}"),
        ]
        rows.append(F.struct(
            F.lit(c).alias("column"),
            F.lit(fact["count"]).cast("bigint").alias("n_values"),
            F.col(f"z_{i}").alias("n_z"),
            F.col(f"f_{i}").alias("n_iqr"),
            F.col(f"u_{i}").alias("n_outliers"),
            F.col(f"m_{i}").alias("max_z"),
            F.when(F.col(f"m_{i}") > limits.z_high, "HIGH").otherwise("MEDIUM").alias("severity"),
        ))
    return df.agg(*agg).select(F.inline(F.array(*rows)))


def outlier_rules(facts: dict, severities: dict, limits: Thresholds = Thresholds()) -> list[RowRule]:
    """Row rules that locate the outliers; ``severities`` by column from outlier_facts."""
    return [
        RowRule(
            "A1", AGENT, "outliers", (c,), outlier_condition(c, fact, limits),
            severities.get(c, "MEDIUM"), named(c),
        )
        for c, fact in facts.items()
    ]


def outlier_severities(facts: dict, limits: Thresholds = Thresholds()) -> dict:
    """{column: severity}. The largest |z| lies at the minimum or the maximum, so no pass is needed."""
    def largest(fact):
        return max(fact["max"] - fact["mean"], fact["mean"] - fact["min"]) / fact["std_pop"] if fact["std_pop"] else 0

    return {c: "HIGH" if largest(f) > limits.z_high else "MEDIUM" for c, f in facts.items()}


def skewed_columns(
    df: DataFrame, columns=None, limits: Thresholds = Thresholds(), counted: DataFrame | None = None
) -> DataFrame:
    """(column, n_values, skewness) where the population skewness is beyond the limit."""
    return (
        numeric_stats(df, columns, counted)
        .where((F.col("count") >= limits.min_values) & (F.abs("skewness") > limits.skew))
        .select("column", F.col("count").alias("n_values"), "skewness")
    )


def skew_findings(
    df: DataFrame, columns=None, limits: Thresholds = Thresholds(), counted: DataFrame | None = None
) -> DataFrame:
    return column_findings(
        skewed_columns(df, columns, limits, counted), "A3", AGENT, "distribution_skew", F.col("column"),
        F.col("n_values"), "MEDIUM", F.round("skewness", 4).cast("string"),
    )


def impossible_negative_rules(usable_columns) -> list[RowRule]:
    """Negative values where the name says they cannot be; columns with too few values are left out
    by the caller."""
    return [
        RowRule("A4", AGENT, "impossible_negative", (c,), named(c) < 0, "MEDIUM", named(c))
        for c in usable_columns
        if name_has(c, NON_NEGATIVE_NAMES)
    ]


def outlier_rows(df: DataFrame, facts: dict, limits: Thresholds = Thresholds()) -> DataFrame:
    """The rows with an outlier in any column."""
    return df.where(any_of(outlier_condition(c, f, limits) for c, f in facts.items()))
