"""Completeness, mixed types, spelling and range checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlint.functions.values import is_numeric, named, parse_date_text, parse_number, value_digest
from ledgerlint.operators.findings import RowKey, RowRule, column_findings, member_findings
from ledgerlint.operators.profile import value_counts
from ledgerlint.operators.skew import join_to_groups
from ledgerlint.settings import DATE_FORMATS, PERCENT_NAMES, ColumnRoles, Thresholds, name_has

AGENT = "data_quality"
#: Spellings of a word that a finding names.
SHOWN_SPELLINGS = 20


def null_aggregates(names) -> list:
    return [F.count("*").alias("n"), *[F.count(named(c)).alias(f"c_{i}") for i, c in enumerate(names)]]


def null_facts(df: DataFrame, columns=None, counted: DataFrame | None = None) -> DataFrame:
    """(column, n_rows, null_count, null_pct) from one fused aggregate, or from an earlier one."""
    names = list(columns or df.columns)
    if counted is None:
        counted = df.agg(*null_aggregates(names))
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            F.col("n").alias("n_rows"),
            (F.col("n") - F.col(f"c_{i}")).alias("null_count"),
        )
        for i, name in enumerate(names)
    ]
    return counted.select(F.inline(F.array(*rows))).withColumn(
        "null_pct", F.try_divide(F.col("null_count") * 100.0, F.col("n_rows"))
    )


def null_severity(count: Column, n_rows: Column, limits: Thresholds = Thresholds()) -> Column:
    share = F.try_divide(count.cast("double"), n_rows)
    return (
        F.when(share > limits.null_high, "HIGH")
        .when(share > limits.null_medium, "MEDIUM")
        .when(share > limits.null_low, "LOW")
    )


def null_density(
    df: DataFrame, columns=None, limits: Thresholds = Thresholds(), counted: DataFrame | None = None
) -> DataFrame:
    """(column, null_count, null_pct, severity, description) of the columns with too many nulls."""
    share = F.col("null_pct") / 100
    return (
        null_facts(df, columns, counted)
        .withColumn("severity", null_severity(F.col("null_count"), F.col("n_rows"), limits))
        .where(F.col("severity").isNotNull())
        .select(
            "column",
            "null_count",
            F.bround("null_pct", 2).alias("null_pct"),
            "severity",
            F.when(F.col("null_count") == F.col("n_rows"), "Completely empty column")
            .when(share > limits.null_high, ">50% nulls")
            .when(share > limits.null_medium, "20-50% nulls")
            .otherwise("5-20% nulls")
            .alias("description"),
        )
    )


def null_rules(flagged) -> list[RowRule]:
    """Row rules that locate the nulls of flagged columns; ``flagged`` are rows of null_density."""
    return [
        RowRule(
            "Q1", AGENT, "null_values", (r["column"],), named(r["column"]).isNull(), r["severity"],
            F.lit(r["description"]),
        )
        for r in flagged
    ]


def text_class(text: Column, formats=DATE_FORMATS) -> Column:
    """number, date, boolean or text; NULL for NULL."""
    return (
        F.when(parse_number(text).isNotNull(), "number")
        .when(parse_date_text(text, formats, any_text=True).isNotNull(), "date")
        .when(F.lower(text).isin("true", "false"), "boolean")
        .when(text.isNotNull(), "text")
    )


def variant_class(value: Column) -> Column:
    """The same classes for a JSON value of any type."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.isNull(), F.lit(None))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(kind == "STRING", "text")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("DATE") | kind.startswith("TIMESTAMP"), "date")
        .when(kind == "VOID", F.lit(None))
        .otherwise("nested")
    )


TYPE_CLASSES = ("number", "date", "boolean", "text", "nested")


def with_classes(df: DataFrame, classes: dict) -> DataFrame:
    """The table with the class of every value, worked out once per value below the aggregate."""
    return df.select("*", *[kind.alias(f"k_{i}") for i, kind in enumerate(classes.values())])


def mix_aggregates(names) -> list:
    return [F.count_if(F.col(f"k_{i}") == c).alias(f"{c}_{i}") for i in range(len(names)) for c in TYPE_CLASSES]


def type_mix(df: DataFrame, classes: dict, counted: DataFrame | None = None) -> DataFrame:
    """(column, n_<class>..., n_classes, n_values) for columns with values of more than one class.

    ``classes`` maps column names to class expressions; one aggregate for all columns, or the
    one-row result of an earlier one.
    """
    rows = []
    for i, name in enumerate(classes):
        counts = [F.col(f"{c}_{i}") for c in TYPE_CLASSES]
        rows.append(F.struct(
            F.lit(name).alias("column"),
            *[n.alias(f"n_{c}") for c, n in zip(TYPE_CLASSES, counts)],
            sum((n > 0).cast("int") for n in counts).alias("n_classes"),
            sum(counts).alias("n_values"),
        ))
    if counted is None:
        counted = with_classes(df, classes).agg(*mix_aggregates(classes))
    return counted.select(F.inline(F.array(*rows))).where("n_classes > 1")


def text_classes(columns, formats=DATE_FORMATS) -> dict:
    return {c: text_class(named(c), formats) for c in columns}


def mixed_types(df: DataFrame, columns, formats=DATE_FORMATS, counted: DataFrame | None = None) -> DataFrame:
    """Text columns that mix numbers, dates, booleans and other text."""
    return type_mix(df, text_classes(columns, formats), counted)


def mixed_type_findings(
    df: DataFrame, columns, formats=DATE_FORMATS, counted: DataFrame | None = None
) -> DataFrame:
    facts = mixed_types(df, columns, formats, counted)
    detail = F.concat_ws(
        ", ",
        *[F.when(F.col(f"n_{c}") > 0, F.concat(F.lit(f"{c} "), F.col(f"n_{c}").cast("string"))) for c in TYPE_CLASSES],
    )
    return column_findings(
        facts, "Q2", AGENT, "type_inconsistency", F.col("column"), F.col("n_values"), "MEDIUM", detail
    )


def casing_variants(df: DataFrame, status_columns, shown: int = 1000) -> DataFrame:
    """(column, lower_value, n_spellings, spellings, n_rows) where one word is spelled several ways.

    All spellings are counted; ``spellings`` lists the first ``shown`` of them, chosen before they are gathered, so a
    word of endless spellings makes no endless row.
    """
    counts = value_counts(df, status_columns).where(F.col("value").isNotNull()).withColumn("lower_value", F.lower("value"))
    word = Window.partitionBy("column", "lower_value")
    totals = counts.groupBy("column", "lower_value").agg(
        F.count("*").alias("n_spellings"), F.sum("n").alias("n_rows")).where(F.col("n_spellings") > 1)
    first = counts.select("column", "lower_value", "value", F.row_number().over(word.orderBy("value")).alias("rank")).where(
        F.col("rank") <= shown).groupBy("column", "lower_value").agg(
        F.array_sort(F.collect_list("value")).alias("spellings"))
    return totals.join(first, ["column", "lower_value"]).select(
        "column", "lower_value", "n_spellings", "spellings", "n_rows")


def casing_findings(df: DataFrame, status_columns, key: RowKey) -> DataFrame | None:
    parts = None
    for name in status_columns:
        more = F.when(F.col("n_spellings") > SHOWN_SPELLINGS, F.concat(
            F.lit(" (+"), (F.col("n_spellings") - SHOWN_SPELLINGS).cast("string"), F.lit(" more)")))
        groups = casing_variants(df, [name], SHOWN_SPELLINGS).select(
            value_digest(F.col("lower_value")).alias("__word"), F.col("n_rows").alias("__n_rows"),
            F.col("lower_value").alias("__lower"),
            F.concat(F.concat_ws(", ", "spellings"), F.coalesce(more, F.lit(""))).alias("__spellings"),
        )
        text = named(name).cast("string")
        rows = df.where(text.isNotNull()).select(
            *map(named, key.needed), value_digest(F.lower(text)).alias("__word"))
        part = member_findings(
            join_to_groups(rows, groups, ["__word"], "__n_rows", key.needed),
            key, "Q3", AGENT, "inconsistent_casing", [name],
            detail=F.col("__spellings"), group_key=F.col("__lower"),
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


def percentage_columns(df: DataFrame, roles: ColumnRoles) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if is_numeric(f)
        and (name_has(f.name, PERCENT_NAMES) or roles.types.get(f.name) == "percentage")
        and f.name not in roles.not_percent
    ]


def percentage_rules(df: DataFrame, roles: ColumnRoles) -> list[RowRule]:
    """Percentages below 0 or above 100."""
    return [
        RowRule(
            "Q4", AGENT, "invalid_percentage", (c,), (named(c) < 0) | (named(c) > 100), "MEDIUM", named(c)
        )
        for c in percentage_columns(df, roles)
    ]
