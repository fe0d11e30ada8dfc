"""Profiles, semantic types, keys."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import functions as F

from ledgerlint.operators import profile, profile_state, schema
from ledgerlint.operators.quantiles import exact_quantiles
from ledgerlint.queries.registry import query
from ledgerlint.queries.views import TRACKER, table, view, with_views
from ledgerlint.session import stored

LINEITEM = (
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
)
TRACKER_COLUMNS = (
    "row_index", "task_id", "contact", "priority", "status", "start_date", "due_date", "end_date", "updated_at",
    "budget", "actual_cost", "completion_pct", "item_count", "effort_hours", "phase", "feedback", "notes",
)


# What the name rules say about some of the tracker's columns.
FILE_TYPES = (
    ("task_id", "id"), ("contact", "text"), ("priority", "text"), ("status", "status"), ("start_date", "date"),
    ("due_date", "date"), ("budget", "numeric"), ("actual_cost", "numeric"), ("completion_pct", "percentage"),
    ("item_count", "numeric"), ("phase", "text"),
)
SHEET_TYPES = (
    ("task_id", "text"), ("contact", "text"), ("priority", "picklist"), ("status", "picklist"), ("start_date", "date"),
    ("due_date", "date"), ("budget", "numeric"), ("actual_cost", "numeric"), ("item_count", "text"), ("phase", "text"),
)


def union_all(parts) -> str:
    return "\nUNION ALL\n".join(parts)


@query("PRF1_column_stats", union_all(
    f"SELECT '{c}' AS column, '{t}' AS dtype, count(*) AS n_rows, count(*) - count({c}) AS null_count, "
    f"round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct, count(DISTINCT {c}) AS distinct_count "
    "FROM lineitem" for c, t in LINEITEM
))
def column_stats(spark, folder):
    return profile.column_stats(table(spark, folder, "lineitem")).withColumn("null_pct", F.round("null_pct", 6))


@query("PRF1_nulls_and_distincts", with_views(union_all(
    f"SELECT '{c}' AS column, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count FROM tracker"
    for c in TRACKER_COLUMNS
), tracker=TRACKER))
def nulls_and_distincts(spark, folder):
    return profile.column_stats(view(spark, folder, TRACKER)).select("column", "null_count", "distinct_count")


SAMPLED = ("status", "due_date", "phase", "feedback", "notes", "end_date", "item_count")


@query("PRF1_samples", with_views(union_all(
    f"(SELECT '{c}' AS column, row_number() OVER (ORDER BY row_index) - 1 AS position, "
    f"CAST({c} AS VARCHAR) AS value FROM tracker WHERE {c} IS NOT NULL ORDER BY row_index LIMIT 5)" for c in SAMPLED
), tracker=TRACKER))
def samples(spark, folder):
    return profile.column_samples(view(spark, folder, TRACKER), "row_index", SAMPLED).withColumn(
        "position", F.col("position").cast("bigint")
    )


MEASURES_OF_STATE = ("l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag")


@query("PRF1_merged_profile", union_all(
    f"SELECT '{c}' AS column, count(*) AS n_rows, count(*) - count({c}) AS null_count, {low} AS min, {high} AS max, {mean} AS mean, "
    f"{std} AS std, {skew} AS skewness, true AS distinct_is_near, true AS median_is_near FROM lineitem"
    for c, low, high, mean, std, skew in [
        *[(c, f"min({c})", f"max({c})", f"round(avg({c}), 6)", f"round(stddev_samp({c}), 6)",
           f"round(avg(pow({c} - (SELECT avg({c}) FROM lineitem), 3)) / pow(stddev_pop({c}), 3), 4)")
          for c in ("l_quantity", "l_extendedprice")],
        *[(c, *["CAST(NULL AS DOUBLE)"] * 5) for c in ("l_shipdate", "l_returnflag")]]))
def merged_profile(spark, folder):
    """States of the parts of lineitem, one part added later, read off together; estimates held against exact figures."""
    lines = table(spark, folder, "lineitem")
    origin = profile_state.origins(lines, MEASURES_OF_STATE)
    old = lines.where("l_linenumber < 4")
    store = profile_state.accumulate(old, MEASURES_OF_STATE, origin, part=F.col("l_linenumber")).drop("part")
    added = profile_state.accumulate(lines.where("l_linenumber >= 4"), MEASURES_OF_STATE, origin)
    found = profile_state.profile(profile_state.combine([stored(store, "states"), stored(added, "states")]), (0.5,))
    exact = profile.column_stats(lines, MEASURES_OF_STATE).select("column", "distinct_count")
    median = F.col("quantiles")[0]
    around = exact_quantiles(lines, ("l_quantity", "l_extendedprice"), (0.48, 0.52))
    ranks = spark.createDataFrame(list(around.items()), "column string, around array<double>")
    return found.join(exact, "column").join(ranks, "column", "left").select(
        "column", "n_rows", "null_count", "min", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"),
        F.round("skewness", 4).alias("skewness"),
        (F.abs(F.col("distinct_estimate") - F.col("distinct_count")) <= 0.03 * F.col("distinct_count") + 1).alias("distinct_is_near"),
        (median.isNull() | median.between(F.col("around")[0], F.col("around")[1])).alias("median_is_near"))


@query("PRF4_merged_top_values", """
SELECT 'p_type' AS column, p_type AS value, count(*) AS n FROM part GROUP BY 2
UNION ALL SELECT 'p_name', p_name, count(*) FROM part GROUP BY 2""")
def merged_top_values(spark, folder):
    """Frequent values of parts that were profiled apart: all of them where no part had more than a state keeps."""
    parts = table(spark, folder, "part")
    states = profile_state.accumulate(parts, ("p_type", "p_name"), part=F.col("p_size") % 7, top=1000).drop("part")
    return profile_state.profile(profile_state.combine(states, 1000)).select("column", F.inline("top"))


KEY_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_returnflag")
KEY_SETS = [s for size in (1, 2, 3) for s in combinations(KEY_COLUMNS, size)]


@query("SCH3_composite_keys", "WITH k AS (" + union_all(
    f"SELECT [{', '.join(repr(c) for c in s)}] AS c, count(*) AS n_rows, "
    f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(s)} FROM lineitem) d) AS n FROM lineitem" for s in KEY_SETS
) + """), keys AS (SELECT * FROM k WHERE n = n_rows)
SELECT array_to_string(c, ',') AS columns, n_rows FROM keys a
WHERE NOT EXISTS (SELECT 1 FROM keys b WHERE len(b.c) < len(a.c) AND list_has_all(a.c, b.c))""")
def composite_keys(spark, folder):
    found = schema.minimal_keys(table(spark, folder, "lineitem"), KEY_COLUMNS)
    return found.select(F.concat_ws(",", "columns").alias("columns"), "n_rows")


MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("PRF2_numeric_stats", union_all(
    f"SELECT '{c}' AS column, count({c}) AS count, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean, "
    f"round(stddev_samp({c}), 6) AS std FROM lineitem" for c in MEASURES
))
def numeric_stats(spark, folder):
    return profile.numeric_stats(table(spark, folder, "lineitem"), MEASURES).select(
        "column", "count", "min", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")
    )


TRACKER_TEXT = ("task_id", "status", "start_date", "due_date", "end_date", "updated_at", "notes")


@query("PRF3_date_columns", with_views("SELECT * FROM (" + union_all(
    f"SELECT '{c}' AS column, count({c}) AS n_values, count(try_strptime({c}, '%Y-%m-%d')) AS n_dates, "
    f"round(count(try_strptime({c}, '%Y-%m-%d')) * 1.0 / nullif(count({c}), 0), 6) AS date_ratio FROM tracker"
    for c in TRACKER_TEXT
) + ") r WHERE n_values > 0 AND date_ratio >= 0.9", tracker=TRACKER))
def date_columns(spark, folder):
    found = profile.detect_date_columns(view(spark, folder, TRACKER), columns=TRACKER_TEXT, min_ratio=0.9)
    return found.withColumn("date_ratio", F.round("date_ratio", 6))


@query("PRF4_value_distribution", """
SELECT 'p_name' AS column, p_name AS value, count(*) AS n FROM part
GROUP BY p_name ORDER BY n DESC, p_name LIMIT 10""")
def value_distribution(spark, folder):
    return profile.value_distribution(table(spark, folder, "part"), "p_name")


PAIRS = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1:]]


@query("PRF5_correlations", "SELECT column_a, column_b, round(r, 6) AS correlation, CASE WHEN abs(r) > 0.7 "
       "THEN 'Strong' WHEN abs(r) > 0.3 THEN 'Moderate' ELSE 'Weak' END AS interpretation FROM (" + union_all(
           f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM lineitem" for a, b in PAIRS
       ) + ") c")
def correlations(spark, folder):
    return profile.correlations(table(spark, folder, "lineitem"), MEASURES).withColumn(
        "correlation", F.round("correlation", 6)
    )


TRACKER_PAIRS = [("budget", "actual_cost"), ("completion_pct", "effort_hours"), ("budget", "item_count")]


@query("PRF5_correlations_with_nulls", with_views(
    "SELECT column_a, column_b, round(r, 6) AS correlation, CASE WHEN abs(r) > 0.7 THEN 'Strong' "
    "WHEN abs(r) > 0.3 THEN 'Moderate' ELSE 'Weak' END AS interpretation FROM (" + union_all(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM tracker" for a, b in TRACKER_PAIRS
    ) + ") c", tracker=TRACKER))
def correlations_with_nulls(spark, folder):
    return profile.correlations(view(spark, folder, TRACKER), pairs=TRACKER_PAIRS).withColumn(
        "correlation", F.round("correlation", 6)
    )


def _evidence_sql(c: str) -> str:
    text = f"CAST({c} AS VARCHAR)"
    number = f"TRY_CAST({text} AS DOUBLE)"
    return (
        f"SELECT '{c}' AS column, count({c}) AS n_values, count(DISTINCT {c}) AS n_distinct, "
        f"count(try_strptime({text}, '%Y-%m-%d')) * 1.0 / nullif(count({c}), 0) AS date_ratio, "
        f"count({number}) * 1.0 / nullif(count({c}), 0) AS number_ratio, "
        f"count(*) FILTER (WHERE {number} BETWEEN 0 AND 100) * 1.0 / nullif(count({c}), 0) AS percent_ratio, "
        f"count(*) FILTER (WHERE regexp_matches({text}, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) * 1.0 "
        f"/ nullif(count({c}), 0) AS email_ratio, "
        f"count(DISTINCT {c}) * 1.0 / nullif(count({c}), 0) AS distinct_ratio FROM tracker"
    )


@query("SCH1_semantic_types", with_views("""
SELECT "column", n_values, n_distinct, round(date_ratio, 6) AS date_ratio, round(number_ratio, 6) AS number_ratio,
  round(percent_ratio, 6) AS percent_ratio, round(email_ratio, 6) AS email_ratio,
  round(distinct_ratio, 6) AS distinct_ratio,
  CASE WHEN n_values = 0 THEN 'text' WHEN date_ratio >= 0.8 THEN 'date' WHEN email_ratio >= 0.8 THEN 'email'
    WHEN number_ratio >= 0.8 AND ("column" LIKE '%pct%' OR "column" LIKE '%percent%') THEN 'percentage'
    WHEN number_ratio >= 0.8 AND ("column" LIKE '%id' OR "column" LIKE '%key') THEN 'id'
    WHEN number_ratio >= 0.8 THEN 'numeric'
    WHEN "column" LIKE '%status%' THEN 'status'
    WHEN distinct_ratio >= 0.9 AND ("column" LIKE '%id' OR "column" LIKE '%key') THEN 'id'
    WHEN "column" LIKE '%name%' THEN 'name' ELSE 'text' END AS semantic_type
FROM (""" + union_all(_evidence_sql(c) for c in TRACKER_COLUMNS) + ") e", tracker=TRACKER))
def semantic_types(spark, folder):
    found = schema.semantic_types(view(spark, folder, TRACKER)).drop("spark_type")
    ratios = [c for c in found.columns if c.endswith("_ratio")]
    return found.withColumns({c: F.round(c, 6) for c in ratios})


@query("SCH1_status_of_many_spellings", """
SELECT 'order_status' AS column, count(*) AS n_values, count(DISTINCT o_orderstatus || '-' || o_orderkey % 40) AS n_distinct,
  'status' AS semantic_type FROM orders""")
def status_of_many_spellings(spark, folder):
    orders = table(spark, folder, "orders")
    status = F.concat_ws("-", "o_orderstatus", (F.col("o_orderkey") % 40).cast("string"))
    found = schema.semantic_types(orders.select(status.alias("order_status")))
    return found.select("column", "n_values", "n_distinct", "semantic_type")


@query("SCH1_file_name_rules", with_views("SELECT * FROM (" + union_all(
    f"SELECT '{c}' AS column, '{t}' AS by_name, count({c}) AS n_values FROM tracker" for c, t in FILE_TYPES
) + ") t", tracker=TRACKER))
def file_name_rules(spark, folder):
    return _by_name(view(spark, folder, TRACKER), FILE_TYPES, schema.FILE_NAME_RULES)


@query("SCH1_sheet_name_rules", with_views("SELECT * FROM (" + union_all(
    f"SELECT '{c}' AS column, '{t}' AS by_name, count({c}) AS n_values FROM tracker" for c, t in SHEET_TYPES
) + ") t", tracker=TRACKER))
def sheet_name_rules(spark, folder):
    return _by_name(view(spark, folder, TRACKER), SHEET_TYPES, schema.SHEET_NAME_RULES)


def _by_name(tracker, expected, rules):
    """Every column with its type by name and its number of values."""
    parts = [
        tracker.agg(F.count(c).alias("n_values")).select(
            F.lit(c).alias("column"),
            F.lit(schema.type_by_name(c, schema.is_numeric(tracker.schema[c]), rules)).alias("by_name"), "n_values")
        for c, _ in expected
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("SCH2_date_pairs", with_views("""
SELECT * FROM (
  SELECT 'start_date' AS start_column, 'due_date' AS end_column, count(o) AS n_rows,
    round(avg(CAST(o AS INT)), 6) AS ordered_ratio
  FROM (SELECT try_strptime(start_date, '%Y-%m-%d') <= try_strptime(due_date, '%Y-%m-%d') AS o FROM tracker) a
  UNION ALL
  SELECT 'start_date', 'end_date', count(o), round(avg(CAST(o AS INT)), 6)
  FROM (SELECT try_strptime(start_date, '%Y-%m-%d') <= try_strptime(end_date, '%Y-%m-%d') AS o FROM tracker) b
) r WHERE ordered_ratio > 0.5""", tracker=TRACKER))
def date_pairs(spark, folder):
    tracker = view(spark, folder, TRACKER)
    found = schema.date_pairs(tracker, ["start_date", "due_date", "end_date", "updated_at"])
    return found.withColumn("ordered_ratio", F.round("ordered_ratio", 6))


@query("SCH3_key_candidates", with_views("SELECT * FROM (" + union_all(
    f"SELECT '{c}' AS column, CASE WHEN count(DISTINCT {c}) = count(*) THEN count(*) END AS n_rows FROM tracker"
    for c in TRACKER_COLUMNS
) + ") r WHERE n_rows IS NOT NULL", tracker=TRACKER))
def key_candidates(spark, folder):
    return schema.key_candidates(view(spark, folder, TRACKER)).select("column", "n_rows")
