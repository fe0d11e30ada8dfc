"""Checks of typed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlint.operators import anomalies, documents, duplicates, fuzzy, logic, quality, stale
from ledgerlint.operators.findings import RowKey, row_findings, rule_counts, summarise
from ledgerlint.queries.registry import (
    LINE_KEY, LINE_ROW, TRACKER_KEY, TRACKER_ROW, finding_sql, flat, query,
)
from ledgerlint.queries.views import (
    AS_OF, LINE_COST, LINE_STATUS, SHIPMENTS, TRACKER, table, view, with_views,
)
from ledgerlint.settings import ColumnRoles, Thresholds

# --- duplicates ------------------------------------------------------------------------------


def totals_sql(source: str, columns: str) -> str:
    return (
        "SELECT count(*) AS n_groups, CAST(coalesce(sum(members), 0) AS BIGINT) AS n_members, "
        "CAST(coalesce(sum(members - 1), 0) AS BIGINT) AS n_excess, "
        "CAST(coalesce(sum(members), 0) // 2 AS BIGINT) AS halved_count FROM "
        f"(SELECT count(*) AS members FROM {source} GROUP BY {columns} HAVING count(*) > 1) g"
    )


@query("D1_exact_duplicates", totals_sql("documents", "text"))
def exact_duplicates(spark, folder):
    return duplicates.duplicate_totals(table(spark, folder, "documents"), ["text"])


# Times that agree to the millisecond but not beyond, and equal times.
MICROSECONDS = """SELECT doc_id, 1577836800000000 + doc_id % 50 AS micros, doc_id % 3 AS part FROM documents"""


@query("D1_microsecond_times", f"""
SELECT count(*) AS n_groups, sum(m) AS n_members, sum(m - 1) AS n_excess, floor(sum(m) / 2) AS halved_count
FROM (SELECT micros, part, count(*) AS m FROM ({MICROSECONDS}) GROUP BY 1, 2 HAVING count(*) > 1) g""")
def microsecond_times(spark, folder):
    documents = table(spark, folder, "documents")
    times = documents.select(
        F.timestamp_micros(F.lit(1577836800000000) + F.col("doc_id") % 50).alias("seen"), (F.col("doc_id") % 3).alias("part"))
    return duplicates.duplicate_totals(times.withColumn("local", F.col("seen").cast("timestamp_ntz")))


@query("D1_nested_values", """
SELECT count(*) AS n_groups, sum(m) AS n_members, sum(m - 1) AS n_excess, floor(sum(m) / 2) AS halved_count
FROM (SELECT doc_id % 20 // 2 AS k, count(*) AS m FROM documents GROUP BY 1 HAVING count(*) > 1) g""")
def nested_values(spark, folder):
    """Rows 2k and 2k + 1 differ only in how zero and a missing number are written, inside arrays and structs."""
    documents = table(spark, folder, "documents")
    odd = F.col("doc_id") % 2 == 1
    zero = F.when(odd, F.lit(-0.0)).otherwise(F.lit(0.0))
    nothing = F.when(odd, F.lit(float("nan")))
    nested = F.array(F.struct(zero.alias("zero"), nothing.alias("nothing")))
    return duplicates.duplicate_totals(documents.select(
        F.floor(F.col("doc_id") % 20 / 2).alias("k"), nested.alias("nested"), F.array(zero, nothing).alias("numbers")))


@query("D1_exact_duplicate_rows", """
SELECT CAST(doc_id AS VARCHAR) AS row_key, CAST(members AS VARCHAR) AS detail
FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS members FROM documents) d WHERE members > 1""")
def exact_duplicate_rows(spark, folder):
    documents = table(spark, folder, "documents")
    found = duplicates.exact_duplicates(documents, RowKey(("doc_id",), "doc_id"), ["text"])
    return found.select("row_key", "detail")


@query("D2_duplicate_keys", totals_sql("lineitem", "l_orderkey, l_linenumber"))
def duplicate_keys(spark, folder):
    return duplicates.duplicate_totals(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("D2_duplicate_key_rows", f"""
SELECT {LINE_ROW} AS row_key, CAST(members AS VARCHAR) AS detail, 'D2' AS check_id,
  'l_orderkey,l_linenumber' AS columns
FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS members FROM lineitem) l WHERE members > 1""")
def duplicate_key_rows(spark, folder):
    lines = table(spark, folder, "lineitem")
    found = duplicates.duplicate_keys(lines, ["l_orderkey", "l_linenumber"], LINE_KEY)
    return found.select("row_key", "detail", "check_id", F.concat_ws(",", "columns").alias("columns"))


@query("D2_null_keys_are_equal", with_views(totals_sql("tracker", "status, phase"), tracker=TRACKER))
def null_keys(spark, folder):
    return duplicates.duplicate_totals(view(spark, folder, TRACKER), ["status", "phase"])


VALUES_SQL = "SELECT lower({c}) AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1"


def edit_pairs_sql(source: str, column: str) -> str:
    values = VALUES_SQL.format(c=column, t=source)
    return (
        f"WITH v AS ({values}) SELECT a.value AS value_a, b.value AS value_b, "
        "CAST(levenshtein(a.value, b.value) AS INT) AS score, a.n AS n_a, b.n AS n_b FROM v a JOIN v b "
        "ON a.value < b.value AND levenshtein(a.value, b.value) <= "
        "floor(greatest(length(a.value), length(b.value)) * 0.12)"
    )


@query("D3_edit_distance_names", edit_pairs_sql("part", "p_name"))
def edit_distance_names(spark, folder):
    return fuzzy.near_pairs(fuzzy.distinct_values(table(spark, folder, "part"), "p_name"), fuzzy.Edits())


@query("D3_edit_distance_urls", edit_pairs_sql("pages", "url"))
def edit_distance_urls(spark, folder):
    return fuzzy.near_pairs(fuzzy.distinct_values(table(spark, folder, "pages"), "url"), fuzzy.Edits())


# Longest common subsequence by rows of the usual table, one row per character of the first value.
LCS_PAIRS_SQL = """
WITH RECURSIVE v AS ({values}),
pairs AS (SELECT a.value AS value_a, b.value AS value_b, a.n AS n_a, b.n AS n_b FROM v a JOIN v b
  ON a.value < b.value
  AND abs(length(a.value) - length(b.value)) <= 0.125 * (length(a.value) + length(b.value)) + 0.000001),
steps AS (
  SELECT value_a, value_b, n_a, n_b, 0 AS i, [CAST(0 AS INT) FOR x IN range(length(value_b) + 1)] AS best FROM pairs
  UNION ALL
  SELECT value_a, value_b, n_a, n_b, i + 1, list_reduce(
    [[CASE WHEN substr(value_a, i + 1, 1) = substr(value_b, CAST(j AS INT), 1)
      THEN best[CAST(j AS INT)] + 1 ELSE best[CAST(j AS INT) + 1] END] FOR j IN range(1, length(value_b) + 1)],
    lambda done, cell: list_append(done, greatest(done[len(done)], cell[1])), [CAST(0 AS INT)])
  FROM steps WHERE i < length(value_a)
),
scored AS (
  SELECT value_a, value_b, n_a, n_b,
    CAST(round_even(best[length(value_b) + 1] * 200.0 / (length(value_a) + length(value_b)), 0) AS INT) AS score
  FROM steps WHERE i = length(value_a)
)
"""


def lcs_pairs_sql(source: str, column: str) -> str:
    return LCS_PAIRS_SQL.format(values=VALUES_SQL.format(c=column, t=source))


@query("D3_indel_names", lcs_pairs_sql("part", "p_name") + "SELECT * FROM scored WHERE score >= 88 AND score < 100")
def indel_names(spark, folder):
    return fuzzy.near_pairs(fuzzy.distinct_values(table(spark, folder, "part"), "p_name"))


@query("D3_indel_totals", lcs_pairs_sql("part", "p_name") + """
SELECT CAST(coalesce(sum(n_a * n_b), 0) AS BIGINT) AS n_row_pairs, count(*) AS n_value_pairs
FROM scored WHERE score >= 88 AND score < 100""")
def indel_totals(spark, folder):
    return fuzzy.near_duplicate_totals(table(spark, folder, "part"), "p_name")


@query("D3_near_duplicate_rows", lcs_pairs_sql("part", "p_name") + """
SELECT CAST(p_partkey AS VARCHAR) AS row_key, CAST(partners AS VARCHAR) AS detail
FROM part JOIN (
  SELECT value, count(*) AS partners FROM (
    SELECT value_a AS value FROM scored WHERE score >= 88 AND score < 100
    UNION ALL SELECT value_b FROM scored WHERE score >= 88 AND score < 100
  ) p GROUP BY value
) n ON lower(p_name) = n.value""")
def near_duplicate_rows(spark, folder):
    parts = table(spark, folder, "part")
    return fuzzy.near_duplicates(parts, "p_name", RowKey(("p_partkey",), "p_partkey")).select("row_key", "detail")


@query("D3_indel_urls", lcs_pairs_sql("pages", "url") + "SELECT * FROM scored WHERE score >= 88 AND score < 100")
def indel_urls(spark, folder):
    return fuzzy.near_pairs(fuzzy.distinct_values(table(spark, folder, "pages"), "url"))


# Words of the documents: values without a template, most of which the index of pieces tells apart.
LONG_WORDS = """SELECT lower(word) AS value, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(text, '[A-Za-z]{10,}')) AS word FROM documents) w GROUP BY 1"""


@query("D3_edit_distance_words", f"""
WITH v AS ({LONG_WORDS})
SELECT a.value AS value_a, b.value AS value_b, CAST(levenshtein(a.value, b.value) AS INT) AS score, a.n AS n_a, b.n AS n_b
FROM v a JOIN v b ON a.value < b.value AND abs(length(a.value) - length(b.value)) <= 2
  AND levenshtein(a.value, b.value) <= floor(greatest(length(a.value), length(b.value)) * 0.12)""")
def edit_distance_words(spark, folder):
    words = F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{10,})"), F.lit(1)))
    values = fuzzy.distinct_values(table(spark, folder, "documents").select(words.alias("word")), "word")
    return fuzzy.near_pairs(values, fuzzy.Edits(), few=0)


@query("D3_near_duplicate_documents", r"""
WITH v AS (SELECT row_number() OVER () AS i, text, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w
  FROM (SELECT DISTINCT lower(text) AS text FROM documents WHERE text IS NOT NULL) t),
s AS (SELECT DISTINCT i, array_to_string(w[p:p + 4], ' ') AS shingle
  FROM (SELECT i, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM v WHERE len(w) > 0)),
n AS (SELECT i, count(*) AS size FROM s GROUP BY i),
shared AS (SELECT a.i AS a, b.i AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.i < b.i GROUP BY 1, 2),
near AS (SELECT a, b FROM shared JOIN n x ON x.i = a JOIN n y ON y.i = b WHERE common >= 0.75 * (x.size + y.size - common)),
partners AS (SELECT i, count(*) AS partners FROM (SELECT a AS i FROM near UNION ALL SELECT b FROM near) u GROUP BY i)
SELECT CAST(doc_id AS VARCHAR) AS row_key, CAST(partners AS VARCHAR) AS detail
FROM documents JOIN v ON lower(documents.text) = v.text JOIN partners USING (i)""")
def near_duplicate_documents(spark, folder):
    found = fuzzy.near_duplicates(
        table(spark, folder, "documents"), "text", RowKey(("doc_id",), "doc_id"), documents.Shingles())
    return found.select("row_key", "detail")


# --- quality ---------------------------------------------------------------------------------

NULLABLE = ("status", "due_date", "end_date", "actual_cost", "completion_pct", "phase", "feedback", "notes", "budget")
NULL_DENSITY = """
SELECT "column", null_count, null_pct, severity, description FROM (
  SELECT "column", null_count, round_even(null_count * 100.0 / n, 2) AS null_pct,
    CASE WHEN null_count > 0.5 * n THEN 'HIGH' WHEN null_count > 0.2 * n THEN 'MEDIUM'
      WHEN null_count > 0.05 * n THEN 'LOW' END AS severity,
    CASE WHEN null_count = n THEN 'Completely empty column' WHEN null_count > 0.5 * n THEN '>50% nulls'
      WHEN null_count > 0.2 * n THEN '20-50% nulls' ELSE '5-20% nulls' END AS description
  FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) - count({c}) AS null_count, count(*) AS n FROM tracker" for c in NULLABLE
) + ") c) d WHERE severity IS NOT NULL"


@query("Q1_null_density", with_views(NULL_DENSITY, tracker=TRACKER))
def null_density(spark, folder):
    return quality.null_density(view(spark, folder, TRACKER), NULLABLE)


def severity_of(c: str) -> str:
    return f"(SELECT severity FROM d WHERE d.\"column\" = '{c}')"


@query("Q1_null_rows", with_views(" UNION ALL ".join(
    finding_sql("Q1", "null_values", c, "tracker", f"{c} IS NULL AND {severity_of(c)} IS NOT NULL",
                TRACKER_ROW, severity_of(c))
    for c in ("status", "actual_cost", "phase", "feedback")
), tracker=TRACKER, d=NULL_DENSITY))
def null_rows(spark, folder):
    tracker = view(spark, folder, TRACKER)
    flagged = quality.null_density(tracker, ["status", "actual_cost", "phase", "feedback"]).collect()
    return flat(row_findings(tracker, quality.null_rules(flagged), TRACKER_KEY))


def _class_sql(c: str) -> str:
    return (
        f"CASE WHEN TRY_CAST({c} AS DOUBLE) IS NOT NULL THEN 'number' "
        f"WHEN try_strptime({c}, '%Y-%m-%d') IS NOT NULL THEN 'date' "
        f"WHEN lower({c}) IN ('true', 'false') THEN 'boolean' WHEN {c} IS NOT NULL THEN 'text' END"
    )


MIXED = ("notes", "status", "start_date", "due_date", "feedback")


@query("Q2_mixed_types", with_views("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, "
    + ", ".join(f"count(*) FILTER (WHERE k = '{k}') AS n_{k}" for k in ("number", "date", "boolean", "text", "nested"))
    + f", CAST(count(DISTINCT k) AS INT) AS n_classes, count(k) AS n_values "
    f"FROM (SELECT {_class_sql(c)} AS k FROM tracker) t" for c in MIXED
) + ") r WHERE n_classes > 1", tracker=TRACKER))
def mixed_types(spark, folder):
    return quality.mixed_types(view(spark, folder, TRACKER), MIXED)


CASING = """SELECT lower(status) AS lower_value, count(DISTINCT status) AS n_spellings, count(*) AS n_rows,
  string_agg(DISTINCT status, ', ' ORDER BY status) AS spellings
FROM tracker WHERE status IS NOT NULL GROUP BY 1 HAVING count(DISTINCT status) > 1"""


@query("Q3_casing_variants", with_views(CASING, tracker=TRACKER))
def casing_variants(spark, folder):
    return quality.casing_variants(view(spark, folder, TRACKER), ["status"]).select(
        "lower_value", "n_spellings", "n_rows", F.concat_ws(", ", "spellings").alias("spellings")
    )


@query("Q3_casing_rows", with_views(f"""
SELECT 'Q3' AS check_id, 'inconsistent_casing' AS finding_type, 'status' AS columns, {TRACKER_ROW} AS row_key,
  'MEDIUM' AS severity, spellings AS detail
FROM tracker JOIN variants ON lower(status) = lower_value""", tracker=TRACKER, variants=CASING))
def casing_rows(spark, folder):
    return flat(quality.casing_findings(view(spark, folder, TRACKER), ["status"], TRACKER_KEY), with_detail=True)


@query("Q4_invalid_percentages", with_views(
    finding_sql("Q4", "invalid_percentage", "completion_pct", "line_status",
                "completion_pct < 0 OR completion_pct > 100", LINE_ROW), line_status=LINE_STATUS))
def invalid_percentages(spark, folder):
    lines = view(spark, folder, LINE_STATUS)
    return flat(row_findings(lines, quality.percentage_rules(lines, ColumnRoles()), LINE_KEY))


# --- business logic --------------------------------------------------------------------------


@query("L1_date_order", with_views(
    finding_sql("L1", "date_pair_violation", "o_orderdate,l_shipdate", "shipments", "l_shipdate <= o_orderdate",
                LINE_ROW, "HIGH"), shipments=SHIPMENTS))
def date_order(spark, folder):
    lines = view(spark, folder, SHIPMENTS)
    return flat(row_findings(lines, logic.date_order_rules(lines, [("o_orderdate", "l_shipdate")], ()), LINE_KEY))


@query("L1_date_order_text", with_views(
    finding_sql("L1", "date_pair_violation", "start_date,due_date", "tracker",
                "try_strptime(due_date, '%Y-%m-%d') <= try_strptime(start_date, '%Y-%m-%d')", TRACKER_ROW, "HIGH"),
    tracker=TRACKER))
def date_order_text(spark, folder):
    tracker = view(spark, folder, TRACKER)
    rules = logic.date_order_rules(tracker, [("start_date", "due_date")], ("yyyy-MM-dd",))
    return flat(row_findings(tracker, rules, TRACKER_KEY))


@query("L2_negative_amounts", finding_sql(
    "L2", "negative_amount", "c_acctbal", "customer", "c_acctbal < 0", "CAST(c_custkey AS VARCHAR)", "HIGH",
    ", CAST(c_acctbal AS VARCHAR) AS detail"))
def negative_amounts(spark, folder):
    customers = table(spark, folder, "customer")
    rules = logic.negative_amount_rules(customers, ["c_acctbal"])
    return flat(row_findings(customers, rules, RowKey(("c_custkey",), "c_custkey")), with_detail=True)


@query("L3_over_budget", with_views(
    finding_sql("L3", "over_budget", "actual_cost,budget", "line_cost", "actual_cost > budget", LINE_ROW),
    line_cost=LINE_COST))
def over_budget(spark, folder):
    lines = view(spark, folder, LINE_COST)
    return flat(row_findings(lines, logic.over_budget_rules(lines, "actual_cost", "budget"), LINE_KEY))


@query("L4_status_percentage", with_views(
    finding_sql("L4", "status_pct_mismatch", "status,completion_pct", "line_status",
                "lower(status) IN ('done', 'completed') AND completion_pct < 100", LINE_ROW), line_status=LINE_STATUS))
def status_percentage(spark, folder):
    lines = view(spark, folder, LINE_STATUS)
    rules = logic.status_percentage_rules(lines, ColumnRoles({"status": "status"}))
    return flat(row_findings(lines, rules, LINE_KEY))


TWO_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy")


@query("L5_date_formats", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS column, 'yyyy-MM-dd' AS format, count(try_strptime({c}, '%Y-%m-%d')) AS n_rows FROM tracker "
    f"UNION ALL SELECT '{c}', 'dd/MM/yyyy', count(try_strptime({c}, '%d/%m/%Y')) FROM tracker "
    f"UNION ALL SELECT '{c}', 'unreadable', count(*) FILTER (WHERE {c} IS NOT NULL "
    f"AND try_strptime({c}, '%Y-%m-%d') IS NULL AND try_strptime({c}, '%d/%m/%Y') IS NULL) FROM tracker"
    for c in ("start_date", "due_date", "notes")
), tracker=TRACKER))
def date_formats(spark, folder):
    return logic.date_format_audit(view(spark, folder, TRACKER), ["start_date", "due_date", "notes"], TWO_FORMATS)


@query("L5_unreadable_dates", with_views(
    finding_sql("L5", "invalid_date_format", "start_date", "tracker",
                "start_date IS NOT NULL AND try_strptime(start_date, '%Y-%m-%d') IS NULL", TRACKER_ROW,
                extra=", start_date AS detail"), tracker=TRACKER))
def unreadable_dates(spark, folder):
    tracker = view(spark, folder, TRACKER)
    rules = logic.date_format_rules(tracker, ["start_date"], ("yyyy-MM-dd",))
    return flat(row_findings(tracker, rules, TRACKER_KEY), with_detail=True)


# --- anomalies -------------------------------------------------------------------------------


def limits_sql(source: str, c: str) -> str:
    return (
        f"SELECT '{c}' AS column, count({c}) AS n, avg({c}) AS m, stddev_pop({c}) AS sd, "
        f"quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source}"
    )


def outlier_sql(source: str, c: str) -> str:
    z = f"abs(({c} - m) / nullif(sd, 0))"
    fence = f"({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))"
    return (
        f"SELECT '{c}' AS column, any_value(n) AS n_values, count(*) FILTER (WHERE {z} > 2.5) AS n_z, "
        f"count(*) FILTER (WHERE {fence}) AS n_iqr, "
        f"count(*) FILTER (WHERE {z} > 2.5 OR {fence}) AS n_outliers, round(max({z}), 6) AS max_z, "
        f"CASE WHEN max({z}) > 4 THEN 'HIGH' ELSE 'MEDIUM' END AS severity "
        f"FROM {source}, ({limits_sql(source, c)}) limits"
    )


def outlier_totals(df, columns):
    facts = anomalies.column_limits(df, columns)
    return anomalies.outlier_facts(df, facts).withColumn("max_z", F.round("max_z", 6))


@query("A1_outliers", outlier_sql("events", "value"))
def outliers(spark, folder):
    return outlier_totals(table(spark, folder, "events"), ["value"])


@query("A1_outliers_of_all_columns", " UNION ALL ".join(
    outlier_sql("lineitem", c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
))
def outliers_of_all_columns(spark, folder):
    return outlier_totals(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("A1_outlier_rows", f"""
SELECT CAST(event_id AS VARCHAR) AS row_key, 'A1' AS check_id, 'outliers' AS finding_type, 'value' AS columns,
  CASE WHEN top > 4 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM (SELECT event_id, value, m, sd, q1, q3, max(abs((value - m) / nullif(sd, 0))) OVER () AS top
  FROM events, ({limits_sql('events', 'value')}) limits) e
WHERE abs((value - m) / nullif(sd, 0)) > 2.5
  OR value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def outlier_rows(spark, folder):
    events = table(spark, folder, "events")
    facts = anomalies.column_limits(events, ["value"])
    rules = anomalies.outlier_rules(facts, anomalies.outlier_severities(facts))
    return flat(row_findings(events, rules, RowKey(("event_id",), "event_id")))


@query("A2_outlier_severity", with_views("SELECT \"column\", max_z, severity FROM (" + " UNION ALL ".join(
    outlier_sql("tracker", c) for c in ("budget", "actual_cost", "effort_hours", "completion_pct")
) + ") o", tracker=TRACKER))
def outlier_severity(spark, folder):
    columns = ["budget", "actual_cost", "effort_hours", "completion_pct"]
    return outlier_totals(view(spark, folder, TRACKER), columns).select("column", "max_z", "severity")


def skew_sql(source: str, c: str) -> str:
    return (
        f"SELECT '{c}' AS column, count({c}) AS n_values, "
        f"round(avg(pow({c} - m, 3)) / pow(any_value(sd), 3), 6) AS skewness "
        f"FROM {source}, (SELECT avg({c}) AS m, stddev_pop({c}) AS sd FROM {source}) s"
    )


@query("A3_skewed_columns", with_views("SELECT * FROM (" + " UNION ALL ".join(
    skew_sql("tracker", c) for c in ("budget", "actual_cost", "effort_hours", "completion_pct")
) + ") s WHERE abs(skewness) > 3", tracker=TRACKER))
def skewed_columns(spark, folder):
    found = anomalies.skewed_columns(
        view(spark, folder, TRACKER), ["budget", "actual_cost", "effort_hours", "completion_pct"]
    )
    return found.withColumn("skewness", F.round("skewness", 6))


@query("A3_skew_with_limit", skew_sql("events", "value") + " HAVING abs(skewness) > 1.5")
def skew_with_limit(spark, folder):
    found = anomalies.skewed_columns(table(spark, folder, "events"), ["value"], Thresholds(skew=1.5))
    return found.withColumn("skewness", F.round("skewness", 6))


@query("A4_impossible_negatives", with_views(" UNION ALL ".join(
    finding_sql("A4", "impossible_negative", c, "tracker", f"{c} < 0", TRACKER_ROW)
    for c in ("item_count", "effort_hours")
), tracker=TRACKER))
def impossible_negatives(spark, folder):
    tracker = view(spark, folder, TRACKER)
    rules = anomalies.impossible_negative_rules(["budget", "item_count", "effort_hours"])
    return flat(row_findings(tracker, rules, TRACKER_KEY))


# --- stale records ---------------------------------------------------------------------------

NOT_DONE = "NOT coalesce(lower(status) IN ('done', 'completed', 'closed', 'resolved'), false)"
DONE = "coalesce(lower(status) IN ('done', 'completed', 'closed', 'resolved'), false)"
TODAY = f"DATE '{AS_OF.isoformat()}'"


def date_sql(c: str) -> str:
    return f"CAST(try_strptime({c}, '%Y-%m-%d') AS DATE)"


STALE_SQL = {
    "T2": finding_sql("T2", "overdue_tasks", "due_date,status", "tracker",
                      f"{NOT_DONE} AND {date_sql('due_date')} < {TODAY}", TRACKER_ROW),
    "T3": finding_sql("T3", "zombie_records", "updated_at,status", "tracker",
                      f"{NOT_DONE} AND {date_sql('updated_at')} < {TODAY} - 60", TRACKER_ROW),
    "T4": finding_sql("T4", "future_start_done", "start_date,status", "tracker",
                      f"{DONE} AND {date_sql('start_date')} > {TODAY}", TRACKER_ROW),
    "T5": finding_sql("T5", "long_running_tasks", "start_date,status", "tracker",
                      f"{NOT_DONE} AND {date_sql('start_date')} < {TODAY} - 90", TRACKER_ROW),
}
STALE_ROLES = ColumnRoles({"status": "status"})


def stale_rules(tracker, *checks):
    rules = stale.stale_rules(tracker, stale.stale_columns(tracker, STALE_ROLES), AS_OF)
    return [r for r in rules if r.check_id in checks]


@query("T1_missing_deadline", with_views(
    finding_sql("T1", "missing_deadline", "due_date", "tracker", f"{date_sql('due_date')} IS NULL AND "
                f"(SELECT count({date_sql('due_date')}) > 0.8 * count(*) FROM tracker)", TRACKER_ROW),
    tracker=TRACKER))
def missing_deadline(spark, folder):
    tracker = view(spark, folder, TRACKER)
    return flat(row_findings(tracker, stale.missing_deadline_rules(tracker, "due_date"), TRACKER_KEY))


def _register_stale(name, check_id):
    @query(name, with_views(STALE_SQL[check_id], tracker=TRACKER))
    def run(spark, folder):
        tracker = view(spark, folder, TRACKER)
        return flat(row_findings(tracker, stale_rules(tracker, check_id), TRACKER_KEY))


_register_stale("T2_overdue", "T2")
_register_stale("T3_zombies", "T3")
_register_stale("T4_future_start", "T4")
_register_stale("T5_long_running", "T5")


@query("T2_overdue_orders", finding_sql(
    "T2", "overdue_tasks", "o_orderdate,o_orderstatus", "orders",
    f"o_orderstatus <> 'F' AND o_orderdate < {TODAY}", "CAST(o_orderkey AS VARCHAR)"))
def overdue_orders(spark, folder):
    orders = table(spark, folder, "orders")
    columns = stale.StaleColumns(due="o_orderdate", status="o_orderstatus")
    rules = stale.stale_rules(orders, columns, AS_OF, done=("f",))
    return flat(row_findings(orders, rules, RowKey(("o_orderkey",), "o_orderkey")))


# --- all row rules together ------------------------------------------------------------------

ROW_RULES_SQL = {
    "Q4": finding_sql("Q4", "invalid_percentage", "completion_pct", "tracker",
                      "completion_pct < 0 OR completion_pct > 100", TRACKER_ROW),
    "L1": finding_sql("L1", "date_pair_violation", "start_date,due_date", "tracker",
                      f"{date_sql('due_date')} <= {date_sql('start_date')}", TRACKER_ROW, "HIGH"),
    "L2": finding_sql("L2", "negative_amount", "budget", "tracker", "budget < 0", TRACKER_ROW, "HIGH"),
    "L2b": finding_sql("L2", "negative_amount", "actual_cost", "tracker", "actual_cost < 0", TRACKER_ROW, "HIGH"),
    "L3": finding_sql("L3", "over_budget", "actual_cost,budget", "tracker", "actual_cost > budget", TRACKER_ROW),
    "L4": finding_sql("L4", "status_pct_mismatch", "status,completion_pct", "tracker",
                      "lower(status) IN ('done', 'completed') AND completion_pct < 100", TRACKER_ROW),
    "L5": finding_sql("L5", "invalid_date_format", "start_date", "tracker",
                      f"start_date IS NOT NULL AND {date_sql('start_date')} IS NULL", TRACKER_ROW),
    "A4": finding_sql("A4", "impossible_negative", "item_count", "tracker", "item_count < 0", TRACKER_ROW),
    **STALE_SQL,
}
ROW_FINDINGS_SQL = "\nUNION ALL\n".join(ROW_RULES_SQL.values())


def all_row_rules(tracker):
    roles = ColumnRoles({"status": "status", "completion_pct": "percentage"})
    return (
        quality.percentage_rules(tracker, roles)
        + logic.date_order_rules(tracker, [("start_date", "due_date")], ("yyyy-MM-dd",))
        + logic.negative_amount_rules(tracker)
        + logic.over_budget_rules(tracker, "actual_cost", "budget")
        + logic.status_percentage_rules(tracker, roles)
        + logic.date_format_rules(tracker, ["start_date"], ("yyyy-MM-dd",))
        + anomalies.impossible_negative_rules(["item_count"])
        + stale_rules(tracker, "T2", "T3", "T4", "T5")
    )


@query("row_rules_in_one_pass", with_views(ROW_FINDINGS_SQL, tracker=TRACKER))
def row_rules(spark, folder):
    tracker = view(spark, folder, TRACKER)
    return flat(row_findings(tracker, all_row_rules(tracker), TRACKER_KEY))


@query("row_rule_counts", with_views(
    "SELECT check_id, finding_type, columns, count(*) AS n_rows FROM f GROUP BY ALL",
    tracker=TRACKER, f=ROW_FINDINGS_SQL))
def row_rule_counts(spark, folder):
    tracker = view(spark, folder, TRACKER)
    return rule_counts(tracker, all_row_rules(tracker)).where("n_rows > 0")


@query("finding_summary", with_views("""
SELECT check_id, finding_type, columns, count(*) AS count, min(severity) AS severity,
  string_agg(row_key, ',' ORDER BY n) FILTER (WHERE n <= 100) AS affected_rows
FROM (SELECT *, row_number() OVER (PARTITION BY check_id, columns ORDER BY CAST(row_key AS BIGINT)) AS n FROM f) r
GROUP BY check_id, finding_type, columns""", tracker=TRACKER, f=ROW_FINDINGS_SQL))
def finding_summary(spark, folder):
    tracker = view(spark, folder, TRACKER)
    return summarise(row_findings(tracker, all_row_rules(tracker), TRACKER_KEY)).select(
        "check_id", "finding_type", F.concat_ws(",", "columns").alias("columns"), "count", "severity",
        F.concat_ws(",", "affected_rows").alias("affected_rows"),
    )
