"""Issues, scores and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlint.functions.values import nan_to_null, side_by_side
from ledgerlint.operators import anomalies, duplicates, issues as iss, profile, quality
from ledgerlint.operators.findings import RowKey, row_findings, summarise
from ledgerlint.operators.quantiles import exact_quantiles
from ledgerlint.operators.schema import infer_roles
from ledgerlint.operators.sheet_checks import sheet_issues
from ledgerlint.plans.audit import CheckContext, audit_file, audit_table, run_stats_totals
from ledgerlint.queries.check_queries import (
    CASING, NULL_DENSITY, NULLABLE, ROW_FINDINGS_SQL, ROW_RULES_SQL, _class_sql, all_row_rules, date_sql, outlier_sql,
    skew_sql, totals_sql,
)
from ledgerlint.queries.registry import LINE_KEY, TRACKER_KEY, query
from ledgerlint.queries.sheet_queries import ALL_ISSUES_SQL, NAMES, sheet_of, shown
from ledgerlint.queries.views import AS_OF, SHEET, TRACKER, table, view, with_views
from ledgerlint.session import scratch_path
from ledgerlint.settings import AGENTS, ColumnRoles

# --- the issues of the tracker, in Spark and in SQL ------------------------------------------

AGENT_SQL = (
    "CASE WHEN check_id LIKE 'D%' THEN 'duplicate_hunter' WHEN check_id LIKE 'Q%' THEN 'data_quality' "
    "WHEN check_id LIKE 'L%' THEN 'business_logic' WHEN check_id LIKE 'T%' THEN 'stale_records' "
    "ELSE 'anomaly_detector' END"
)
SUMMARY_SQL = f"""
SELECT check_id, {AGENT_SQL} AS agent, finding_type, columns, count(*) AS count, min(severity) AS severity
FROM f GROUP BY check_id, finding_type, columns
UNION ALL
SELECT 'Q1', 'data_quality', 'null_values', "column", null_count, severity FROM d"""
FIX_SQL = (
    "CASE agent WHEN 'duplicate_hunter' THEN 'Manual review needed.' WHEN 'data_quality' THEN 'Review quality issue.' "
    "WHEN 'business_logic' THEN 'Fix logic inconsistency.' WHEN 'anomaly_detector' THEN 'Review outlier distribution.' "
    "ELSE 'Review record status.' END"
)
CONFIDENCE_SQL = (
    "CAST(CASE agent WHEN 'duplicate_hunter' THEN 0.8 WHEN 'data_quality' THEN 0.8 WHEN 'business_logic' THEN 0.9 "
    "WHEN 'anomaly_detector' THEN 0.7 ELSE 0.85 END AS DOUBLE)"
)
ORDER_SQL = (
    "CASE agent WHEN 'duplicate_hunter' THEN '0' WHEN 'data_quality' THEN '1' WHEN 'business_logic' THEN '2' "
    "WHEN 'stale_records' THEN '3' ELSE '4' END"
)
ISSUES_SQL = f"""
SELECT sha256(concat_ws('|', check_id, columns)) AS issue_id, check_id, agent, 'System: ' || finding_type AS title,
  finding_type || ' in ' || replace(columns, ',', ', ') || ': ' || count || ' rows.' AS description, severity,
  columns AS affected_columns, {FIX_SQL} AS suggested_fix, count, {CONFIDENCE_SQL} AS confidence,
  concat_ws('|', {ORDER_SQL}, check_id, columns) AS seq
FROM summary"""
TRACKER_ISSUES = dict(
    tracker=TRACKER, f=ROW_FINDINGS_SQL, d=NULL_DENSITY, summary=SUMMARY_SQL, issues=ISSUES_SQL
)
SHEET_ISSUES = dict(sheet=SHEET, issues=ALL_ISSUES_SQL)
RANK_SQL = "CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END"


def tracker_summary(spark, folder):
    tracker = view(spark, folder, TRACKER)
    dense = quality.null_density(tracker, NULLABLE).collect()
    return summarise(row_findings(tracker, all_row_rules(tracker) + quality.null_rules(dense), TRACKER_KEY))


def tracker_issues(spark, folder):
    return iss.to_issues(tracker_summary(spark, folder))


def sheet_issues_of(spark, folder):
    return sheet_issues(sheet_of(spark, folder), AS_OF, NAMES)


def plain(issues):
    return issues.drop("affected_rows").withColumn("affected_columns", F.concat_ws(",", "affected_columns"))


@query("I1_default_issues", with_views("SELECT * FROM issues", **TRACKER_ISSUES))
def default_issues(spark, folder):
    return plain(tracker_issues(spark, folder))


@query("I2_enriched_issues", with_views("""
SELECT issue_id, check_id, agent, CASE WHEN severity = 'HIGH' THEN 'Reviewed ' || check_id ELSE title END AS title,
  description, CASE WHEN severity = 'HIGH' AND count < 1000 THEN 'MEDIUM' ELSE severity END AS severity,
  affected_columns,
  CASE WHEN severity = 'HIGH' THEN 'Check the source. Correct the rows' ELSE suggested_fix END AS suggested_fix,
  count, CASE WHEN severity = 'HIGH' THEN CAST(0.95 AS DOUBLE) ELSE confidence END AS confidence, seq
FROM issues""", **TRACKER_ISSUES))
def enriched_issues(spark, folder):
    summary = tracker_summary(spark, folder)
    reviewed = summary.where("severity = 'HIGH'").select(
        "check_id", "columns",
        F.concat(F.lit("Reviewed "), "check_id").alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.when(F.col("count") < 1000, "MEDIUM").alias("severity"),
        F.array(F.lit("Check the source"), F.lit("Correct the rows")).alias("suggested_fix"),
        F.lit(0.95).alias("confidence"),
    )
    return plain(iss.to_issues(summary, reviewed))


@query("I3_severity_policy", """
SELECT 'D2' AS check_id, n_members AS count,
  CASE WHEN n_members > 0.05 * (SELECT count(*) FROM lineitem) THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM (""" + totals_sql("lineitem", "l_orderkey, l_linenumber") + ") t")
def severity_policy(spark, folder):
    lines = table(spark, folder, "lineitem")
    found = summarise(duplicates.duplicate_keys(lines, ["l_orderkey", "l_linenumber"], LINE_KEY))
    return iss.severity_policy(found, F.lit(lines.count())).select("check_id", "count", "severity")


@query("I4_deduplicated_issues", with_views("SELECT * FROM issues", **TRACKER_ISSUES))
def deduplicated_issues(spark, folder):
    issues = tracker_issues(spark, folder)
    return plain(iss.dedupe(issues.unionByName(issues)))


@query("I4_one_issue_per_group", with_views("""
SELECT sha256(concat_ws('|', 'Q3', 'status', lower_value)) AS issue_id, 'status' AS affected_columns, n_rows AS count
FROM variants""", tracker=TRACKER, variants=CASING))
def one_issue_per_group(spark, folder):
    """The issues that a whole audit keeps of a check whose findings only their group tells apart."""
    tracker = view(spark, folder, TRACKER)
    roles = ColumnRoles({"status": "status"}, ("row_index",))
    result = audit_table(tracker, CheckContext(roles, TRACKER_KEY, AS_OF), scratch_path(spark, "groups"),
                         agents=("data_quality",))
    return result.issues.where("check_id = 'Q3'").select(
        "issue_id", F.concat_ws(",", "affected_columns").alias("affected_columns"), "count")


@query("I4_first_issue_per_title", with_views("""
SELECT * EXCLUDE (n) FROM (
  SELECT *, row_number() OVER (PARTITION BY agent, title ORDER BY seq, issue_id) AS n FROM issues) i
WHERE n = 1""", **SHEET_ISSUES))
def first_issue_per_title(spark, folder):
    return shown(iss.dedupe(sheet_issues_of(spark, folder), by_columns=False))


@query("I5_ranked_issues", with_views(f"SELECT *, {RANK_SQL} AS severity_rank FROM issues", **TRACKER_ISSUES))
def ranked_issues(spark, folder):
    return plain(iss.ranked(tracker_issues(spark, folder)))


COUNTS_SQL = """
SELECT count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium,
  count(*) FILTER (WHERE severity = 'LOW') AS low, count(*) AS total FROM issues"""


@query("I6_severity_counts", with_views(COUNTS_SQL, **SHEET_ISSUES))
def severity_counts(spark, folder):
    return iss.severity_counts(sheet_issues_of(spark, folder))


@query("I6_severity_by_agent", with_views("""
SELECT CASE WHEN grouping(agent) = 1 THEN 'ALL' ELSE agent END AS agent,
  CASE WHEN grouping(severity) = 1 THEN 'ALL' ELSE severity END AS severity, count(*) AS n_issues
FROM issues GROUP BY CUBE (agent, severity)""", **SHEET_ISSUES))
def severity_by_agent(spark, folder):
    return iss.severity_cube(sheet_issues_of(spark, folder))


FILE_SCORE_SQL = f"""
SELECT *, CAST(greatest(100 - least(12 * high, 55) - least(6 * medium, 30) - least(2 * low, 15), 0) AS INT)
  AS health_score FROM ({COUNTS_SQL}) c"""


@query("I7_file_health_score", with_views(FILE_SCORE_SQL, **TRACKER_ISSUES))
def file_health_score(spark, folder):
    return iss.file_health_score(tracker_issues(spark, folder))


@query("I8_sheet_health_score", with_views(f"""
SELECT *, CAST(trunc(greatest(CASE WHEN total > 0 THEN 15 ELSE 100 END,
  100 - (CAST(0.60 AS DECIMAL(4,2)) * high + CAST(0.15 AS DECIMAL(4,2)) * medium + CAST(0.05 AS DECIMAL(4,2)) * low)))
  AS INT) AS health_score FROM ({COUNTS_SQL}) c""", **SHEET_ISSUES))
def sheet_health_score(spark, folder):
    return iss.sheet_health_score(sheet_issues_of(spark, folder))


@query("I9_brief", with_views(f"""
SELECT {RANK_SQL} AS severity_rank, issue_id, agent, title, severity, count, confidence,
  substr(description, 1, 150) AS description
FROM issues ORDER BY severity_rank, confidence DESC, issue_id LIMIT 20""", **SHEET_ISSUES))
def brief(spark, folder):
    return iss.brief(sheet_issues_of(spark, folder))


@query("I10_top_priorities", with_views(f"""
SELECT CAST(n AS INT) AS priority,
  'Priority ' || n || ': [' || agent || '] ' || title || ' - ' || suggested_fix AS text
FROM (SELECT *, row_number() OVER (ORDER BY {RANK_SQL}, confidence DESC, issue_id) AS n FROM issues) i
WHERE n <= 3""", **TRACKER_ISSUES))
def top_priorities(spark, folder):
    return iss.top_priorities(tracker_issues(spark, folder))


@query("I10_executive_summary", with_views(f"""
SELECT *, CASE WHEN total = 0 THEN 'No issues detected. Dataset appears clean.'
  ELSE 'Data health score is ' || health_score || '/100. ' || total || ' issues found (HIGH: ' || high
    || ', MEDIUM: ' || medium || ', LOW: ' || low || ').' END AS summary
FROM ({FILE_SCORE_SQL}) s""", **TRACKER_ISSUES))
def executive_summary(spark, folder):
    return iss.executive_summary(iss.file_health_score(tracker_issues(spark, folder)))


@query("I11_issues_per_agent", with_views(
    "SELECT agent, count(*) AS n_issues FROM issues GROUP BY agent", **SHEET_ISSUES))
def issues_per_agent(spark, folder):
    return iss.issues_per_agent(sheet_issues_of(spark, folder))


@query("I12_search", with_views("""
SELECT issue_id, title, severity FROM issues
WHERE severity = 'MEDIUM' AND (contains(lower(title), 'blocked') OR contains(lower(description), 'blocked'))""",
                                **SHEET_ISSUES))
def search(spark, folder):
    return iss.search(sheet_issues_of(spark, folder), "MEDIUM", "Blocked").select("issue_id", "title", "severity")


@query("I12_search_all", with_views("""
SELECT issue_id, title, severity FROM issues
WHERE contains(lower(title), 'overdue') OR contains(lower(description), 'overdue')""", **SHEET_ISSUES))
def search_all(spark, folder):
    return iss.search(sheet_issues_of(spark, folder), "ALL", "OVERDUE").select("issue_id", "title", "severity")


@query("I13_severity_shares", with_views("""
SELECT severity, count(*) AS n_issues, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct
FROM issues GROUP BY severity""", **SHEET_ISSUES))
def severity_shares(spark, folder):
    return iss.severity_shares(sheet_issues_of(spark, folder)).withColumn("share_pct", F.round("share_pct", 6))


@query("I13_score_band", with_views(f"""
SELECT health_score, CASE WHEN health_score >= 80 THEN 'green' WHEN health_score >= 50 THEN 'amber' ELSE 'red' END
  AS band, 'Project Management' AS domain FROM ({FILE_SCORE_SQL}) s""", **TRACKER_ISSUES))
def score_band(spark, folder):
    return iss.file_health_score(tracker_issues(spark, folder)).select(
        "health_score",
        iss.score_band(F.col("health_score")).alias("band"),
        iss.domain_name(F.lit("project_management")).alias("domain"),
    )


@query("I13_row_previews", with_views("""
SELECT issue_id, CASE WHEN len(r) > 0 THEN array_to_string(r[1:5], ', ')
  || CASE WHEN count > 5 THEN ' (+' || (count - 5) || ' more)' ELSE '' END END AS preview
FROM (SELECT issue_id, count, string_split(affected_rows, ',') AS r FROM issues) i""", **SHEET_ISSUES))
def row_previews(spark, folder):
    return sheet_issues_of(spark, folder).select(
        "issue_id", iss.row_preview(F.col("affected_rows"), F.col("count")).alias("preview")
    )


# --- whole audits ----------------------------------------------------------------------------

TRACKER_ROLES = ColumnRoles(
    types={
        "row_index": "id", "task_id": "id", "contact": "email", "priority": "text", "status": "status",
        "start_date": "date", "due_date": "date", "end_date": "date", "updated_at": "date", "budget": "numeric",
        "actual_cost": "numeric", "completion_pct": "percentage", "item_count": "numeric",
        "effort_hours": "numeric", "phase": "text", "feedback": "text", "notes": "text",
    },
    key=("task_id",),
    date_pairs=(("start_date", "due_date"), ("start_date", "end_date")),
)
TEXT_COLUMNS = (
    "task_id", "contact", "priority", "status", "start_date", "due_date", "end_date", "updated_at", "phase",
    "feedback", "notes",
)
MEASURED = ("budget", "actual_cost", "completion_pct", "item_count", "effort_hours")
MIXED_SQL = " UNION ALL ".join(
    f"SELECT count(DISTINCT k) AS n FROM (SELECT {_class_sql(c)} AS k FROM tracker) t" for c in TEXT_COLUMNS
)
OUTLIERS_SQL = " UNION ALL ".join(
    f"SELECT n_outliers AS n FROM ({outlier_sql('tracker', c)}) o" for c in MEASURED
)
SKEW_SQL = " UNION ALL ".join(f"SELECT skewness AS s FROM ({skew_sql('tracker', c)}) o" for c in MEASURED)
RUN_SQL = f"""
SELECT 'duplicate_hunter' AS name, 'skipped' AS status, CAST(0 AS BIGINT) AS issue_count
UNION ALL
SELECT 'data_quality', 'done', (SELECT count(*) FROM d) + (SELECT count(*) FROM ({MIXED_SQL}) m WHERE n > 1)
  + (SELECT count(*) FROM ({CASING}) c) + (SELECT count(DISTINCT columns) FROM f WHERE check_id = 'Q4')
UNION ALL
SELECT 'business_logic', 'done', (SELECT count(DISTINCT (check_id, columns)) FROM f WHERE check_id LIKE 'L%')
UNION ALL
SELECT 'stale_records', 'done', (SELECT count(DISTINCT check_id) FROM f WHERE check_id LIKE 'T%')
  + (SELECT CAST(count(due_date) > 0.8 * count(*) AND count(due_date) < count(*) AS INT) FROM tracker)
UNION ALL
SELECT 'anomaly_detector', 'done', (SELECT count(*) FROM ({OUTLIERS_SQL}) o WHERE n > 0)
  + (SELECT count(*) FROM ({SKEW_SQL}) s WHERE abs(s) > 3) + (SELECT count(DISTINCT columns) FROM f WHERE check_id = 'A4')
"""
RUN_VIEWS = dict(tracker=TRACKER, f=ROW_FINDINGS_SQL, d=NULL_DENSITY)


def tracker_audit(spark, folder, agents):
    context = CheckContext(TRACKER_ROLES, TRACKER_KEY, AS_OF)
    return audit_table(view(spark, folder, TRACKER), context, scratch_path(spark, "audit"), agents)


FOUR = ("data_quality", "business_logic", "stale_records", "anomaly_detector")


@query("I14_run_stats", with_views(RUN_SQL, **RUN_VIEWS))
def run_stats(spark, folder):
    return tracker_audit(spark, folder, FOUR).run_stats.select("name", "status", "issue_count")


@query("I14_run_totals", with_views(f"""
SELECT count(*) FILTER (WHERE status = 'done') AS n_ran, CAST(0 AS BIGINT) AS n_failed,
  count(*) FILTER (WHERE status = 'skipped') AS n_skipped, CAST(sum(issue_count) AS BIGINT) AS n_issues
FROM ({RUN_SQL}) r""", **RUN_VIEWS))
def run_totals(spark, folder):
    return run_stats_totals(tracker_audit(spark, folder, FOUR).run_stats)


@query("tracker_audit")
def full_audit(spark, folder):
    """All five check families, duplicates and near-duplicates included, as ranked issues."""
    return plain(iss.ranked(tracker_audit(spark, folder, FOUR + ("duplicate_hunter",)).issues))


# --- whole audits against SQL ----------------------------------------------------------------

NEAR_COLUMNS = ("priority", "phase", "feedback", "notes")
#: An edit distance is never above the insertions and deletions, so it rules out most pairs before the long way.
NEAR_ROWS = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS columns, count(*) AS count FROM tracker WHERE lower({c}) IN (SELECT value FROM near_{c})" for c in NEAR_COLUMNS)


def near_views() -> dict:
    views = {}
    for c in NEAR_COLUMNS:
        views |= {
            f"v_{c}": f"SELECT DISTINCT lower({c}) AS value FROM tracker WHERE {c} IS NOT NULL AND {c} <> ''",
            f"p_{c}": f"SELECT a.value AS a, b.value AS b FROM v_{c} a JOIN v_{c} b ON a.value < b.value "
                      "AND levenshtein(a.value, b.value) <= floor(0.125 * (length(a.value) + length(b.value)) + 0.000001)",
            f"s_{c}": f"""
SELECT a, b, 0 AS i, [CAST(0 AS INT) FOR x IN range(length(b) + 1)] AS best FROM p_{c}
UNION ALL
SELECT a, b, i + 1, list_reduce(
  [[CASE WHEN substr(a, i + 1, 1) = substr(b, CAST(j AS INT), 1) THEN best[CAST(j AS INT)] + 1
    ELSE best[CAST(j AS INT) + 1] END] FOR j IN range(1, length(b) + 1)],
  lambda done, cell: list_append(done, greatest(done[len(done)], cell[1])), [CAST(0 AS INT)])
FROM s_{c} WHERE i < length(a)""",
            f"near_{c}": f"""
SELECT unnest([a, b]) AS value FROM s_{c} WHERE i = length(a)
  AND round_even(best[length(b) + 1] * 200.0 / (length(a) + length(b)), 0) BETWEEN 88 AND 99""",
        }
    return views


def whole_sql(texts, measured, duplicate="") -> str:
    """Every issue of an audit: check, columns, rows, severity."""
    parts = [
        "SELECT check_id, columns, count(*) AS count, min(severity) AS severity FROM f GROUP BY check_id, columns",
        "SELECT 'Q1', \"column\", null_count, severity FROM d",
        *[f"SELECT 'Q2', '{c}', count(k), 'MEDIUM' FROM (SELECT {_class_sql(c)} AS k FROM tracker) t HAVING count(DISTINCT k) > 1"
          for c in texts],
        "SELECT 'Q3', 'status', n_rows, 'MEDIUM' FROM variants",
        f"SELECT 'T1', 'due_date', n, 'MEDIUM' FROM (SELECT count(*) - count({date_sql('due_date')}) AS n, "
        f"count({date_sql('due_date')}) > 0.8 * count(*) AS filled FROM tracker) t WHERE filled AND n > 0",
        *[f"SELECT 'A1', '{c}', n_outliers, severity FROM ({outlier_sql('tracker', c)}) o WHERE n_outliers > 0" for c in measured],
        *[f"SELECT 'A3', '{c}', n_values, 'MEDIUM' FROM ({skew_sql('tracker', c)}) s WHERE abs(skewness) > 3" for c in measured],
        *([duplicate] if duplicate else []),
    ]
    return "SELECT check_id, columns, CAST(count AS BIGINT) AS count, severity FROM (" + "\nUNION ALL\n".join(parts) + ") w"


OWN_COLUMNS = ", ".join([*TEXT_COLUMNS, *MEASURED])
DUPLICATES_SQL = f"""
SELECT check_id, columns, n, CASE WHEN n > 0.05 * (SELECT count(*) FROM tracker) THEN 'HIGH' ELSE 'MEDIUM' END FROM (
  SELECT 'D2' AS check_id, 'task_id' AS columns, sum(m) AS n FROM (
    SELECT count(*) AS m FROM tracker GROUP BY task_id HAVING count(*) > 1) g
  UNION ALL SELECT 'D1', '', sum(m) FROM (
    SELECT count(*) AS m FROM tracker GROUP BY {OWN_COLUMNS} HAVING count(*) > 1) g
  UNION ALL SELECT 'D3', columns, count FROM near_rows) u WHERE n > 0"""
WHOLE_VIEWS = dict(
    tracker=TRACKER, f=ROW_FINDINGS_SQL, d=NULL_DENSITY, variants=CASING, **near_views(), near_rows=NEAR_ROWS,
    issues=whole_sql(TEXT_COLUMNS, MEASURED, DUPLICATES_SQL))


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def counted_issues(issues):
    return issues.select("check_id", F.concat_ws(",", "affected_columns").alias("columns"), "count", "severity")


@query("I14_whole_audit", recursive(with_views("SELECT * FROM issues", **WHOLE_VIEWS)))
def whole_audit(spark, folder):
    """All five families, duplicates and near-duplicates included: every issue with its rows and severity."""
    return counted_issues(tracker_audit(spark, folder, AGENTS).issues)


@query("I14_whole_score", recursive(with_views(
    f"SELECT *, CAST(0 AS BIGINT) AS n_failed FROM ({FILE_SCORE_SQL}) s", **WHOLE_VIEWS)))
def whole_score(spark, folder):
    return tracker_audit(spark, folder, AGENTS).health


ODD_NAMES = {"row_index": "row.no", "status": "task status", "due_date": "due.date", "budget": "unit.budget",
             "completion_pct": "done `pct"}
ODD_LABELS = "columns"
for _plain, _odd in ODD_NAMES.items():
    ODD_LABELS = f"replace({ODD_LABELS}, '{_plain}', '{_odd}')"


@query("I14_odd_column_names", with_views(
    f"SELECT check_id, {ODD_LABELS} AS columns, count, severity FROM issues",
    tracker=TRACKER, f="\nUNION ALL\n".join(ROW_RULES_SQL[c] for c in ("Q4", "L2", "L4", "T2")),
    d=f"SELECT * FROM ({NULL_DENSITY}) n WHERE \"column\" IN ('status', 'due_date', 'budget', 'completion_pct')",
    variants=CASING, issues=whole_sql(("status", "due_date"), ("budget", "completion_pct"))))
def odd_column_names(spark, folder):
    """A table whose names have dots, blanks and backticks: inferred, profiled, audited."""
    tracker = view(spark, folder, TRACKER)
    odd = tracker.select(*[F.col(c).alias(name) for c, name in ODD_NAMES.items()])
    context = CheckContext(infer_roles(odd), RowKey(("row.no",), "row.no"), AS_OF)
    return counted_issues(audit_table(odd, context, scratch_path(spark, "odd")).issues)


@query("I14_file_to_report", with_views(f"""
SELECT name, status, issue_count, (SELECT count(*) FROM tracker) AS rows, 'csv' AS file_type FROM ({RUN_SQL}) r""",
    **RUN_VIEWS))
def file_to_report(spark, folder):
    """A CSV file from the scan to the stored report: its run statistics and metadata."""
    path, out = scratch_path(spark, "tracker") + ".csv", scratch_path(spark, "report")
    view(spark, folder, TRACKER).write.option("header", True).option("escape", '"').csv(path)
    audit_file(spark, path, out, TRACKER_KEY, AS_OF, "project_management", TRACKER_ROLES, FOUR)
    report = spark.read.json(f"{out}/report")
    return report.select(F.inline("agent_statuses"), "metadata").select(
        "name", "status", "issue_count", F.col("metadata.rows").alias("rows"), F.col("metadata.file_type").alias("file_type"))


LINE_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINEITEM_AUDIT_SQL = """
WITH dup AS (SELECT count(*) AS members FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1),
facts AS (SELECT (SELECT count(*) FROM lineitem) AS n_rows,
  (SELECT CAST(coalesce(sum(members), 0) AS BIGINT) FROM dup) AS n_duplicate_rows),
outliers AS (""" + " UNION ALL ".join(outlier_sql("lineitem", c) for c in LINE_MEASURES) + """),
issues AS (
  SELECT CASE WHEN n_duplicate_rows > 0.05 * n_rows THEN 'HIGH' ELSE 'MEDIUM' END AS severity
  FROM facts WHERE n_duplicate_rows > 0
  UNION ALL SELECT severity FROM outliers WHERE n_outliers > 0
)
SELECT n_rows, n_duplicate_rows, (SELECT CAST(sum(n_outliers) AS BIGINT) FROM outliers) AS n_outliers,
  (SELECT round(avg(l_extendedprice), 6) FROM lineitem) AS mean_price, high, medium, low, total, health_score,
  CASE WHEN health_score >= 80 THEN 'green' WHEN health_score >= 50 THEN 'amber' ELSE 'red' END AS score_band
FROM facts, (""" + FILE_SCORE_SQL + ") s"


@query("lineitem_audit", LINEITEM_AUDIT_SQL)
def lineitem_audit(spark, folder):
    """Which defects does lineitem have, and how healthy is it? One row."""
    lines = table(spark, folder, "lineitem")
    limits = anomalies.column_limits(lines, LINE_MEASURES)
    outliers = anomalies.outlier_facts(lines, limits)
    doubles = duplicates.duplicate_totals(lines, ["l_orderkey", "l_linenumber"])
    n_rows = lines.count()
    duplicate_issue = doubles.where("n_members > 0").select(
        duplicates.duplicate_severity(F.col("n_members"), F.lit(n_rows)).alias("severity")
    )
    issues = duplicate_issue.unionByName(outliers.where("n_outliers > 0").select("severity"))
    price = limits["l_extendedprice"]["mean"]
    return side_by_side(
        iss.file_health_score(issues),
        doubles.select(F.col("n_members").alias("n_duplicate_rows")),
        outliers.agg(F.sum("n_outliers").alias("n_outliers")),
    ).select(
        F.lit(n_rows).cast("bigint").alias("n_rows"), "n_duplicate_rows", "n_outliers",
        F.round(nan_to_null(F.lit(price)), 6).alias("mean_price"), "high", "medium", "low", "total",
        "health_score", iss.score_band(F.col("health_score")).alias("score_band"),
    )


@query("lineitem_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std_pop, "
    f"min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 6) AS q1, "
    f"round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3 FROM lineitem"
    for c in LINE_MEASURES
))
def lineitem_profile(spark, folder):
    """Moments, extremes and exact quartiles of the numeric columns in one fused aggregate."""
    lines = table(spark, folder, "lineitem")
    facts = profile.numeric_stats(lines, LINE_MEASURES)
    quartiles = exact_quantiles(lines, LINE_MEASURES, [0.25, 0.5, 0.75])
    known = F.create_map(*[x for c in LINE_MEASURES for x in (F.lit(c), F.array(*[F.lit(q) for q in quartiles[c]]))])
    at = known[F.col("column")]
    return facts.select(
        "column", "count", F.round("mean", 6).alias("mean"), F.round("std_pop", 6).alias("std_pop"), "min", "max",
        F.round(at[0], 6).alias("q1"), F.round(at[1], 6).alias("median"), F.round(at[2], 6).alias("q3"),
    )
