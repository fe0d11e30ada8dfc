"""Sources and sinks. The files are written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlint.functions.values import side_by_side
from ledgerlint.operators import issues as iss
from ledgerlint.operators.actions import apply_patches
from ledgerlint.operators.quality import type_mix, variant_class
from ledgerlint.operators.sheet_checks import sheet_issues
from ledgerlint.queries.action_queries import actions_of, fold_sql, patched_sql
from ledgerlint.queries.issue_queries import (
    FILE_SCORE_SQL, TRACKER_ISSUES, plain, tracker_issues,
)
from ledgerlint.queries.registry import query
from ledgerlint.queries.sheet_queries import ALL_ISSUES_SQL, DATA_COLUMNS, NAMES, sheet_of
from ledgerlint.queries.views import ACTIONS, AS_OF, ISO_DATE, SHEET, table, view, with_views
from ledgerlint.session import scratch_path, stored
from ledgerlint.sinks import tables as sink
from ledgerlint.sources import files, sheets

# --- files -----------------------------------------------------------------------------------

ORDER_FILE = f"""
SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 10 = 0 THEN 'N/A' ELSE o_orderstatus END AS status,
  {ISO_DATE} AS o_orderdate, o_orderkey % 2 = 0 AS is_even,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Café, "bar"' ELSE o_orderpriority END AS note,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey * 2 END AS sparse
FROM {{orders}}"""


@query("SRC1_csv", with_views("""
SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN status = 'N/A' THEN NULL ELSE status END AS status,
  o_orderdate, is_even, note, sparse FROM file""", file=ORDER_FILE))
def csv_scan(spark, folder):
    path = scratch_path(spark, "orders") + ".csv"
    view(spark, folder, ORDER_FILE).write.option("header", True).option("escape", '"').csv(path)
    return files.read_records(spark, path)


@query("SRC1_latin1_csv", with_views("""
SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN status = 'N/A' THEN NULL ELSE status END AS status,
  o_orderdate, is_even, note, sparse FROM file""", file=ORDER_FILE))
def latin1_csv_scan(spark, folder):
    path = scratch_path(spark, "orders") + ".csv"
    writer = view(spark, folder, ORDER_FILE).write.option("header", True).option("escape", '"')
    writer.option("encoding", "ISO-8859-1").csv(path)
    return files.read_records(spark, path)


@query("SRC2_json", "SELECT * FROM customer")
def json_scan(spark, folder):
    path = scratch_path(spark, "customer") + ".jsonl"
    customers = table(spark, folder, "customer")
    customers.write.json(path)
    return files.read_json(spark, path).select(*customers.columns).withColumn(
        "c_nationkey", F.col("c_nationkey").cast("int")
    )


MIXED_RECORD = """
SELECT o_orderkey,
  CASE o_orderkey % 4 WHEN 0 THEN '{' || '"id": ' || CAST(o_orderkey AS STRING) || ', "v": ' || CAST(o_custkey AS STRING) || '}'
    WHEN 1 THEN '{' || '"id": ' || CAST(o_orderkey AS STRING) || ', "v": "' || o_orderstatus || '"}'
    WHEN 2 THEN '{' || '"id": ' || CAST(o_orderkey AS STRING) || ', "v": true}'
    ELSE '{' || '"id": ' || CAST(o_orderkey AS STRING) || ', "v": null}' END AS record
FROM orders"""


@query("SRC2_mixed_json", f"""
SELECT 'v' AS "column", count(*) FILTER (WHERE json_type(record, '$.v') = 'UBIGINT') AS n_number,
  CAST(0 AS BIGINT) AS n_date, count(*) FILTER (WHERE json_type(record, '$.v') = 'BOOLEAN') AS n_boolean,
  count(*) FILTER (WHERE json_type(record, '$.v') = 'VARCHAR') AS n_text, CAST(0 AS BIGINT) AS n_nested,
  CAST(3 AS INT) AS n_classes, count(*) FILTER (WHERE json_type(record, '$.v') <> 'NULL') AS n_values
FROM ({MIXED_RECORD}) r""")
def mixed_json_scan(spark, folder):
    """Fields keep their own type per record; the mixed-type check then finds the mix."""
    path = scratch_path(spark, "mixed") + ".jsonl"
    k = F.col("o_orderkey") % 4
    key = F.col("o_orderkey").cast("string")
    value = (
        F.when(k == 0, F.col("o_custkey").cast("string"))
        .when(k == 1, F.concat(F.lit('"'), "o_orderstatus", F.lit('"')))
        .when(k == 2, "true")
        .otherwise("null")
    )
    record = F.concat(F.lit('{"id": '), key, F.lit(', "v": '), value, F.lit("}"))
    table(spark, folder, "orders").select(record.alias("value")).write.text(path)
    records = files.read_json(spark, path, variant=True)
    return type_mix(records, {c: variant_class(F.col(c)) for c in records.columns})


LINE_COLUMNS = (
    "l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,"
    "l_linestatus,l_shipdate"
)


@query("SRC3_metadata", f"""
SELECT 'lineitem' AS filename, count(*) AS rows, '{LINE_COLUMNS}' AS columns, 'parquet' AS file_type FROM lineitem""")
def metadata(spark, folder):
    return files.dataset_metadata(table(spark, folder, "lineitem"), "lineitem", "parquet").drop("size_kb")


PAGE_ROWS = 500
COLUMN_IDS = {"task_name": 101, "status": 102, "budget_usd": 103, "notes": 104}


@query("SRC4_sheet", with_views("""
SELECT row_id, row_number, task_name, status,
  CASE WHEN row_id % 3 = 0 THEN CAST(row_number AS VARCHAR) ELSE budget_usd END AS budget_usd,
  CASE WHEN row_id % 5 = 0 THEN '{"a":' || row_number || '}' ELSE coalesce(notes, '') END AS notes,
  CASE WHEN row_id % 7 = 0 THEN 'extra' END AS "Unknown_999"
FROM sheet""", sheet=SHEET))
def sheet_scan(spark, folder):
    """Pages of nested cells: shown value before stored value, unlisted columns, rows without id."""
    def cell(column_id, stored, shown_value):
        return F.concat(
            F.lit(f'{{"columnId": {column_id}, "rowId": '), F.col("row_id").cast("string"),
            F.lit(', "value": '), stored, F.lit(', "displayValue": '), shown_value, F.lit("}"),
        )

    def quoted(column):
        return F.coalesce(F.concat(F.lit('"'), column, F.lit('"')), F.lit("null"))

    null, number = F.lit("null"), F.col("row_number").cast("string")
    third, fifth = F.col("row_id") % 3 == 0, F.col("row_id") % 5 == 0
    cells = F.concat_ws(
        ", ",
        cell(101, quoted(F.col("task_name")), quoted(F.col("task_name"))),
        cell(102, quoted(F.col("status")), null),
        cell(103, number, F.when(third, null).otherwise(quoted(F.col("budget_usd")))),
        cell(104, F.when(fifth, F.concat(F.lit('{"a": '), number, F.lit("}"))).otherwise(quoted(F.col("notes"))),
             F.when(fifth, null).otherwise(quoted(F.col("notes")))),
        F.when(F.col("row_id") % 7 == 0, cell(999, F.lit('"extra"'), null)),
    )
    row = F.concat(
        F.lit('{"id": '), F.when(F.col("row_id") % 4 == 0, "null").otherwise(F.col("row_id").cast("string")),
        F.lit(', "rowNumber": '), number, F.lit(', "cells": ['), cells, F.lit("]}"),
    )
    columns = ", ".join(
        f'{{"id": {i}, "title": "{t}", "type": "TEXT_NUMBER", "primary": false}}' for t, i in COLUMN_IDS.items()
    )
    pages = (
        sheet_of(spark, folder)
        .groupBy(F.floor(F.col("row_number") / PAGE_ROWS).alias("page"))
        .agg(F.concat_ws(", ", F.collect_list(row)).alias("rows"))
        .select(F.concat(
            F.lit(f'{{"id": 7, "name": "Tracker", "columns": [{columns}], "rows": ['), "rows", F.lit("]}")
        ).alias("value"))
    )
    path = scratch_path(spark, "sheet") + ".jsonl"
    pages.write.text(path)
    return sheets.read_sheet(spark, path)


@query("SRC5_snapshot", with_views("SELECT row_id, row_number, " + ", ".join(
    f"CASE WHEN {c} IN ('', '—', 'N/A', 'None', 'null') THEN NULL ELSE {c} END AS {c}" for c in DATA_COLUMNS
) + " FROM sheet", sheet=SHEET))
def snapshot(spark, folder):
    """The sheet as CSV files in row order: positions and missing words come back from the scan."""
    path = scratch_path(spark, "snapshot") + ".csv"
    ordered = sheet_of(spark, folder).repartitionByRange(6, "row_number").sortWithinPartitions("row_number")
    (
        ordered.select(*DATA_COLUMNS).write.option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
    return files.read_csv_snapshot(spark, path)


@query("SRC5_snapshot_two_encodings", with_views(
    "SELECT row_id, row_number, 'é' || row_number AS accent FROM sheet", sheet=SHEET))
def snapshot_two_encodings(spark, folder):
    """The first half of the sheet in a UTF-8 file, the second in a Latin-1 file: positions run through both."""
    path = scratch_path(spark, "encodings")
    rows = sheet_of(spark, folder).select("row_number", F.concat(F.lit("é"), F.col("row_number").cast("string")).alias("accent"))
    middle = rows.agg(F.avg("row_number")).first()[0]
    for part, encoding, own in (("1", "UTF-8", F.col("row_number") <= middle), ("2", "ISO-8859-1", F.col("row_number") > middle)):
        half = rows.where(own).repartitionByRange(2, "row_number").sortWithinPartitions("row_number")
        half.select("accent").write.option("header", True).option("encoding", encoding).csv(f"{path}/{part}")
    return files.read_csv_snapshot(spark, f"{path}/*")


CELL_COLUMNS = ("task_name", "status", "budget_usd", "completion_pct", "notes")


@query("SRC6_cells", with_views(" UNION ALL ".join(
    f"SELECT row_id, row_number, CAST({100 + i} AS BIGINT) AS column_id, '{c}' AS title, nullif({c}, '') AS value, "
    f"coalesce({c}, '') AS display_value FROM sheet" for i, c in enumerate(CELL_COLUMNS)
), sheet=SHEET))
def cells(spark, folder):
    return sheets.rows_to_cells(sheet_of(spark, folder).select("row_id", "row_number", *CELL_COLUMNS))


@query("SRC6_cells_and_back", with_views("SELECT row_id, row_number, " + ", ".join(
    f"nullif({c}, '') AS {c}" for c in CELL_COLUMNS) + " FROM sheet", sheet=SHEET))
def cells_and_back(spark, folder):
    long = sheets.rows_to_cells(sheet_of(spark, folder).select("row_id", "row_number", *CELL_COLUMNS))
    return sheets.cells_to_rows(long, CELL_COLUMNS)


# --- sinks -----------------------------------------------------------------------------------

HEADER = ("task_id", "status", "notes", "budget_usd", "not in the sheet")


@query("SNK1_corrected_csv", with_views(
    f"SELECT {', '.join('coalesce(' + c + ', ' + chr(39) * 2 + ') AS ' + c for c in HEADER[:4])}, "
    f"'' AS \"not in the sheet\" FROM ({patched_sql()}) p", sheet=SHEET, acts=ACTIONS, **fold_sql("acts")))
def corrected_csv(spark, folder):
    path = f"{scratch_path(spark, 'corrected')}-{sink.safe_file_name('Q2 tracker – äé')}"
    fixed = apply_patches(sheet_of(spark, folder), actions_of(spark, folder), "row_id", DATA_COLUMNS)
    sink.write_corrected_csv(fixed, HEADER, path)
    return files.read_csv_text(spark, path).na.fill("")


@query("SNK2_audit_table", with_views(f"""
SELECT issue_id AS "Issue ID", severity AS "Severity", agent AS "Agent", title AS "Title",
  description AS "Description", replace(affected_rows, ',', ', ') AS "Affected Rows",
  suggested_fix AS "Suggested Fix", CASE WHEN severity = 'LOW' THEN 'Resolved' ELSE 'Open' END AS "Status",
  'AUDIT REPORT - Tracker - {AS_OF}' AS audit_name, '{AS_OF}' AS run_date
FROM issues""", sheet=SHEET, issues=ALL_ISSUES_SQL))
def audit_sheet_table(spark, folder):
    path = scratch_path(spark, "audit_table")
    issues = sheet_issues(sheet_of(spark, folder), AS_OF, NAMES)
    sink.write_audit_table(issues, path, "Tracker", str(AS_OF), F.col("severity") == "LOW")
    return spark.read.parquet(path).withColumn("run_date", F.col("run_date").cast("string"))


@query("SNK3_comments", with_views("""
SELECT target_row_id AS row_id, proposed_value AS comment,
  CASE WHEN target_row_id IS NULL OR trim(coalesce(proposed_value, '')) = '' THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN target_row_id IS NULL THEN 'a comment needs a row'
    WHEN trim(coalesce(proposed_value, '')) = '' THEN 'a comment needs text'
  END AS error,
  CASE WHEN target_row_id IS NOT NULL AND trim(coalesce(proposed_value, '')) <> ''
    THEN substr(proposed_value, 1, 50) END AS echo
FROM acts""", acts=ACTIONS))
def comments(spark, folder):
    proposed = actions_of(spark, folder).selectExpr("target_row_id AS row_id", "proposed_value AS comment")
    return sink.append_comments(proposed, scratch_path(spark, "row_comments"))


@query("SNK3_stored_comments", with_views("""
SELECT target_row_id AS row_id, proposed_value AS comment FROM acts
WHERE target_row_id IS NOT NULL AND trim(coalesce(proposed_value, '')) <> ''""", acts=ACTIONS))
def stored_comments(spark, folder):
    path = scratch_path(spark, "row_comments")
    proposed = actions_of(spark, folder).selectExpr("target_row_id AS row_id", "proposed_value AS comment")
    sink.append_comments(proposed, path)
    return spark.read.parquet(path)


@query("SNK4_cell_updates", with_views("""
SELECT row_id, row_number, task_name,
  coalesce(u.v, status) AS status, coalesce(n.v, notes) AS notes
FROM sheet LEFT JOIN (SELECT target_row_id AS r, arg_max(coalesce(proposed_value, ''), seq) AS v FROM acts
    WHERE lower(column_title) = 'status' GROUP BY 1) u ON u.r = row_id
  LEFT JOIN (SELECT target_row_id AS r, arg_max(coalesce(proposed_value, ''), seq) AS v FROM acts
    WHERE lower(column_title) = 'notes' GROUP BY 1) n ON n.r = row_id""", sheet=SHEET, acts=ACTIONS))
def cell_updates(spark, folder):
    sheet = sheet_of(spark, folder).select("row_id", "row_number", "task_name", "status", "notes")
    updates = actions_of(spark, folder).selectExpr(
        "seq", "target_row_id AS row_id", "column_title AS column", "proposed_value AS new_value"
    ).where("row_id is not null and column is not null")
    return sink.update_cells(sheet, updates, "row_id")


@query("SNK4_partition_updates", with_views("""
SELECT row_id, CASE WHEN status = 'Blocked' AND row_id % 7 = 0 THEN 'checked' ELSE notes END AS notes,
  status, status IS NOT DISTINCT FROM 'Blocked' AS rewritten FROM sheet""", sheet=SHEET))
def partition_updates(spark, folder):
    """Cells of a table that is stored by status: only the partitions with an updated row are written again."""
    path = scratch_path(spark, "by_status")
    sheet = sheet_of(spark, folder).select("row_id", "notes", "status")
    sheet.withColumn("part", F.coalesce("status", F.lit("none"))).write.partitionBy("part").parquet(path)
    before = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file")).distinct()
    before = stored(before.withColumn("old", F.lit(True)), "files")
    updates = sheet.where("status = 'Blocked' AND row_id % 7 = 0").select(
        F.lit(1).alias("seq"), "row_id", F.lit("notes").alias("column"), F.lit("checked").alias("new_value"))
    sink.update_stored_cells(spark, path, updates, "row_id", "part")
    rows = spark.read.parquet(path).select("row_id", "notes", "status", F.col("_metadata.file_path").alias("file"))
    return rows.join(before, "file", "left").select("row_id", "notes", "status", F.col("old").isNull().alias("rewritten"))


@query("SNK5_cell_flags", with_views("""
SELECT row_id, 'due_date' AS "column", 'unreadable: ' || due_date AS note FROM sheet
WHERE try_strptime(due_date, '%Y-%m-%d') IS NULL""", sheet=SHEET))
def cell_flags(spark, folder):
    path = scratch_path(spark, "cell_flags")
    sheet = sheet_of(spark, folder)
    unreadable = sheet.where(F.try_to_date("due_date", "yyyy-MM-dd").isNull())
    sink.append_cell_flags(unreadable.select(
        "row_id", F.lit("due_date").alias("column"), F.concat(F.lit("unreadable: "), "due_date").alias("note")
    ), path)
    return spark.read.parquet(path)


@query("SNK6_report", with_views(f"""
SELECT health_score, 'Project Management' AS domain, high, medium, low,
  CAST((SELECT count(*) FROM tracker) AS BIGINT) AS rows, CAST(3 AS INT) AS n_priorities, CAST(least(total, 20) AS INT) AS n_top_issues,
  total AS n_stored_issues, CASE WHEN health_score >= 80 THEN 'green' WHEN health_score >= 50 THEN 'amber' ELSE 'red'
  END AS score_band FROM ({FILE_SCORE_SQL}) s""", **TRACKER_ISSUES))
def report_document(spark, folder):
    path = scratch_path(spark, "report")
    issues = tracker_issues(spark, folder)
    issues.write.parquet(f"{path}/kept")
    issues = spark.read.parquet(f"{path}/kept")
    stats = issues.groupBy("agent").agg(F.count("*").alias("issue_count")).select(
        F.col("agent").alias("name"), F.lit("done").alias("status"), F.lit(1).alias("duration_ms"), "issue_count"
    )
    meta = files.dataset_metadata(table(spark, folder, "orders"), "orders", "parquet")
    document = iss.report(issues, stats, meta, "project_management", f"{AS_OF}T00:00:00")
    sink.write_report(document, plain(issues), path)
    stored = spark.read.json(f"{path}/issues").agg(F.count("*").alias("n_stored_issues"))
    document = spark.read.json(f"{path}/report").select(
        F.col("health_score").cast("int").alias("health_score"), "domain",
        F.col("total_issues_by_severity.HIGH").alias("high"),
        F.col("total_issues_by_severity.MEDIUM").alias("medium"),
        F.col("total_issues_by_severity.LOW").alias("low"),
        F.col("metadata.rows").alias("rows"),
        F.size("top_priorities").alias("n_priorities"), F.size("top_issues").alias("n_top_issues"), "score_band",
    )
    return side_by_side(document, stored)
