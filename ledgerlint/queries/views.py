"""Defective tables derived from the given ones.

The given tables are clean, so the checks run on views that damage them by fixed arithmetic on the
key. Every row of the source table is in the view. The text of a view is plain SQL that Spark and
the SQL check both understand.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

AS_OF = dt.date(2001, 8, 1)

ISO_DATE = "CAST(CAST(o_orderdate AS DATE) AS STRING)"

# A table of tasks with typed columns, one row per order.
TRACKER = f"""
SELECT
  o_orderkey AS row_index,
  'TSK-' || CAST(CASE WHEN o_orderkey % 41 = 40 THEN o_orderkey - 1 ELSE o_orderkey END AS STRING) AS task_id,
  'user' || CAST(o_custkey AS STRING) || '@example.com' AS contact,
  o_orderpriority AS priority,
  CASE o_orderkey % 9
    WHEN 0 THEN 'Done' WHEN 1 THEN 'done' WHEN 2 THEN 'DONE' WHEN 3 THEN 'In Progress'
    WHEN 4 THEN 'in progress' WHEN 5 THEN 'Blocked' WHEN 6 THEN NULL WHEN 7 THEN 'Completed'
    ELSE 'Not Started' END AS status,
  CASE WHEN o_orderkey % 53 = 5
    THEN substr({ISO_DATE}, 9, 2) || '/' || substr({ISO_DATE}, 6, 2) || '/' || substr({ISO_DATE}, 1, 4)
    WHEN o_orderkey % 70 = 9 THEN '2002-02-01'
    ELSE {ISO_DATE} END AS start_date,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL
    ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 - 3 AS INT) AS STRING) END AS due_date,
  CAST(NULL AS STRING) AS end_date,
  CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 AS INT) AS STRING) AS updated_at,
  CASE WHEN o_orderkey % 97 = 11 THEN -o_totalprice ELSE o_totalprice END AS budget,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_totalprice * (0.5 + (o_orderkey % 7) * 0.1) END AS actual_cost,
  CASE WHEN o_orderkey % 31 = 4 THEN CAST(150 AS DOUBLE) WHEN o_orderkey % 31 = 5 THEN CAST(-20 AS DOUBLE)
    WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) END AS completion_pct,
  CASE WHEN o_orderkey % 89 = 3 THEN -(o_orderkey % 50) - 1 ELSE o_orderkey % 50 END AS item_count,
  CASE WHEN o_orderkey % 500 = 7 THEN CAST(1000 + o_orderkey % 7 AS DOUBLE)
    ELSE CAST(o_orderkey % 40 AS DOUBLE) END AS effort_hours,
  CASE WHEN o_orderkey % 100 < 3 THEN NULL ELSE o_orderstatus END AS phase,
  CASE WHEN o_orderkey % 100 < 60 THEN NULL ELSE 'seen ' || o_orderstatus END AS feedback,
  CASE o_orderkey % 6
    WHEN 0 THEN CAST(o_custkey AS STRING) WHEN 1 THEN '2024-01-05' WHEN 2 THEN 'true'
    WHEN 3 THEN 'on track' WHEN 4 THEN '12.5' ELSE NULL END AS notes
FROM {{orders}}
"""

WHOLE_PRICE = "CAST(floor(o_totalprice) AS BIGINT)"
DOLLARS = (
    f"'$' || CAST(CAST(floor({WHOLE_PRICE} / 1000) AS BIGINT) AS STRING) || ',' "
    f"|| lpad(CAST({WHOLE_PRICE} % 1000 AS STRING), 3, '0')"
)

# A sheet: text columns with agreed names, one row per order.
SHEET = f"""
SELECT
  20000 + o_orderkey AS row_id,
  o_orderkey + 1 AS row_number,
  CASE WHEN o_orderkey % 301 = 0 THEN ' '
    WHEN o_orderkey % 37 = 36 THEN ' T-' || CAST(o_orderkey - 1 AS STRING)
    WHEN o_orderkey % 37 = 34 THEN 'T-' || CAST(o_orderkey + 1 AS STRING)
    ELSE 'T-' || CAST(o_orderkey AS STRING) END AS task_id,
  CASE WHEN o_orderkey % 211 = 0 THEN '  '
    WHEN o_orderkey % 50 = 49 THEN 'TASK ' || CAST(o_orderkey - 1 AS STRING)
    ELSE 'Task ' || CAST(o_orderkey AS STRING) END AS task_name,
  CASE WHEN o_orderkey % 211 = 5 THEN NULL
    WHEN o_orderkey % 50 = 49 THEN 'User ' || CAST((o_orderkey - 1) % 17 AS STRING)
    ELSE 'user ' || CAST(o_orderkey % 17 AS STRING) END AS assigned_to,
  o_orderpriority AS priority,
  CASE o_orderkey % 8
    WHEN 0 THEN 'Not Started' WHEN 1 THEN 'In Progress' WHEN 2 THEN 'Done' WHEN 3 THEN 'Blocked'
    WHEN 4 THEN 'Cancelled' WHEN 5 THEN 'completed' WHEN 6 THEN 'not started' ELSE NULL END AS status,
  {ISO_DATE} AS start_date,
  CASE WHEN o_orderkey % 43 = 1 THEN 'soon'
    ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) AS STRING) END AS due_date,
  CASE WHEN o_orderkey % 61 = 2 THEN 'N/A' WHEN o_orderkey % 61 = 3 THEN '0' ELSE {DOLLARS} END AS budget_usd,
  CASE WHEN o_orderkey % 59 = 4 THEN '—'
    ELSE CAST({WHOLE_PRICE} + o_orderkey % 9 * 10 - 70 AS STRING) END AS actual_cost_usd,
  CASE WHEN o_orderkey % 23 = 1 THEN 'done' WHEN o_orderkey % 23 = 2 THEN 'N/A' WHEN o_orderkey % 23 = 3 THEN NULL
    WHEN o_orderkey % 5 = 0 THEN '100%' WHEN o_orderkey % 5 = 1 THEN '0'
    ELSE CAST(o_orderkey % 99 AS STRING) END AS completion_pct,
  CASE WHEN o_orderkey % 29 = 1 THEN '—' WHEN o_orderkey % 29 = 2 THEN ' None '
    ELSE CAST(o_orderkey % 12 AS STRING) END AS subtask_count,
  CASE WHEN o_orderkey % 17 = 3 THEN 'null' WHEN o_orderkey % 17 = 4 THEN '' ELSE 'ok' END AS notes
FROM {{orders}}
"""

# Shipped lines beside their orders.
SHIPMENTS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, o_orderdate, l_extendedprice, l_quantity, l_linestatus
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

# Lines with a made-up percentage and status.
LINE_STATUS = """
SELECT l_orderkey, l_linenumber, l_quantity * 3 AS completion_pct,
  CASE WHEN l_linestatus = 'F' THEN 'Done' ELSE 'In Progress' END AS status
FROM {lineitem}
"""

# Lines beside the list price of their part.
LINE_COST = """
SELECT l_orderkey, l_linenumber, l_extendedprice AS actual_cost, p_retailprice * l_quantity * 2 AS budget
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

# Corrections proposed for the sheet: four per row, in an order that changes from row to row, several
# on the same cell, and some that cannot apply.
def _proposal(place: int, kind: str, column: str, value: str, risk: str) -> str:
    return f"""
  SELECT o_orderkey * 10 + (o_orderkey + {place}) % 4 AS seq,
    'a{place}-' || CAST(o_orderkey AS STRING) AS action_id, {kind} AS action_type,
    CASE WHEN o_orderkey % 13 = {place} THEN NULL WHEN o_orderkey % 29 = {place} THEN -5 - o_orderkey
      ELSE 20000 + o_orderkey END AS target_row_id,
    {column} AS column_title, {value} AS proposed_value, {risk} AS risk_level
  FROM {{orders}}"""


ACTIONS = "SELECT * FROM (" + "\n  UNION ALL".join([
    _proposal(
        0, "CASE WHEN o_orderkey % 11 = 0 THEN 'delete_row' ELSE 'update_cell_value' END", "'STATUS'",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'Done' ELSE 'In Progress' END", "'SAFE'",
    ),
    _proposal(
        1, "'add_comment'", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'status' END",
        "'[STALE] ' || CAST(o_orderkey % 90 AS STRING) || 'd overdue'", "'SAFE'",
    ),
    _proposal(
        2, "CASE WHEN o_orderkey % 2 = 0 THEN 'add_comment' ELSE 'update_cell_value' END", "'Status'", "'check'",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'REVIEW' ELSE 'SAFE' END",
    ),
    _proposal(
        3, "'update_status'", "CASE WHEN o_orderkey % 17 = 0 THEN 'no such column' ELSE 'notes' END",
        "CAST(NULL AS STRING)", "CASE WHEN o_orderkey % 7 = 0 THEN 'DESTRUCTIVE' ELSE 'REVIEW' END",
    ),
]) + "\n) proposed"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """A view over the given tables, as a DataFrame."""
    names = ("orders", "lineitem", "part", "customer", "events", "documents")
    used = {n: table(spark, folder, n) for n in names if "{" + n + "}" in sql}
    return spark.sql(sql, **used)


def check_sql(sql: str) -> str:
    """The same view in the SQL check, where the tables are known by name."""
    for n in ("orders", "lineitem", "part", "customer", "events", "documents"):
        sql = sql.replace("{" + n + "}", n)
    return sql


def with_views(query: str, **views: str) -> str:
    heads = ",\n".join(f"{name} AS ({check_sql(sql)})" for name, sql in views.items())
    return f"WITH {heads}\n{query}"
