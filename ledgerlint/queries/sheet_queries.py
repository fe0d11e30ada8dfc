"""Checks of sheets and the corrections they propose."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlint.functions.values import loose_number
from ledgerlint.operators import sheet_checks as sc
from ledgerlint.plans.audit import audit_sheet
from ledgerlint.queries.registry import query
from ledgerlint.queries.views import AS_OF, SHEET, view, with_views
from ledgerlint.session import scratch_path
from ledgerlint.settings import SheetColumns

NAMES = SheetColumns()


def number_sql(c: str) -> str:
    bare = f"trim(regexp_replace({c}, '[%$,]', '', 'g'))"
    return (
        f"coalesce(CASE WHEN {bare} NOT IN ('', '—', 'N/A', 'null', 'none', 'done') "
        f"AND NOT isnan(TRY_CAST({bare} AS DOUBLE)) THEN TRY_CAST({bare} AS DOUBLE) END, 0.0)"
    )


def place_sql(check_id: str, place: int = 0, number: str = "row_number") -> str:
    return f"CAST({sc.CHECK_ORDER[check_id] * 10**15} + {number} * 10 + {place} AS BIGINT)"


def id_sql(*parts: str) -> str:
    return f"sha256(concat_ws('|', {', '.join(parts)}))"


DATA_COLUMNS = (
    "task_id", "task_name", "assigned_to", "priority", "status", "start_date", "due_date", "budget_usd",
    "actual_cost_usd", "completion_pct", "subtask_count", "notes",
)
MISSING = "list_filter([" + ", ".join(
    f"CASE WHEN {c} IS NULL OR {c} IN ('', 'null', 'N/A') THEN '{c}' END" for c in DATA_COLUMNS
) + "], lambda x: x IS NOT NULL)"
DUE = "CAST(try_strptime(due_date, '%Y-%m-%d') AS DATE)"
TODAY = f"DATE '{AS_OF.isoformat()}'"
DAYS = f"CAST({TODAY} - {DUE} AS VARCHAR)"
STATUS = "lower(coalesce(status, ''))"
PERCENT = f"CAST({number_sql('completion_pct')} AS VARCHAR)"

CONDITIONS = {
    "P3": f"len({MISSING}) > 0",
    "P5": f"{STATUS} = 'not started' AND {number_sql('completion_pct')} > 0",
    "P6": f"{number_sql('completion_pct')} = 100 AND {STATUS} NOT IN ('done', 'cancelled')",
    "P7": f"trim(coalesce(task_name, '')) <> '' AND trim({STATUS}) NOT IN ('done', 'completed', 'cancelled') "
          f"AND {DUE} < {TODAY}",
    "P8": f"{number_sql('actual_cost_usd')} > {number_sql('budget_usd')} AND {number_sql('budget_usd')} > 0",
}
ISSUE_TEXTS = {
    "P3": ("data_quality", "Data Integrity Issue",
           f"'Row ' || row_number || ' lacks usable values: ' || array_to_string({MISSING}, ', ')",
           "LOW", f"array_to_string({MISSING}, ',')", "Fill in the missing cells."),
    "P5": ("business_logic", "Status Conflict",
           f"{PERCENT} || '% is done although the status says ''Not Started''.'",
           "LOW", "'status,completion_pct'", "Set the status to ''In Progress''."),
    "P6": ("business_logic", "Completion Contradiction", "'All work is done, but the status does not say so.'",
           "MEDIUM", "'status,completion_pct'", "Set the status to ''Done''."),
    "P7": ("stale_records", "Overdue Task",
           f"'''' || trim(task_name) || ''' was due ' || {DAYS} || ' days ago; its status is ' "
           "|| coalesce(status, '') || '.'",
           "MEDIUM", "'due_date,status'", "Check the schedule."),
    "P8": ("anomaly_detector", "Budget Overrun",
           f"'The cost of $' || CAST({number_sql('actual_cost_usd')} AS VARCHAR) || ' exceeds the budget of $' "
           f"|| CAST({number_sql('budget_usd')} AS VARCHAR) || '.'",
           "HIGH", "'actual_cost_usd'", "Check the budget."),
}


def row_issue_sql(check_id: str) -> str:
    agent, title, description, severity, columns, fix = ISSUE_TEXTS[check_id]
    return (
        f"SELECT {id_sql(repr(check_id), 'CAST(row_id AS VARCHAR)')} AS issue_id, '{check_id}' AS check_id, "
        f"'{agent}' AS agent, '{title}' AS title, {description} AS description, '{severity}' AS severity, "
        f"CAST(row_id AS VARCHAR) AS affected_rows, {columns} AS affected_columns, '{fix}' AS suggested_fix, "
        f"CAST(1 AS BIGINT) AS count, CAST(0.9 AS DOUBLE) AS confidence, {place_sql(check_id)} AS seq "
        f"FROM sheet WHERE {CONDITIONS[check_id]}"
    )


ID_KEY = "trim(coalesce(task_id, ''))"
NAME_KEY = "lower(trim(coalesce(task_name, '')))"
OWNER_KEY = "lower(trim(coalesce(assigned_to, '')))"
NUMBERS = (
    "'[' || string_agg(CAST(row_number AS VARCHAR), ', ' ORDER BY row_number) FILTER (WHERE n <= 100) "
    "|| CASE WHEN count(*) > 100 THEN ', ...' ELSE '' END || ']'"
)
SHOWN = "string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_number) FILTER (WHERE n <= 100)"

P1_ISSUES = f"""
SELECT {id_sql("'P1'", 'k')} AS issue_id, 'P1' AS check_id, 'duplicate_hunter' AS agent,
  'Duplicate Task ID' AS title, 'Id ''' || k || ''' stands on ' || count(*) || ' rows: ' || {NUMBERS} || '.'
  AS description, 'HIGH' AS severity, {SHOWN} AS affected_rows, 'task_id' AS affected_columns,
  'Give every task an id of its own.' AS suggested_fix, count(*) - 1 AS count,
  CAST(1.0 AS DOUBLE) AS confidence, {place_sql('P1', 0, 'min(row_number)')} AS seq
FROM (SELECT *, {ID_KEY} AS k, row_number() OVER (PARTITION BY {ID_KEY} ORDER BY row_number) AS n FROM sheet) s
WHERE k <> '' GROUP BY k HAVING count(*) > 1"""

P2_ISSUES = f"""
SELECT {id_sql("'P2'", 'k')} AS issue_id, 'P2' AS check_id, 'duplicate_hunter' AS agent,
  'Near-Duplicate Records' AS title, '''' || arg_min(task_name, row_number)
  || ''' stands under several ids: ' || {NUMBERS} || '.' AS description, 'MEDIUM' AS severity,
  {SHOWN} AS affected_rows, 'task_name,assigned_to' AS affected_columns,
  'See whether these tasks are one.' AS suggested_fix, count(*) - 1 AS count,
  CAST(0.85 AS DOUBLE) AS confidence, {place_sql('P2', 0, 'min(row_number)')} AS seq
FROM (SELECT *, {NAME_KEY} || '|' || {OWNER_KEY} AS k,
  row_number() OVER (PARTITION BY {NAME_KEY}, {OWNER_KEY} ORDER BY row_number) AS n FROM sheet
  WHERE {NAME_KEY} <> '' AND {OWNER_KEY} <> '') s
GROUP BY k HAVING count(*) > 1 AND count(DISTINCT coalesce(task_id, '')) > 1"""

ISSUE_SQL = {"P1": P1_ISSUES, "P2": P2_ISSUES, **{c: row_issue_sql(c) for c in ISSUE_TEXTS}}
ALL_ISSUES_SQL = "\nUNION ALL\n".join(f"SELECT * FROM ({s}) i" for s in ISSUE_SQL.values())


def shown(issues):
    """Issues with lists as text, for comparison."""
    return issues.withColumns({
        "affected_rows": F.concat_ws(",", "affected_rows"),
        "affected_columns": F.concat_ws(",", "affected_columns"),
    })


def sheet_of(spark, folder):
    return view(spark, folder, SHEET)


def rules_of(sheet, *checks):
    return sc.sheet_rules(sheet, AS_OF, NAMES, checks)


def _register_issues(name: str, check_id: str):
    @query(name, with_views(ISSUE_SQL[check_id], sheet=SHEET))
    def run(spark, folder):
        sheet = sheet_of(spark, folder)
        if check_id in ("P1", "P2"):
            return shown(sc.group_issues(sheet, NAMES, (check_id,)))
        return shown(sc.row_issues(sheet, rules_of(sheet, check_id), NAMES))


_register_issues("P1_duplicate_ids", "P1")
_register_issues("P2_clones", "P2")
_register_issues("P3_missing_values", "P3")
_register_issues("P5_started_but_not_started", "P5")
_register_issues("P6_complete_but_open", "P6")
_register_issues("P7_overdue", "P7")
_register_issues("P8_overrun", "P8")


@query("P1_P2_group_members", with_views(f"""
SELECT 'P1' AS check_id, row_id, members FROM (
  SELECT row_id, {ID_KEY} AS k, count(*) OVER (PARTITION BY {ID_KEY}) AS members FROM sheet) a
WHERE k <> '' AND members > 1
UNION ALL
SELECT 'P2', row_id, count(*) OVER (PARTITION BY k) FROM (
  SELECT row_id, {NAME_KEY} || '|' || {OWNER_KEY} AS k, task_id FROM sheet
  WHERE {NAME_KEY} <> '' AND {OWNER_KEY} <> '') b
WHERE k IN (SELECT {NAME_KEY} || '|' || {OWNER_KEY} FROM sheet
  WHERE {NAME_KEY} <> '' AND {OWNER_KEY} <> '' GROUP BY 1
  HAVING count(*) > 1 AND count(DISTINCT coalesce(task_id, '')) > 1)""", sheet=SHEET))
def group_members(spark, folder):
    sheet = sheet_of(spark, folder)
    ids = sc.id_members(sheet, NAMES).select(F.lit("P1").alias("check_id"), "row_id", "members")
    clones = sc.clone_members(sheet, NAMES).select(F.lit("P2").alias("check_id"), "row_id", "members")
    return ids.unionByName(clones)


@query("P1_P2_rows_of_issues", with_views(f"""
SELECT sha256('P1|' || k) AS issue_id, row_id FROM (
  SELECT row_id, {ID_KEY} AS k, count(*) OVER (PARTITION BY {ID_KEY}) AS members FROM sheet) a
WHERE k <> '' AND members > 1
UNION ALL
SELECT sha256('P2|' || k), row_id FROM (
  SELECT row_id, {NAME_KEY} || '|' || {OWNER_KEY} AS k FROM sheet WHERE {NAME_KEY} <> '' AND {OWNER_KEY} <> '') b
WHERE k IN (SELECT {NAME_KEY} || '|' || {OWNER_KEY} FROM sheet
  WHERE {NAME_KEY} <> '' AND {OWNER_KEY} <> '' GROUP BY 1
  HAVING count(*) > 1 AND count(DISTINCT coalesce(task_id, '')) > 1)""", sheet=SHEET))
def rows_of_issues(spark, folder):
    """What a sheet audit stores beside its issues, for those whose issue it stores."""
    audit = audit_sheet(sheet_of(spark, folder), AS_OF, scratch_path(spark, "rows_of_issues"), NAMES)
    return audit.group_rows.join(audit.issues.select("issue_id"), "issue_id", "left_semi").select("issue_id", "row_id")


ACTION_PARTS = {
    "P1": [dict(
        where=None, kind="update_cell_value", column="task_id", current="k", proposed="k || '_DUP'",
        reason="'An earlier row has this id.'", severity="HIGH", agent="duplicate_hunter", risk="REVIEW",
        source=f"(SELECT *, {ID_KEY} AS k, row_number() OVER (PARTITION BY {ID_KEY} ORDER BY row_number) AS n "
               "FROM sheet) s", condition="k <> '' AND n > 1",
    )],
    "P4": [dict(
        kind="update_cell_value", column=c, current=c, proposed="'0'",
        reason=f"'''' || {c} || ''' is no number; 0 stands in for it.'", severity="LOW",
        agent="data_quality", risk="SAFE", condition=f"lower(trim({c})) IN ('done', 'n/a', '—', 'none')",
    ) for c in ("completion_pct", "subtask_count")],
    "P5": [dict(
        kind="update_cell_value", column="status", current="status", proposed="'In Progress'",
        reason=f"{PERCENT} || '% done means that work is in progress.'", severity="LOW",
        agent="business_logic", risk="SAFE", condition=CONDITIONS["P5"],
    )],
    "P6": [dict(
        kind="update_cell_value", column="status", current="status", proposed="'Done'",
        reason="'Nothing is left to do.'", severity="MEDIUM", agent="business_logic", risk="SAFE",
        condition=CONDITIONS["P6"],
    )],
    "P7": [dict(
        kind="add_comment", column="status", current="status", proposed=f"'[STALE] ' || {DAYS} || 'd overdue'",
        reason="'It was due on ' || due_date || '.'", severity="MEDIUM", agent="stale_records",
        risk="SAFE", condition=CONDITIONS["P7"],
    )],
    "P8": [dict(
        kind="add_comment", column="actual_cost_usd",
        current=f"CAST({number_sql('actual_cost_usd')} AS VARCHAR)", proposed="'[AI] Overrun detected.'",
        reason="'The cost exceeds the budget.'", severity="HIGH", agent="anomaly_detector", risk="SAFE", condition=CONDITIONS["P8"],
    )],
}


def action_sql(check_id: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {place_sql(check_id, place)} AS seq, "
        f"{id_sql(repr(check_id), 'CAST(row_id AS VARCHAR)', repr(p['column']), repr(p['kind']))} AS action_id, "
        f"'{check_id}' AS check_id, '{p['kind']}' AS action_type, row_id AS target_row_id, "
        f"CAST(0 AS BIGINT) AS target_column_id, '{p['column']}' AS column_title, {p['current']} AS current_value, "
        f"{p['proposed']} AS proposed_value, {p['reason']} AS reason, '{p['severity']}' AS severity, "
        f"'{p['agent']}' AS agent, '{p['risk']}' AS risk_level FROM {p.get('source', 'sheet')} WHERE {p['condition']}"
        for place, p in enumerate(ACTION_PARTS[check_id])
    )


ALL_ACTIONS_SQL = "\nUNION ALL\n".join(action_sql(c) for c in ACTION_PARTS)


@query("P4_placeholders", with_views(action_sql("P4"), sheet=SHEET))
def placeholders(spark, folder):
    sheet = sheet_of(spark, folder)
    return sc.row_actions(sheet, rules_of(sheet, "P4"), NAMES)


NUMBERED = ("budget_usd", "actual_cost_usd", "completion_pct", "subtask_count")


@query("NUM1_loose_numbers", with_views(
    "SELECT row_id, " + ", ".join(f"{number_sql(c)} AS {c}" for c in NUMBERED) + " FROM sheet", sheet=SHEET))
def loose_numbers(spark, folder):
    return sheet_of(spark, folder).select("row_id", *[loose_number(F.col(c)).alias(c) for c in NUMBERED])


@query("sheet_issues_together", with_views(ALL_ISSUES_SQL, sheet=SHEET))
def all_sheet_issues(spark, folder):
    return shown(sc.sheet_issues(sheet_of(spark, folder), AS_OF, NAMES))


@query("ACT1_proposals", with_views(ALL_ACTIONS_SQL, sheet=SHEET))
def proposals(spark, folder):
    return sc.sheet_actions(sheet_of(spark, folder), AS_OF, NAMES)
