"""Approval and execution of corrections, and the corrected table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlint.operators import actions as act
from ledgerlint.operators.sheet_checks import sheet_actions
from ledgerlint.plans.audit import correct
from ledgerlint.queries.registry import query
from ledgerlint.queries.sheet_queries import ALL_ACTIONS_SQL, DATA_COLUMNS, NAMES, sheet_of
from ledgerlint.queries.views import ACTIONS, AS_OF, SHEET, view, with_views

COMMENT_TOGGLE = "SELECT DISTINCT action_id FROM acts WHERE action_type = 'add_comment'"


def actions_of(spark, folder):
    return view(spark, folder, ACTIONS)


@query("ACT2_default_approvals", with_views(
    "SELECT action_id, risk_level = 'SAFE' AS approved FROM acts", acts=ACTIONS))
def default_approvals(spark, folder):
    return act.approve(actions_of(spark, folder))


@query("ACT2_toggled_approvals", with_views(
    "SELECT action_id, (risk_level = 'SAFE') <> (action_type = 'add_comment') AS approved FROM acts", acts=ACTIONS))
def toggled_approvals(spark, folder):
    actions = actions_of(spark, folder)
    return act.approve(actions, "safe", actions.where("action_type = 'add_comment'").select("action_id"))


@query("ACT2_all_and_none", with_views("""
SELECT 'all' AS policy, count(*) AS n_approved FROM acts
UNION ALL SELECT 'none', CAST(0 AS BIGINT)
UNION ALL SELECT 'safe', count(*) FILTER (WHERE risk_level = 'SAFE') FROM acts""", acts=ACTIONS))
def all_and_none(spark, folder):
    actions = actions_of(spark, folder)
    parts = [
        act.approve(actions, p).agg(F.count_if("approved").alias("n_approved")).withColumn("policy", F.lit(p))
        for p in ("all", "none", "safe")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


OWN_COLUMNS = ", ".join(f"'{c}'" for c in DATA_COLUMNS)
LOG_SQL = f"""
SELECT action_id, action_type, target_row_id, risk_level, CASE
  WHEN action_type NOT IN ('update_cell_value', 'update_status', 'add_comment') THEN 'unsupported action type'
  WHEN target_row_id IS NULL THEN 'missing row id'
  WHEN target_row_id NOT IN (SELECT row_id FROM sheet) THEN 'unknown row'
  WHEN lower(coalesce(nullif(column_title, ''), 'Status')) NOT IN ({OWN_COLUMNS}) THEN 'unknown column' END AS reason_skipped
FROM acts"""


@query("ACT3_execution_log", with_views("""
SELECT action_id, action_type, target_row_id, CASE WHEN reason_skipped IS NULL THEN 'applied' ELSE 'skipped' END AS status,
  reason_skipped FROM log WHERE risk_level = 'SAFE'""", sheet=SHEET, acts=ACTIONS, log=LOG_SQL))
def execution_log(spark, folder):
    actions = actions_of(spark, folder)
    log = act.execution_log(sheet_of(spark, folder), actions, act.approve(actions), "row_id", DATA_COLUMNS)
    return log.select("action_id", "action_type", "target_row_id", "status", "reason_skipped")


@query("ACT3_unapproved", with_views("SELECT action_id FROM acts WHERE risk_level <> 'SAFE'", acts=ACTIONS))
def unapproved(spark, folder):
    actions = actions_of(spark, folder)
    return act.unapproved_actions(actions, act.approve(actions)).select("action_id")


@query("ACT4_execution_summary", with_views("""
SELECT count(*) AS total_executed, count(*) FILTER (WHERE reason_skipped IS NULL) AS success_count,
  count(reason_skipped) AS failed_count FROM log WHERE risk_level = 'SAFE'
UNION ALL
SELECT count(*), count(*) FILTER (WHERE reason_skipped IS NULL), count(reason_skipped) FROM log""",
    sheet=SHEET, acts=ACTIONS, log=LOG_SQL))
def execution_summary(spark, folder):
    actions, sheet = actions_of(spark, folder), sheet_of(spark, folder)
    safe, every = (act.execution_summary(act.execution_log(
        sheet, actions, act.approve(actions, policy), "row_id", DATA_COLUMNS)) for policy in ("safe", "all"))
    return safe.unionByName(every)


def fold_sql(source: str) -> dict:
    """Views that fold the actions of ``source`` to one net patch per cell."""
    return {
        "valid": f"""
SELECT seq, action_id, target_row_id AS r, lower(coalesce(nullif(column_title, ''), 'Status')) AS col,
  action_type = 'add_comment' AS is_comment, coalesce(proposed_value, '') AS v
FROM {source} WHERE action_type IN ('update_cell_value', 'update_status', 'add_comment') AND target_row_id IS NOT NULL
  AND lower(coalesce(nullif(column_title, ''), 'Status')) IN ({OWN_COLUMNS})""",
        "marked": "SELECT *, max(seq) FILTER (WHERE NOT is_comment) OVER (PARTITION BY r, col) AS last FROM valid",
        "folded": """
SELECT r, col, max(last) AS last, max(v) FILTER (WHERE seq = last) AS base,
  string_agg(v, ' | ' ORDER BY seq DESC) FILTER (WHERE is_comment AND seq > coalesce(last, -1)) AS comments,
  string_agg(action_id, ',' ORDER BY seq DESC) FILTER (WHERE seq >= coalesce(last, -1)) AS action_ids
FROM marked GROUP BY r, col""",
    }


def cell_sql(c: str) -> str:
    return (
        f"CASE WHEN f_{c}.r IS NULL THEN {c} ELSE concat_ws(' | ', f_{c}.comments, "
        f"CASE WHEN f_{c}.last IS NOT NULL THEN f_{c}.base ELSE coalesce({c}, '') END) END AS {c}"
    )


def patched_sql() -> str:
    joins = " ".join(f"LEFT JOIN folded f_{c} ON f_{c}.r = row_id AND f_{c}.col = '{c}'" for c in DATA_COLUMNS)
    return f"SELECT row_id, row_number, {', '.join(cell_sql(c) for c in DATA_COLUMNS)} FROM sheet {joins}"


CHANGES_SQL = "\nUNION ALL\n".join(
    f"SELECT CAST(row_id AS VARCHAR) AS \"row\", '{c}' AS \"column\", coalesce({c}, '') AS old_value, "
    f"concat_ws(' | ', comments, CASE WHEN last IS NOT NULL THEN base ELSE coalesce({c}, '') END) AS new_value, "
    f"action_ids FROM folded JOIN sheet ON r = row_id WHERE col = '{c}'" for c in DATA_COLUMNS
)


@query("ACT5_corrected_sheet", with_views(patched_sql(), sheet=SHEET, acts=ACTIONS, **fold_sql("acts")))
def corrected_sheet(spark, folder):
    return act.apply_patches(sheet_of(spark, folder), actions_of(spark, folder), "row_id", DATA_COLUMNS)


@query("ACT5_corrected_by_own_proposals", with_views(
    patched_sql(), sheet=SHEET, acts=ALL_ACTIONS_SQL, safe="SELECT * FROM acts WHERE risk_level = 'SAFE'",
    **fold_sql("safe")))
def corrected_by_own_proposals(spark, folder):
    sheet = sheet_of(spark, folder)
    actions = sheet_actions(sheet, AS_OF, NAMES)
    return correct(sheet, actions, act.approve(actions), NAMES).table


@query("ACT5_skipped", with_views(f"""
SELECT action_id, CASE WHEN action_type NOT IN ('update_cell_value', 'update_status', 'add_comment')
  THEN 'unsupported action type' WHEN target_row_id IS NULL THEN 'missing row id'
  WHEN target_row_id NOT IN (SELECT row_id FROM sheet) THEN 'unknown row' ELSE 'unknown column' END AS reason_skipped
FROM acts WHERE action_type NOT IN ('update_cell_value', 'update_status', 'add_comment') OR target_row_id IS NULL
  OR target_row_id NOT IN (SELECT row_id FROM sheet)
  OR lower(coalesce(nullif(column_title, ''), 'Status')) NOT IN ({OWN_COLUMNS})""", sheet=SHEET, acts=ACTIONS))
def skipped(spark, folder):
    found = act.skipped_actions(sheet_of(spark, folder), actions_of(spark, folder), "row_id", DATA_COLUMNS)
    return found.select("action_id", "reason_skipped")


@query("ACT6_change_log", with_views(CHANGES_SQL, sheet=SHEET, acts=ACTIONS, **fold_sql("acts")))
def change_log(spark, folder):
    changes = act.change_log(sheet_of(spark, folder), actions_of(spark, folder), "row_id", DATA_COLUMNS)
    return changes.withColumn("action_ids", F.concat_ws(",", "action_ids"))
