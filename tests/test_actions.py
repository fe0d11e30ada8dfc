import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlint.operators import actions as act

ACTION = (
    "seq bigint, action_id string, action_type string, target_row_id bigint, column_title string, "
    "proposed_value string, risk_level string"
)
SHEET = "row_id bigint, Status string, notes string"
ROWS = [(1, "old", None), (2, None, "n2"), (3, "c", "n3")]

one_action = st.tuples(
    st.sampled_from(["update_cell_value", "update_status", "add_comment", "delete_row"]),
    st.sampled_from([1, 2, 3, 99, None]),
    st.sampled_from(["status", "STATUS", None, "", "Notes", "missing"]),
    st.sampled_from(["A", "B", "c1", "c2", None]),
)


def naive(actions):
    """The corrections one after the other, as a plain loop."""
    table = {i: {"Status": s, "notes": n} for i, s, n in ROWS}
    for kind, row, title, value in actions:
        if kind == "delete_row" or row not in table:
            continue
        column = {"status": "Status", "notes": "notes"}.get((title or "Status").lower())
        if column is None:
            continue
        old = table[row][column] or ""
        table[row][column] = f"{value or ''} | {old}" if kind == "add_comment" else (value or "")
    return {i: (r["Status"], r["notes"]) for i, r in table.items()}


def frames(spark, actions):
    rows = [(i, f"a{i}", k, r, t, v, "SAFE") for i, (k, r, t, v) in enumerate(actions)]
    return spark.createDataFrame(ROWS, SHEET), spark.createDataFrame(rows, ACTION).repartition(3)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(one_action, max_size=25))
def test_patches_equal_a_loop(spark, actions):
    sheet, proposed = frames(spark, actions)
    got = {r["row_id"]: (r["Status"], r["notes"]) for r in act.apply_patches(sheet, proposed, "row_id").collect()}
    assert got == naive(actions)
    changes = {
        (int(r["row"]), r["column"]): (r["old_value"], r["new_value"])
        for r in act.change_log(sheet, proposed, "row_id").collect()
    }
    before = {i: {"Status": s, "notes": n} for i, s, n in ROWS}
    for (row, column), (old, new) in changes.items():
        assert old == (before[row][column] or "")
        assert new == got[row][0 if column == "Status" else 1]


def test_newest_comment_comes_first(spark):
    actions = [("update_cell_value", 1, "status", "A"), ("add_comment", 1, "status", "c1"), ("add_comment", 1, "status", "c2")]
    sheet, proposed = frames(spark, actions)
    assert act.apply_patches(sheet, proposed, "row_id").where("row_id = 1").first()["Status"] == "c2 | c1 | A"
    assert act.change_log(sheet, proposed, "row_id").first()["action_ids"] == ["a2", "a1", "a0"]


def test_one_cell_with_most_of_the_patches(spark):
    n = 5000
    sheet = spark.createDataFrame(ROWS, SHEET)
    proposed = spark.range(n).select(
        F.col("id").alias("seq"), F.concat(F.lit("a"), "id").alias("action_id"),
        F.when(F.col("id") % 1000 == 500, "update_status").otherwise("add_comment").alias("action_type"),
        F.lit(1).cast("bigint").alias("target_row_id"), F.lit("status").alias("column_title"),
        F.col("id").cast("string").alias("proposed_value"), F.lit("SAFE").alias("risk_level"),
    )
    want = " | ".join([str(i) for i in range(n - 1, 4499, -1)])
    assert act.apply_patches(sheet, proposed, "row_id").where("row_id = 1").first()["Status"] == want


def test_skipped_actions_say_why(spark):
    actions = [("delete_row", 1, "status", "x"), ("add_comment", None, "status", "x"), ("add_comment", 99, "status", "x"),
               ("add_comment", 1, "missing", "x"), ("add_comment", 1, None, "x")]
    sheet, proposed = frames(spark, actions)
    got = {r["action_id"]: r["reason_skipped"] for r in act.skipped_actions(sheet, proposed, "row_id").collect()}
    assert got == {
        "a0": "unsupported action type", "a1": "missing row id", "a2": "unknown row", "a3": "unknown column",
    }


@pytest.mark.parametrize("policy, want", [("safe", {"a0"}), ("all", {"a0", "a1"}), ("none", set())])
def test_approval_policies(spark, policy, want):
    proposed = spark.createDataFrame(
        [(0, "a0", "add_comment", 1, "x", "y", "SAFE"), (1, "a1", "add_comment", 1, "x", "y", "REVIEW")], ACTION
    )
    approvals = act.approve(proposed, policy)
    assert {r["action_id"] for r in act.approved_actions(proposed, approvals).collect()} == want
    sheet = spark.createDataFrame([(1, "old")], "row_id bigint, x string")
    log = act.execution_summary(act.execution_log(sheet, proposed, approvals, "row_id")).first()
    assert (log["total_executed"], log["success_count"], log["failed_count"]) == (len(want), len(want), 0)
    elsewhere = spark.createDataFrame([(2, "old")], "row_id bigint, x string")
    log = act.execution_summary(act.execution_log(elsewhere, proposed, approvals, "row_id")).first()
    assert (log["success_count"], log["failed_count"]) == (0, len(want))


def test_toggling_twice_changes_nothing(spark):
    proposed = spark.createDataFrame([(0, "a0", "add_comment", 1, "x", "y", "SAFE")], ACTION)
    twice = spark.createDataFrame([("a0",), ("a0",)], "action_id string")
    once = spark.createDataFrame([("a0",)], "action_id string")
    assert act.approve(proposed, "safe", twice).first()["approved"] is True
    assert act.approve(proposed, "safe", once).first()["approved"] is False


def test_unapproved_actions_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(act, "ROWS_A_TASK", 40)
    actions = spark.range(1000).select(
        F.when(F.col("id") != 5, F.col("id").cast("string")).alias("action_id"),
        F.when(F.col("id") % 3 == 0, "SAFE").otherwise("REVIEW").alias("risk_level"))
    left = act.unapproved_actions(actions, act.approve(actions))
    assert {r["action_id"] for r in left.collect()} == {str(i) for i in range(1000) if i % 3 and i != 5} | {None}
    assert left.rdd.getNumPartitions() == 25


def test_cells_are_patched_once_and_without_ids(spark, monkeypatch):
    reads, keep = [], act.stored
    monkeypatch.setattr(act, "stored", lambda df, label: (reads.append(df), keep(df, label))[1])
    actions = [("update_cell_value", 1, "status", "A"), ("add_comment", 1, "status", "c1"), ("add_comment", 2, "notes", "c2"),
               ("add_comment", 3, "status", "c3"), ("update_status", 3, "status", "B")]
    sheet, proposed = frames(spark, actions)
    fixed = act.apply_patches(sheet, proposed.drop("action_id"), "row_id")
    assert {r["row_id"]: (r["Status"], r["notes"]) for r in fixed.collect()} == naive(actions)
    # No cell has several comments: the actions are read for the stored patches and not again.
    plan = fixed._jdf.queryExecution().analyzed().toString()
    assert len(reads) == 1 and "proposed_value" not in plan


def test_approvals_without_ids(spark):
    proposed = spark.createDataFrame(
        [(i, a, "add_comment", 1, "x", "y", risk) for i, (a, risk) in enumerate(
            [("a0", "SAFE"), ("a1", "REVIEW"), (None, "SAFE"), ("a3", "SAFE"), ("a3", "SAFE")])], ACTION)
    approvals = act.approve(proposed)
    want = {r["seq"] for r in act.approved_actions(proposed, approvals).collect()}
    got = act.approved_actions(proposed, approvals, ids=False)
    assert "action_id" not in got.columns and sorted(r["seq"] for r in got.collect()) == sorted(want) == [0, 3, 4]
