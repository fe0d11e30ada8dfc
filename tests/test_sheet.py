import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlint.functions.values import loose_number
from ledgerlint.operators import issues as iss, sheet_checks as sc
from ledgerlint.operators.actions import approve
from ledgerlint.plans.audit import audit_sheet, correct
from ledgerlint.session import scratch_path

AS_OF = dt.date(2026, 4, 16)
COLUMNS = [
    "task_id", "task_name", "assigned_to", "status", "due_date", "budget_usd", "actual_cost_usd", "completion_pct",
    "subtask_count", "notes",
]


def row(i, **over):
    base = {
        "task_id": f"T-{i}", "task_name": f"Task {i}", "assigned_to": f"User {i}", "status": "In Progress",
        "due_date": "2026-12-01", "budget_usd": "1000", "actual_cost_usd": "900", "completion_pct": "50",
        "subtask_count": "3", "notes": "fine",
    }
    return {**base, **over}


TRAPS = [
    row(0), row(1), row(2),
    row(3, completion_pct="N/A"),
    row(4, completion_pct="done"),
    row(5, subtask_count="—"),
    row(6, notes=""),
    row(7, task_name="   ", assigned_to="", due_date="2026-01-01"),
    row(8, completion_pct="100"),
    row(9, completion_pct="100%", status="cancelled"),
    row(10, completion_pct="100", status="completed"),
    row(11, completion_pct="20", status="Not Started"),
    row(12, status="NOT STARTED", completion_pct="0"),
    row(13, actual_cost_usd="$5,500.00"),
    row(14, budget_usd="0", actual_cost_usd="10"),
    row(15, due_date="2026-04-15"),
    row(16, due_date="2026-04-16"),
    row(17, due_date="2026-4-1", status="Done "),
    row(18, due_date="2026-4-1"),
    row(19, due_date="soon"),
    row(20, task_id="T-0"), row(21, task_id=" T-0 "), row(22, task_id="T-1"),
    row(23, task_name="TASK 2 ", assigned_to="user 2"),
    row(24, task_id="", task_name="only here"), row(25, task_id=None, task_name="nor here"),
]


@pytest.fixture(scope="module")
def sheet(spark):
    rows = [(20000 + i, i + 1, *[r[c] for c in COLUMNS]) for i, r in enumerate(TRAPS)]
    schema = "row_id bigint, row_number bigint, " + ", ".join(f"{c} string" for c in COLUMNS)
    return spark.createDataFrame(rows, schema)


def rows_of(issues, check_id):
    found = issues.where(F.col("check_id") == check_id).orderBy("seq").collect()
    return [[int(x) - 20000 for x in r["affected_rows"]] for r in found]


def test_issues(sheet):
    issues = sc.sheet_issues(sheet, AS_OF)
    assert rows_of(issues, "P1") == [[0, 20, 21], [1, 22]]
    assert rows_of(issues, "P2") == [[2, 23]]
    assert rows_of(issues, "P3") == [[3], [6], [7], [24], [25]]
    assert rows_of(issues, "P5") == [[11]]
    assert rows_of(issues, "P6") == [[8], [10]]
    assert rows_of(issues, "P7") == [[15], [18]]
    assert rows_of(issues, "P8") == [[13]]
    texts = {(r["check_id"], r["affected_rows"][0]): r["description"] for r in issues.collect()}
    assert texts[("P1", "20000")] == "Id 'T-0' stands on 3 rows: [1, 21, 22]."
    assert texts[("P2", "20002")] == "'Task 2' stands under several ids: [3, 24]."
    assert texts[("P3", "20007")] == "Row 8 lacks usable values: assigned_to"
    assert texts[("P7", "20015")] == "'Task 15' was due 1 days ago; its status is In Progress."
    assert texts[("P8", "20013")] == "The cost of $5500.0 exceeds the budget of $1000.0."


def test_proposals_and_corrected_sheet(sheet):
    actions = sc.sheet_actions(sheet, AS_OF)
    fixed = correct(sheet, actions, approve(actions, "all"))
    after = {r["row_id"] - 20000: r for r in fixed.table.collect()}
    assert after[0]["task_id"] == "T-0" and after[20]["task_id"] == "T-0_DUP" and after[21]["task_id"] == "T-0_DUP"
    assert [after[i]["completion_pct"] for i in (3, 4)] == ["0", "0"] and after[5]["subtask_count"] == "0"
    assert after[11]["status"] == "In Progress" and after[8]["status"] == "Done"
    assert after[15]["status"] == "[STALE] 1d overdue | In Progress"
    assert after[13]["actual_cost_usd"] == "[AI] Overrun detected. | $5,500.00"
    assert fixed.skipped.count() == 0
    assert fixed.changes.count() == actions.select("target_row_id", "column_title").distinct().count()
    safe = correct(sheet, actions, approve(actions)).table
    assert {r["task_id"] for r in safe.where("row_id in (20020, 20021)").collect()} == {"T-0", " T-0 "}


def test_whole_audit_and_score(spark, sheet):
    audit = audit_sheet(sheet, AS_OF, scratch_path(spark, "sheet"))
    row = audit.health.first()
    assert (row["high"], row["medium"], row["low"]) == (3, 5, 6)
    assert row["health_score"] == int(100 - (3 * 0.6 + 5 * 0.15 + 6 * 0.05))


def test_one_id_on_a_third_of_the_rows(spark):
    df = spark.range(9000).select(
        F.col("id").alias("row_id"), (F.col("id") + 1).alias("row_number"),
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("task_id"),
    )
    issue = sc.group_issues(df, checks=("P1",)).first()
    assert issue["count"] == 2999 and len(issue["affected_rows"]) == 100
    assert issue["affected_rows"][:3] == ["0", "3", "6"]
    assert sc.id_members(df).count() == 3000
    assert sc.duplicate_id_actions(df).count() == 2999


@pytest.mark.parametrize("text, number", [
    ("$1,234.50", 1234.5), ("12%", 12.0), (" 7 ", 7.0), ("", 0.0), ("—", 0.0), ("done", 0.0), ("nan", 0.0),
    (None, 0.0), ("x1", 0.0), ("-3", -3.0),
])
def test_loose_numbers(spark, text, number):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(loose_number(F.col("v"))).first()[0] == number


def issue_frame(spark, high, medium, low):
    rows = [("HIGH",)] * high + [("MEDIUM",)] * medium + [("LOW",)] * low
    return spark.createDataFrame(rows, "severity string")


@pytest.mark.parametrize("counts, file_score, sheet_score", [
    ((0, 0, 0), 100, 100), ((1, 0, 0), 88, 99), ((4, 5, 7), 8, 96), ((10, 10, 10), 0, 92), ((200, 0, 0), 45, 15),
    ((0, 2, 1), 86, 99), ((5, 0, 0), 45, 97), ((0, 20, 0), 70, 97),
])
def test_health_scores(spark, counts, file_score, sheet_score):
    issues = issue_frame(spark, *counts)
    assert iss.file_health_score(issues).first()["health_score"] == file_score
    assert iss.sheet_health_score(issues).first()["health_score"] == sheet_score


def test_row_preview_and_bands(spark):
    df = spark.createDataFrame([(["1", "2"], 2), (list("1234567"), 107), ([], 0)], "r array<string>, n bigint")
    shown = [x[0] for x in df.select(iss.row_preview(F.col("r"), F.col("n"))).collect()]
    assert shown == ["1, 2", "1, 2, 3, 4, 5 (+102 more)", " (Dataset wide)"]
    scores = spark.createDataFrame([(80,), (79,), (50,), (49,)], "s int")
    assert [x[0] for x in scores.select(iss.score_band(F.col("s"))).collect()] == ["green", "amber", "amber", "red"]
