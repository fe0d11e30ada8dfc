import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ledgerlint.operators import anomalies, duplicates, issues, logic, normalize, profile, quality, schema, stale
from ledgerlint.operators.findings import RowKey, row_findings, summarise
from ledgerlint.operators.skew import join_to_groups
from ledgerlint.plans.audit import CheckContext, FAMILIES, audit_table
from ledgerlint.session import scratch_path
from ledgerlint.settings import ColumnRoles

ID = RowKey(("id",), "id")
AS_OF = dt.date(2026, 4, 16)


def keys(findings, check_id=None):
    rows = findings.collect()
    return sorted(int(r["row_key"]) for r in rows if check_id in (None, r["check_id"]))


def test_normalize_tokens_and_nan(spark):
    df = spark.createDataFrame([("N/A", math.nan), ("—", 1.0), (" x", None), ("", 2.0)], "t string, v double")
    assert [tuple(r) for r in normalize.normalize(df).collect()] == [
        (None, None), (None, 1.0), (" x", None), (None, 2.0),
    ]


def test_exact_duplicates_treat_nulls_nan_and_signed_zero_as_equal(spark):
    rows = [(0, "a", None, 0.0), (1, "a", None, -0.0), (2, None, "a", 0.0), (3, "b", "c", math.nan), (4, "b", "c", math.nan),
            (5, "b", "c", 1.0)]
    df = spark.createDataFrame(rows, "id bigint, s string, t string, v double")
    assert keys(duplicates.exact_duplicates(df, ID)) == [0, 1, 3, 4]
    totals = duplicates.duplicate_totals(df, ["s", "t", "v"]).first()
    assert tuple(totals) == (2, 4, 2, 2)


def test_duplicate_keys_with_one_hot_key(spark):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") < 1000, F.lit(None).cast("string")).otherwise(F.col("id").cast("string")).alias("k")
    )
    assert keys(duplicates.duplicate_keys(df, ["k"], ID)) == list(range(1000))


def test_group_join_is_the_same_whatever_is_salted(spark):
    rows = spark.range(500).select("id", (F.col("id") % 7).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    for hot in (0, 1, 3, 100):
        joined = join_to_groups(rows, groups, ["k"], "n", ["id"], hot_keys=hot, salts=4)
        assert joined.count() == 500 and joined.select("id").distinct().count() == 500


def test_empty_table_gives_no_findings(spark):
    df = spark.createDataFrame([], "id bigint, name string, status string, due_date string, budget double")
    roles = ColumnRoles({"name": "name", "status": "status", "due_date": "date"}, ("id",))
    result = audit_table(df, CheckContext(roles, ID, AS_OF), scratch_path(spark, "empty"))
    assert result.findings.count() == 0
    assert result.health.first()["health_score"] == 100
    assert {r["status"] for r in result.run_stats.collect()} == {"done"}


def test_null_density_bounds_are_strict(spark):
    n = 100
    df = spark.range(n).select(
        "id",
        *[F.when(F.col("id") >= k, F.lit(1)).alias(f"c{k}") for k in (0, 5, 6, 20, 21, 50, 51, 100)],
    )
    got = {r["column"]: r["severity"] for r in quality.null_density(df).collect()}
    assert got == {"c6": "LOW", "c20": "LOW", "c21": "MEDIUM", "c50": "MEDIUM", "c51": "HIGH", "c100": "HIGH"}


def test_constant_and_short_columns_have_no_z_outliers(spark):
    df = spark.range(20).select("id", F.lit(4.0).alias("same"), F.when(F.col("id") < 9, 1.0).alias("few"))
    facts = anomalies.column_limits(df, ["same", "few"])
    assert set(facts) == {"same"}
    row = anomalies.outlier_facts(df, facts).first()
    assert (row["n_z"], row["n_outliers"], row["max_z"]) == (0, 0, None)


def test_outliers_by_either_method(spark):
    values = [10.0] * 30 + [11.0] * 30 + [500.0]
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, v double")
    facts = anomalies.column_limits(df, ["v"])
    severities = anomalies.outlier_severities(facts)
    assert severities == {"v": "HIGH"}
    assert keys(row_findings(df, anomalies.outlier_rules(facts, severities), ID)) == [60]
    assert anomalies.skewed_columns(df, ["v"]).count() == 1


def test_impossible_negatives_go_by_name(spark):
    df = spark.createDataFrame([(0, -1, -1)], "id bigint, quantity int, temperature int")
    assert keys(row_findings(df, anomalies.impossible_negative_rules(["quantity", "temperature"]), ID)) == [0]


def test_row_rules_ignore_unreadable_dates(spark):
    rows = [(0, "2026-01-02", "2026-01-01"), (1, "2026-01-01", "2026-01-01"), (2, "2026-01-01", "2026-01-02"),
            (3, "01/27/2026", "2026-01-01"), (4, None, "2026-01-01")]
    df = spark.createDataFrame(rows, "id bigint, start_date string, due_date string")
    pairs, formats = [("start_date", "due_date")], ("yyyy-MM-dd",)
    assert keys(row_findings(df, logic.date_order_rules(df, pairs, formats), ID)) == [0, 1]
    assert keys(row_findings(df, logic.date_format_rules(df, ["start_date"], formats), ID)) == [3]
    both = row_findings(df, logic.date_order_rules(df, pairs, ("yyyy-MM-dd", "MM/dd/yyyy")), ID)
    assert keys(both) == [0, 1, 3]


def test_status_percentage_reads_text_percentages(spark):
    df = spark.createDataFrame(
        [(0, "Done", "50"), (1, "completed", "100"), (2, "Open", "5"), (3, "DONE", "n/a"), (4, None, "1")],
        "id bigint, status string, completion_pct string",
    )
    rules = logic.status_percentage_rules(df, ColumnRoles({"status": "status"}))
    assert keys(row_findings(df, rules, ID)) == [0]


def test_missing_status_is_not_done(spark):
    rows = [(0, None, "2026-01-01", "2026-01-01", "2025-01-01"), (1, "Done", "2026-01-01", "2026-01-01", "2027-01-01"),
            (2, "open", "2026-04-16", "2026-02-15", "2026-01-16"), (3, "open", None, "2026-02-14", "2026-01-15")]
    df = spark.createDataFrame(rows, "id bigint, status string, due_date string, updated_at string, start_date string")
    columns = stale.stale_columns(df, ColumnRoles({"status": "status"}))
    found = row_findings(df, stale.stale_rules(df, columns, AS_OF), ID)
    assert keys(found, "T2") == [0]
    assert keys(found, "T3") == [0, 3]
    assert keys(found, "T4") == [1]
    assert keys(found, "T5") == [0, 3]


def test_missing_deadline_needs_a_filled_column(spark):
    def found(n_missing):
        df = spark.range(10).select("id", F.when(F.col("id") >= n_missing, "2026-01-01").alias("due_date"))
        return keys(row_findings(df, stale.missing_deadline_rules(df, "due_date"), ID))

    assert found(1) == [0]
    assert found(2) == []


def test_mixed_types_and_casing(spark):
    df = spark.createDataFrame(
        [(0, "1", "Open"), (1, "2.5", "open"), (2, "x", "closed"), (3, "2024-01-01", None), (4, "TRUE", "OPEN")],
        "id bigint, v string, status string",
    )
    row = quality.mixed_types(df, ["v", "status"]).collect()
    assert [(r["column"], r["n_number"], r["n_date"], r["n_boolean"], r["n_text"]) for r in row] == [("v", 2, 1, 1, 1)]
    assert keys(quality.casing_findings(df, ["status"], ID)) == [0, 1, 4]


def test_summary_lists_the_first_hundred_rows_and_counts_all(spark):
    df = spark.range(1000).select("id", F.lit(-1.0).alias("cost")).repartition(7)
    row = summarise(row_findings(df, logic.negative_amount_rules(df), ID)).first()
    assert row["count"] == 1000
    assert row["affected_rows"] == [str(i) for i in range(100)]


def test_samples_distribution_and_types(spark):
    rows = [(i, "2026-01-%02d" % (i + 1), "u%d@x.org" % i, "Open", str(i * 3 % 101), f"n{i}") for i in range(28)]
    df = spark.createDataFrame(
        rows, "row_no int, start_date string, contact string, status string, done_pct string, person_name string"
    )
    got = {r["column"]: r["semantic_type"] for r in schema.semantic_types(df).collect()}
    assert got == {
        "row_no": "numeric", "start_date": "date", "contact": "email", "status": "status", "done_pct": "percentage",
        "person_name": "name",
    }
    first = profile.column_samples(df, "row_no", ["contact"]).orderBy("position").collect()
    assert [r["value"] for r in first] == [f"u{i}@x.org" for i in range(5)]
    assert schema.infer_roles(df).key == ("row_no",)


def test_roles_by_name(spark):
    df = spark.createDataFrame(
        [], "task_id string, start_date string, due_date string, vendor string, cost_center string, status string, n int"
    )
    roles = schema.infer_roles(df, by_name=True)
    assert roles.types == {
        "task_id": "id", "start_date": "date", "due_date": "date", "vendor": "date", "cost_center": "numeric",
        "status": "status", "n": "numeric",
    }
    assert roles.key == ("task_id",)
    assert ("start_date", "due_date") in roles.date_pairs
    assert schema.type_by_name("Priority", False, schema.SHEET_NAME_RULES) == "picklist"


def test_a_failing_family_does_not_stop_the_others(spark):
    def broken(df, context, counted):
        raise RuntimeError("no such thing")

    df = spark.createDataFrame([(0, -5.0)], "id bigint, cost double")
    result = audit_table(
        df, CheckContext(ColumnRoles(), ID, AS_OF), scratch_path(spark, "broken"),
        agents=("data_quality", "business_logic", "stale_records"),
        families={**FAMILIES, "data_quality": broken},
    )
    stats = {r["name"]: (r["status"], r["issue_count"]) for r in result.run_stats.collect()}
    assert stats["data_quality"] == ("failed", 0)
    assert stats["business_logic"] == ("done", 1)
    assert stats["anomaly_detector"] == ("skipped", 0)


@pytest.mark.parametrize("seed", range(3))
def test_duplicates_do_not_depend_on_row_order(spark, seed):
    df = spark.range(200).select("id", (F.col("id") % 150).alias("a"), (F.col("id") % 3).alias("b"))
    shuffled = df.orderBy(F.rand(seed))
    assert keys(duplicates.exact_duplicates(shuffled, ID)) == keys(duplicates.exact_duplicates(df, ID))


def test_findings_have_one_schema(spark):
    from ledgerlint.operators.findings import FINDING_SCHEMA

    want = spark.createDataFrame([], FINDING_SCHEMA).dtypes
    df = spark.createDataFrame([(0, "a", -1.0), (0, "a", -1.0)], "id bigint, s string, cost double")
    assert duplicates.exact_duplicates(df, ID).dtypes == want
    assert duplicates.duplicate_keys(df, ["s"], ID).dtypes == want
    assert row_findings(df, logic.negative_amount_rules(df), ID).dtypes == want
    assert quality.mixed_type_findings(df, ["s"]).dtypes == want
    assert anomalies.skew_findings(df, ["cost"]).dtypes == want


def test_whole_audit(spark):
    rows = [(i, f"T{i}", "Open" if i % 2 else "open", "2026-01-01", "2026-01-02", 10.0, 5.0, 50.0) for i in range(30)]
    rows[3] = (3, "T2", "done", "2026-01-05", "2026-01-02", -10.0, 5.0, 150.0)
    rows[4] = (4, "T4", None, "soon", None, 10.0, 5000.0, None)
    df = spark.createDataFrame(
        rows, "id bigint, task_id string, status string, start_date string, due_date string, budget double, "
              "actual_cost double, completion_pct double",
    )
    roles = ColumnRoles(
        {"task_id": "id", "status": "status", "start_date": "date", "due_date": "date"}, ("task_id",),
        (("start_date", "due_date"),),
    )
    result = audit_table(df, CheckContext(roles, ID, AS_OF), scratch_path(spark, "whole"))
    got = {(r["check_id"], ",".join(r["columns"])): (r["count"], r["severity"]) for r in result.summary.collect()}
    assert got[("D2", "task_id")][0] == 2
    assert got[("Q2", "start_date")] == (30, "MEDIUM")
    assert got[("Q4", "completion_pct")] == (1, "MEDIUM")
    assert got[("L1", "start_date,due_date")] == (1, "HIGH")
    assert got[("L2", "budget")] == (1, "HIGH")
    assert got[("L3", "actual_cost,budget")] == (2, "MEDIUM")
    assert got[("L5", "start_date")] == (1, "MEDIUM")
    assert got[("T1", "due_date")] == (1, "MEDIUM")
    assert got[("T2", "due_date,status")] == (28, "MEDIUM")
    assert got[("A1", "actual_cost")] == (1, "HIGH")
    assert {r["status"] for r in result.run_stats.collect()} == {"done"}
    assert result.issues.count() == result.summary.count()


def test_sketched_evidence_agrees_on_small_tables(spark):
    rows = [(i, f"u{i}@x.org", "2026-01-01" if i % 2 else None, str(i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, contact string, due_date string, level string")
    def types(exact):
        return {r["column"]: r["semantic_type"] for r in schema.semantic_types(df, exact=exact).collect()}
    assert types(True) == types(False)
    stats = {r["column"]: r for r in profile.column_stats(df, exact=False).collect()}
    assert stats["due_date"]["null_count"] == 20 and stats["level"]["distinct_count"] == 4
    assert [r["column"] for r in schema.key_candidates(df).orderBy("position").collect()] == ["id", "contact"]


def test_names_with_dots_blanks_and_backticks(spark):
    rows = [(i, "Open" if i % 2 else "open", "2026-01-01", -10.0 if i == 3 else 10.0, 150.0 if i == 4 else 50.0) for i in range(40)]
    df = spark.createDataFrame(rows, "a bigint, b string, c string, d double, e double").toDF(
        "row.id", "task status", "due.date", "unit`s.price", "done.pct")
    roles = schema.infer_roles(df)
    assert roles.types["task status"] == "status" and roles.types["due.date"] == "date" and roles.key == ("row.id",)
    result = audit_table(df, CheckContext(roles, RowKey(("row.id",), "row.id"), AS_OF), scratch_path(spark, "odd"))
    assert {r["status"] for r in result.run_stats.collect()} == {"done"}
    got = {(r["check_id"], c) for r in result.summary.collect() for c in r["columns"]}
    assert {("L2", "unit`s.price"), ("Q4", "done.pct"), ("Q3", "task status"), ("T2", "due.date")} <= got
    assert result.health.first()["health_score"] < 100


def test_a_run_with_a_failed_family_has_no_score(spark):
    def broken(df, context, counted):
        raise RuntimeError("no such thing")

    df = spark.createDataFrame([(0, 5.0)], "id bigint, cost double")
    families = dict.fromkeys(FAMILIES, broken)
    result = audit_table(df, CheckContext(ColumnRoles(), ID, AS_OF), scratch_path(spark, "all_broken"), families=families)
    row = result.health.first()
    assert row["health_score"] is None and row["n_failed"] == 5
    text = issues.executive_summary(result.health).first()["summary"]
    assert "5 check families failed" in text
    assert result.health.select(issues.score_band(F.col("health_score"))).first()[0] == "unknown"


def test_long_texts_are_compared_as_documents(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(0, words, "alpha"), (1, words + " more", "beta"), (2, " ".join(f"other{i}" for i in range(60)), "gamma"), (3, None, None)]
    df = spark.createDataFrame(rows, "id bigint, body string, short_name string")
    roles = ColumnRoles({"body": "text", "short_name": "name"}, ("id",))
    result = audit_table(df, CheckContext(roles, ID, AS_OF), scratch_path(spark, "long"), agents=("duplicate_hunter",))
    assert keys(result.findings, "D3") == [0, 1]


def test_spellings_shown_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "SHOWN_SPELLINGS", 2)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["done", "Done", "DONE", "dOne", "open"])], "id bigint, status string")
    details = {r["detail"] for r in quality.casing_findings(df, ["status"], ID).collect()}
    assert details == {"DONE, Done (+2 more)"}
