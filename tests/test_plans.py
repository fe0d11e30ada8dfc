"""Physical plans: what is read, what moves, and what must never appear."""

import pytest

import __spark_entry__ as entry_point
from ledgerlint.operators import duplicates, logic, profile, sheet_checks as sc
from ledgerlint.operators.findings import RowKey, row_findings, summarise
from ledgerlint.queries.registry import QUERIES
from ledgerlint.queries.views import AS_OF, SHEET, view
from ledgerlint.streaming import rules as streaming
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
EAGER = {"tracker_audit", "I14_run_stats", "I14_run_totals", "I14_whole_audit", "I14_whole_score", "I14_odd_column_names"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_row_rules_push_filters_and_columns_to_the_scan_and_shuffle_nothing(spark):
    customers = table(spark, "customer")
    rules = logic.negative_amount_rules(customers, ["c_acctbal"])
    plan = plan_of(row_findings(customers, rules, RowKey(("c_custkey",), "c_custkey")))
    assert "LessThan(c_acctbal,0.0)" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in plan
    assert "Exchange" not in plan


def test_sheet_checks_take_one_pass(spark):
    sheet = view(spark, FOLDER, SHEET)
    plan = plan_of(sc.row_issues(sheet, sc.sheet_rules(sheet, AS_OF)))
    assert "Exchange" not in plan and plan.count("FileScan") == 1


def test_numeric_profile_is_one_aggregate(spark):
    plan = plan_of(profile.numeric_stats(table(spark, "lineitem"), ["l_quantity", "l_tax"]))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in plan


def test_duplicates_move_digests_after_combining(spark):
    plan = plan_of(duplicates.duplicate_groups(table(spark, "documents"), ["text"]))
    assert "partial_count" in plan and plan.count("Exchange") == 1


def test_summary_limits_rows_before_the_shuffle(spark):
    customers = table(spark, "customer")
    found = row_findings(
        customers, logic.negative_amount_rules(customers, ["c_acctbal"]), RowKey(("c_custkey",), "c_custkey")
    )
    assert "WindowGroupLimit" in plan_of(summarise(found))


entry_point.queries()  # loads the modules that register them


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_query_multiplies_tables(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_row_rules_on_a_stream_equal_the_batch(spark, tmp_path):
    events = table(spark, "events")
    rules = [logic.RowRule("L2", "business_logic", "too_large", ("value",), F.col("value") > 100)]
    key = RowKey(("event_id",), "event_id")
    path = str(tmp_path / "events")
    events.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)

    def run(df, name, mode):
        started = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        started.awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()), key=str)

    assert run(streaming.stream_findings(stream, rules, key), "found", "append") == sorted(
        map(tuple, row_findings(events, rules, key).collect()), key=str
    )
    condition = F.col("value") > 100
    assert run(streaming.violation_rate(stream, "ts", condition), "rate", "complete") == sorted(
        map(tuple, streaming.violation_rate(events, "ts", condition).collect()), key=str
    )
