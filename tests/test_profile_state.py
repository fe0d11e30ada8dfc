"""States of parts, merged, against the profile of the whole; keys of several columns; co-moments; samples."""

import datetime
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlint.operators import profile, profile_state, schema
from ledgerlint.queries import profile_queries


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(4)
    rows = [
        (i, draw.choice("abcdefg") if draw.random() > 0.1 else None, draw.gauss(1e6, 3) if draw.random() > 0.2 else None,
         draw.choice([math.nan, 1.0, 2.0]), None, draw.choice(["x", "y", None]))
        for i in range(4000)
    ]
    return spark.createDataFrame(rows, "id bigint, `a.letter` string, number double, other double, nothing double, part string")


def test_merged_states_equal_the_profile_of_the_whole(table):
    columns = ["id", "a.letter", "number", "other", "nothing"]
    whole = {r["column"]: r for r in profile_state.profile(profile_state.accumulate(table, columns)).collect()}
    parts = profile_state.accumulate(table, columns, part=F.col("part"))
    assert parts.select("part").distinct().count() == 3
    merged = {r["column"]: r for r in profile_state.profile(profile_state.combine(parts.drop("part"))).collect()}
    stats = {r["column"]: r for r in profile.column_stats(table, columns).collect()}
    moments = {r["column"]: r for r in profile.numeric_stats(
        table.withColumn("other", F.nanvl("other", F.lit(None).cast("double"))), ["id", "number", "other"]).collect()}
    for c in columns:
        for name in ("n_rows", "null_count", "min", "max", "min_text", "max_text", "top"):
            assert merged[c][name] == whole[c][name], (c, name)
        assert merged[c]["null_count"] == stats[c]["null_count"]
        assert abs(merged[c]["distinct_estimate"] - stats[c]["distinct_count"]) <= 0.03 * stats[c]["distinct_count"]
    for c, exact in moments.items():
        for name in ("mean", "std", "std_pop", "skewness"):
            assert math.isclose(merged[c][name], exact[name], rel_tol=1e-6, abs_tol=1e-9), (c, name)
    values = sorted(r["number"] for r in table.where("number is not null").collect())
    for q, got in zip((0.25, 0.5, 0.75), merged["number"]["quantiles"]):
        assert abs(np.searchsorted(values, got) / len(values) - q) < 0.02
    assert merged["nothing"]["mean"] is None and merged["nothing"]["quantiles"] is None


def test_frequent_values_say_what_they_missed(spark):
    parts = [["a"] * 9 + ["b"] * 8 + ["c"] * 7, ["c"] * 9 + ["b"] * 3 + ["a"] * 2]
    states = [
        profile_state.accumulate(spark.createDataFrame([(v,) for v in p], "v string"), top=2, origin={}) for p in parts]
    row = profile_state.profile(profile_state.combine(states, 2)).first()
    # c was cut from the first state (7 rows), a from the second (2): counts are short by at most that.
    assert [(t["value"], t["n"]) for t in row["top"]] == [("b", 11), ("a", 9)] and row["missed"] >= 7 + 2


def test_a_state_of_no_rows(spark):
    empty = spark.createDataFrame([], "a string, n double")
    row = {r["column"]: r for r in profile_state.profile(profile_state.combine(profile_state.accumulate(empty))).collect()}
    assert row["a"]["n_rows"] == 0 and row["n"]["mean"] is None


def brute_keys(rows, names, most):
    keys = []
    for size in range(1, most + 1):
        for s in itertools.combinations(range(len(names)), size):
            part = [tuple(r[i] for i in s) for r in rows]
            if all(v is not None for p in part for v in p) and len(set(part)) == len(part):
                if not any(set(k) < set(s) for k in keys):
                    keys.append(s)
    return {tuple(names[i] for i in k) for k in keys}


@pytest.mark.parametrize("seed", range(3))
def test_minimal_keys_equal_brute_force(spark, seed):
    draw = random.Random(seed)
    names = ["a.b", "c d", "e`f", "g", "h"]
    rows = [(i // 6, i % 6, draw.randrange(3), None if i == 7 and seed else draw.randrange(40), draw.choice("uvw")) for i in range(60)]
    df = spark.createDataFrame(rows, ["x1", "x2", "x3", "x4", "x5"]).toDF(*names)
    found = {tuple(r["columns"]) for r in schema.minimal_keys(df).collect()}
    assert found == brute_keys(rows, names, 3) and ("a.b", "c d") in found


def test_no_keys_of_an_empty_or_constant_table(spark):
    assert schema.minimal_keys(spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")).count() == 0
    assert schema.minimal_keys(spark.createDataFrame([], "a int, b int")).count() in (0, 2)


def test_correlations_of_many_columns_in_one_pass(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(500, 40)) + 1e7
    x[:, 3] = 5.0
    x[:, 5] = x[:, 4] * -2
    x[draw.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame([[None if math.isnan(v) else float(v) for v in r] for r in x], [f"c.{i}" for i in range(40)])
    pairs = list(itertools.combinations(df.columns, 2))
    block = {(r["column_a"], r["column_b"]): r for r in profile.correlations(df).collect()}
    assert set(block) == set(pairs)
    for (a, b), r in block.items():
        i, j = int(a[2:]), int(b[2:])
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        want = None if 3 in (i, j) else np.corrcoef(x[both, i], x[both, j])[0, 1]
        assert (r["correlation"] is None) == (want is None) and (want is None or abs(r["correlation"] - want) < 1e-8)
    some = [("c.7", "c.2"), ("c.4", "c.5"), ("c.3", "c.1"), ("c.2", "c.7")]
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in profile.correlations(df, pairs=some).collect()}
    assert got == {(a, b): block[min((a, b), (b, a))]["correlation"] for a, b in some}
    assert block["c.3", "c.4"]["correlation"] is None and block["c.4", "c.5"]["correlation"] < -0.999999
    plan = profile.correlation_matrix(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("order", ["n", "name"])
def test_samples_read_the_table_twice_whatever_its_columns(spark, tmp_path, order):
    draw = random.Random(2)
    rows = [(i, f"k{i:05d}", *[draw.choice([None, i]) if j % 2 else (i if i % 900 == 899 else None) for j in range(6)]) for i in range(3000)]
    draw.shuffle(rows)
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "n bigint, name string, a int, b int, c int, d int, e int, `f.g` int").write.parquet(path)
    df = spark.read.parquet(path)
    names = ["a", "b", "c", "d", "e", "f.g"]
    got = profile.column_samples(df, order, names)
    plan = got._jdf.queryExecution().executedPlan().toString()
    expected = []
    for j, c in enumerate(names):
        kept = [str(r[2 + j]) for r in sorted(rows, key=lambda r: r[0]) if r[2 + j] is not None][:5]
        expected += [(c, i, v) for i, v in enumerate(kept)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    assert plan.count("FileScan") == 1 and "WindowGroupLimit" in plan


@pytest.mark.parametrize("colliding", [False, True])
def test_sets_are_verified_by_hashes_and_then_digests(spark, monkeypatch, colliding):
    rows = [(i // 40, i % 40, float(i), i if i != 77 else 76) for i in range(1600)]
    df = spark.createDataFrame(rows, "a int, b int, c double, d int")
    if colliding:  # all hashes agree: the digests decide
        monkeypatch.setattr(schema, "row_hash", lambda df, names: F.lit(0).cast("bigint"))
    sets = [("a", "b"), ("c",), ("d",), ("a", "d"), ("b", "d"), ("a",)]
    assert schema._verified(df, sets, 1600) == [("a", "b"), ("c",), ("b", "d")]
    assert schema._repeating(df, sets, 1) == {("d",), ("a", "d"), ("a",)}
    zeros = spark.createDataFrame([(0.0, [0.0]), (-0.0, [-0.0])], "a double, l array<double>")
    assert schema._verified(zeros, [("a",), ("l",), ("a", "l")], 2) == []


def test_exact_ranks_of_the_merged_profile_are_no_single_aggregate(spark, tmp_path):
    rows = [(i % 7, float(i), float(i % 100), "ab"[i % 2], datetime.datetime(2020, 1, 1 + i % 20)) for i in range(500)]
    lines = spark.createDataFrame(
        rows, "l_linenumber int, l_extendedprice double, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = profile_queries.merged_profile(spark, str(tmp_path))
    assert "percentile(" not in found._jdf.queryExecution().analyzed().toString()
    assert {r["column"]: (r["distinct_is_near"], r["median_is_near"]) for r in found.collect()} == {
        c: (True, True) for c in profile_queries.MEASURES_OF_STATE}
