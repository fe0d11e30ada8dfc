import random

import numpy as np
import pytest

from ledgerlint.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("last_mile", [0, 7, 100])
def test_bracketing_equals_sorting(spark, last_mile):
    rng = random.Random(5)
    heavy = [3.0] * 4000 + [rng.gauss(0, 50) for _ in range(8000)]  # one value holds a third of the rows
    tail = [rng.paretovariate(0.3) for _ in range(12000)]
    rows = [(a, b, None if i % 5 else float(i)) for i, (a, b) in enumerate(zip(heavy, tail))]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    got = exact_quantiles(df, ["a", "b", "c"], [0.0, 0.25, 0.5, 0.75, 1.0], last_mile=last_mile)
    for i, c in enumerate("abc"):
        values = [r[i] for r in rows if r[i] is not None]
        assert got[c] == pytest.approx(list(np.quantile(values, [0.0, 0.25, 0.5, 0.75, 1.0])), rel=1e-12)


def test_small_tables(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert exact_quantiles(df, ["v"], [0.25, 0.75]) == {"v": [1.75, 4.75]}


def test_a_column_without_values(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(50)], "e double, v double")
    got = exact_quantiles(df, ["e", "v"], [0.5], last_mile=5)
    assert got["e"] is None and got["v"] == [24.5]
