"""Profiles that merge: the state of a part of a table, to be stored, combined with others and read off.

``accumulate`` makes one small row per column from one pass: counts, extremes and moments, a distinct-count sketch (HLL), a
quantile sketch of numbers (KLL) and the most frequent values. ``combine`` adds up the states of any parts, so a new
partition is profiled alone and joins the stored states of the old ones; nothing is scanned again. ``profile`` reads a state.

Counts, NULLs, minimum and maximum are exact, and so are the moments but for the order of summing. Distinct counts have a
standard error of about 0.6% (HLL, 2**14 registers), quantiles a rank error of about 1.65% at most (KLL, k = 200), both after
any number of merges. Of the frequent values each state keeps the ``TOP`` most frequent; a count is a lower bound, and
``missed`` says how many more rows a value may have, listed or not: the sum over the parts of the smallest count that was kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlint.functions.values import is_numeric, nan_to_null, printable

HLL_REGISTERS = 14
TOP = 100
#: Sums of powers of the distance from ``origin``, a value near the first rows' mean that all states of a table share.
POWERS = ("s1", "s2", "s3")


def origins(df: DataFrame, columns=None) -> dict[str, float]:
    """{column: a number near its values}, from the first rows; any numbers are right, these keep the moments exact."""
    numbers = [f.name for f in df.schema.fields if is_numeric(f) and f.name in (columns or df.columns)]
    if not numbers:
        return {}
    head = df.limit(1000).agg(*[F.avg(nan_to_null(_number(df, c))).alias(f"m{i}") for i, c in enumerate(numbers)]).first()
    return {c: float(head[f"m{i}"] or 0.0) for i, c in enumerate(numbers)}


def _number(df: DataFrame, name: str) -> Column:
    return printable(df.schema[name]).try_cast("double")


def accumulate(
    df: DataFrame, columns=None, origin: dict[str, float] | None = None, top: int = TOP, part: Column | None = None,
) -> DataFrame:
    """One row per column, and per ``part`` if that is given: the state of this table or of its parts, from one pass.

    States to be combined need the same ``origin``. A store of profiles begins with the states of all parts; those of
    later partitions are appended.
    """
    names = list(columns or df.columns)
    own = [part.cast("string").alias("part")] if part is not None else []
    group = ["part"] if own else []
    origin = origins(df, names) if origin is None else origin
    agg, rows = [F.count("*").alias("n")], []
    for i, c in enumerate(names):
        field = df.schema[c]
        text = printable(field)
        number = nan_to_null(_number(df, c)) if is_numeric(field) else F.lit(None).cast("double")
        away = number - F.lit(origin.get(c, 0.0))
        kll = F.kll_sketch_agg_double(number) if is_numeric(field) else F.lit(None).cast("binary")
        parts = {
            "n_values": F.count(text), "n_numbers": F.count(number), "min": F.min(number), "max": F.max(number),
            "min_text": F.min(text), "max_text": F.max(text),
            "s1": F.sum(away), "s2": F.sum(away * away), "s3": F.sum(away * away * away),
            "hll": F.hll_sketch_agg(text, F.lit(HLL_REGISTERS)), "kll": kll,
        }
        agg += [part.alias(f"{name}_{i}") for name, part in parts.items()]
        rows.append(F.struct(
            *group, F.lit(c).alias("column"), F.lit(field.dataType.simpleString()).alias("dtype"),
            F.lit(origin.get(c, 0.0)).alias("origin"), F.col("n").alias("n_rows"),
            *[F.col(f"{name}_{i}").alias(name) for name in parts]))
    facts = df.groupBy(*own).agg(*agg).select(F.inline(F.array(*rows)))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), printable(df.schema[c]).alias("value")) for c in names])
    counts = df.select(*own, F.inline(cells)).where(F.col("value").isNotNull()).groupBy(*group, "column", "value").agg(
        F.count("*").alias("n"))
    # A part is a row of the join's condition even where it is NULL.
    left, right = facts.alias("l"), _frequent(counts, [*group, "column"], top).alias("r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "column"]]
    return left.join(right, same, "left").select(
        "l.*", "r.top", F.coalesce("r.missed", F.lit(0)).cast("bigint").alias("missed"))


def _frequent(counts: DataFrame, group: list[str], top: int) -> DataFrame:
    """(group, top, missed) of (group, value, n): the values of the largest counts, cut inside each task first."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "value"))
    kept = counts.withColumn("rank", rank).where(F.col("rank") <= top + 1)
    inside = F.col("rank") <= top
    return kept.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.when(inside, F.struct((-F.col("n")).alias("rank"), "value")))).alias("top"),
        # What was cut off is at most as frequent as the first value cut off.
        F.coalesce(F.max(F.when(~inside, F.col("n"))), F.lit(0)).alias("missed"))


def combine(states, top: int = TOP) -> DataFrame:
    """The state of several parts together; ``states`` is one table of states or a list of such tables."""
    together = states if isinstance(states, DataFrame) else reduce(DataFrame.unionByName, states)
    merged = together.groupBy("column").agg(
        F.first("dtype").alias("dtype"), F.first("origin").alias("origin"),
        *[F.sum(c).alias(c) for c in ("n_rows", "n_values", "n_numbers")],
        F.min("min").alias("min"), F.max("max").alias("max"), F.min("min_text").alias("min_text"),
        F.max("max_text").alias("max_text"), *[F.sum(c).alias(c) for c in POWERS],
        F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll").alias("kll"),
        F.sum("missed").alias("earlier"))
    values = together.select("column", F.inline("top")).groupBy("column", "value").agg((-F.sum("rank")).alias("n"))
    return merged.join(_frequent(values, ["column"], top).withColumnRenamed("missed", "cut"), "column", "left").select(
        *[c for c in merged.columns if c != "earlier"], "top",
        (F.col("earlier") + F.coalesce("cut", F.lit(0))).cast("bigint").alias("missed"))


def profile(state: DataFrame, quantiles=(0.25, 0.5, 0.75)) -> DataFrame:
    """One row per column: counts, estimates, moments, quantiles and frequent values of a state."""
    n, s1, s2, s3 = (F.col(c) for c in ("n_numbers", *POWERS))
    mean = s1 / n
    second = F.greatest(s2 / n - mean * mean, F.lit(0.0))
    third = s3 / n - 3 * mean * s2 / n + 2 * mean * mean * mean
    some = F.col("n_numbers") > 0
    return state.select(
        "column", "dtype", "n_rows", (F.col("n_rows") - F.col("n_values")).alias("null_count"),
        F.try_divide((F.col("n_rows") - F.col("n_values")) * 100.0, F.col("n_rows")).alias("null_pct"),
        F.coalesce(F.hll_sketch_estimate("hll"), F.lit(0)).alias("distinct_estimate"), "min", "max", "min_text", "max_text",
        F.when(some, mean + F.col("origin")).alias("mean"),
        F.when(n > 1, F.sqrt(second * n / (n - 1))).alias("std"), F.when(some, F.sqrt(second)).alias("std_pop"),
        F.when(some & (second > 0), third / F.pow(second, 1.5)).alias("skewness"),
        F.when(some, F.kll_sketch_get_quantile_double("kll", F.array(*[F.lit(float(q)) for q in quantiles]))).alias("quantiles"),
        F.transform("top", lambda x: F.struct(x["value"].alias("value"), (-x["rank"]).alias("n"))).alias("top"), "missed")
