"""Column profiles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlint.functions.values import is_numeric, is_temporal, named, numeric_columns, parse_date_text, printable, text_columns
from ledgerlint.settings import DATE_FORMATS


def value_counts(df: DataFrame, columns=None) -> DataFrame:
    """(column, value, n): how often every value of every column occurs, NULL included.

    Copies of a value combine inside each task, so a value that fills a third of the table crosses
    the network once per task. Distinct counts, null counts, top values, casing variants and key
    candidates all follow from this one shuffle.
    """
    wanted = set(columns or df.columns)
    fields = [f for f in df.schema.fields if f.name in wanted]
    # A small number stands for the column name on the wire.
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), printable(f).alias("value")) for i, f in enumerate(fields)])
    names = F.array(*[F.lit(f.name) for f in fields])
    return (
        df.select(F.inline(pairs))
        .groupBy("c", "value")
        .agg(F.count("*").alias("n"))
        .select(names[F.col("c")].alias("column"), "value", "n")
    )


def column_facts(counts: DataFrame) -> DataFrame:
    """Per column: rows, nulls, null percentage, distinct non-null values."""
    facts = counts.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
    )
    return facts.withColumn("null_pct", F.col("null_count") * 100.0 / F.col("n_rows"))


def approximate_facts(df: DataFrame, columns) -> DataFrame:
    """The same facts from one aggregate of fixed size: distinct counts within a few percent, and
    nothing but one small row per task crosses the network."""
    agg, rows = [F.count("*").alias("n")], []
    for i, name in enumerate(columns):
        agg += [F.count(named(name)).alias(f"c_{i}"), F.approx_count_distinct(named(name)).alias(f"d_{i}")]
        rows.append(F.struct(
            F.lit(name).alias("column"), F.col("n").alias("n_rows"),
            (F.col("n") - F.col(f"c_{i}")).alias("null_count"), F.col(f"d_{i}").alias("distinct_count"),
        ))
    facts = df.agg(*agg).select(F.inline(F.array(*rows)))
    return facts.withColumn("null_pct", F.try_divide(F.col("null_count") * 100.0, F.col("n_rows")))


def column_stats(df: DataFrame, columns=None, exact: bool = True) -> DataFrame:
    """Type, null count, null percentage and distinct count of every column.

    Exact distinct counts have to bring equal values together; ``exact=False`` sketches them.
    """
    names = list(columns or df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    known = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(types[n]))])
    facts = column_facts(value_counts(df, names)) if exact else approximate_facts(df, names)
    return facts.select(
        "column",
        known[F.col("column")].alias("dtype"),
        "n_rows",
        "null_count",
        "null_pct",
        "distinct_count",
    )


#: Ranks at which a column's place is sketched, and the accuracy of the sketch.
SAMPLE_SHARES = (0.0005, 0.005, 0.05, 0.5, 1.0)
SAMPLE_ACCURACY = 10_000


def column_samples(df: DataFrame, order, columns=None, n: int = 5) -> DataFrame:
    """(column, position, value): the first n non-null values of every column in row order.

    Two passes whatever the number of columns. One aggregate sketches where the values of each column lie in the
    row order; the second pass looks only at places before a border that at least n values lie before, as
    (column, place, value) rows of which each task keeps n per column ahead of the shuffle. Where the first order
    column is no number and no time, all places pass the border.
    """
    order = [order] if isinstance(order, str) else list(order)
    names = list(columns or df.columns)
    lead = df.schema[order[0]]
    borders = _sample_borders(df, order[0], names, n) if is_numeric(lead) or is_temporal(lead) else [None] * len(names)
    place = F.struct(*[named(c).alias(f"p{i}") for i, c in enumerate(order)]).alias("place")
    cells = F.array(*[
        F.when(named(c).isNotNull() & (F.lit(True) if border is None else named(order[0]).isNull() | (named(order[0]) <= border)),
               F.struct(F.lit(i).alias("c"), printable(df.schema[c]).alias("value")))
        for i, (c, border) in enumerate(zip(names, borders))])
    values = df.select(place, F.inline(F.array_compact(cells)))
    rank = F.row_number().over(Window.partitionBy("c").orderBy("place", "value"))
    known = F.array(*[F.lit(c) for c in names])
    return values.withColumn("rank", rank).where(F.col("rank") <= n).select(
        known[F.col("c")].alias("column"), (F.col("rank") - 1).cast("int").alias("position"), "value")


def _sample_borders(df: DataFrame, order: str, names, n: int) -> list[Column | None]:
    """Per column a place with at least n of its values at or before it; None for the end of the table."""
    place = {c: F.when(named(c).isNotNull(), named(order)) for c in names}
    found = df.agg(*[x for i, c in enumerate(names) for x in (
        F.count(place[c]).alias(f"n{i}"),
        F.percentile_approx(place[c], list(SAMPLE_SHARES), SAMPLE_ACCURACY).alias(f"p{i}"))]).first()
    borders = []
    for i, _ in enumerate(names):
        total, places = found[f"n{i}"], found[f"p{i}"]
        sure = [p for p, share in zip(places or (), SAMPLE_SHARES) if (share - 2 / SAMPLE_ACCURACY) * total >= n]
        borders.append(F.lit(sure[0]) if sure else None)
    return borders


NUMERIC_STATS = ("count", "min", "max", "mean", "std", "std_pop", "skewness")


def numeric_aggregates(names) -> list:
    parts = []
    for i, name in enumerate(names):
        value = named(name).cast("double")
        parts += [
            F.count(value).alias(f"count_{i}"),
            F.min(value).alias(f"min_{i}"),
            F.max(value).alias(f"max_{i}"),
            F.avg(value).alias(f"mean_{i}"),
            F.stddev_samp(value).alias(f"std_{i}"),
            F.stddev_pop(value).alias(f"std_pop_{i}"),
            F.skewness(value).alias(f"skewness_{i}"),
        ]
    return parts


def numeric_stats(df: DataFrame, columns=None, counted: DataFrame | None = None) -> DataFrame:
    """Count, min, max, mean, both deviations and population skewness of every numeric column.

    One aggregate over all columns: one scan, one partial row per task, no other shuffle.
    ``counted`` is the one-row result of numeric_aggregates, if an earlier pass has it already.
    """
    names = list(columns or numeric_columns(df))
    rows = [
        F.struct(F.lit(name).alias("column"), *[F.col(f"{stat}_{i}").alias(stat) for stat in NUMERIC_STATS])
        for i, name in enumerate(names)
    ]
    if counted is None:
        counted = df.agg(*numeric_aggregates(names))
    return counted.select(F.inline(F.array(*rows)))


def date_column_ratios(df: DataFrame, formats=DATE_FORMATS, columns=None) -> DataFrame:
    """Per text column: non-null values, values that parse as a date, and their share."""
    names = list(columns or text_columns(df))
    agg = []
    for i, name in enumerate(names):
        agg += [F.count(named(name)).alias(f"n_{i}"), F.count(parse_date_text(named(name), formats, any_text=True)).alias(f"d_{i}")]
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            F.col(f"n_{i}").alias("n_values"),
            F.col(f"d_{i}").alias("n_dates"),
            F.try_divide(F.col(f"d_{i}").cast("double"), F.col(f"n_{i}")).alias("date_ratio"),
        )
        for i, name in enumerate(names)
    ]
    return df.agg(*agg).select(F.inline(F.array(*rows)))


def detect_date_columns(df: DataFrame, formats=DATE_FORMATS, columns=None, min_ratio: float = 1.0) -> DataFrame:
    """Text columns whose values are dates, judged on all rows."""
    return date_column_ratios(df, formats, columns).where(
        (F.col("n_values") > 0) & (F.col("date_ratio") >= min_ratio)
    )


def value_distribution(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values; equal counts are ordered by value."""
    return (
        value_counts(df.where(named(column).isNotNull()), [column])
        .orderBy(F.desc("n"), "value")
        .limit(n)
    )


def correlations(df: DataFrame, columns=None, pairs=None) -> DataFrame:
    """Pearson correlation of column pairs (all, or ``pairs``) over rows where both are present, with a strength label.

    All pairs come from one block of co-moments; NULL where a column does not vary.
    """
    if pairs is None:
        return _interpreted(correlation_matrix(df, columns))
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    wanted = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(min(i, j)).alias("i"), F.lit(max(i, j)).alias("j"))
        for a, b in pairs for i, j in [(names.index(a), names.index(b))]])
    own = F.filter(wanted, lambda p: (p["i"] == F.col("i")) & (p["j"] == F.col("j")))
    found = _correlated(co_moments(df, names)).select(F.col("correlation"), F.inline(own))
    return _interpreted(found.select(F.col("a").alias("column_a"), F.col("b").alias("column_b"), "correlation"))


def _interpreted(found: DataFrame) -> DataFrame:
    r = F.col("correlation")
    return found.withColumn("correlation", F.when(~F.isnan(r), r)).withColumn(
        "interpretation",
        F.when(F.abs(r) > 0.7, "Strong").when(F.abs(r) > 0.3, "Moderate").otherwise("Weak"),
    )


def co_moments(df: DataFrame, columns=None) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy): for every pair i < j of columns the sums over the rows where both are present.

    A task adds up one block of arrays, columns by columns in size, by matrix products over Arrow batches, and sends it
    as one row per pair; the blocks of all tasks add up. States stored for parts of a table add up as well, if they were
    taken with the same ``columns``. Values are taken relative to the mean of the table's first rows, which
    changes no correlation but keeps the sums of columns with large means exact.
    """
    names = list(columns or numeric_columns(df))
    values = df.select(*[named(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    head = values.limit(1000).agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in values.columns]).first()
    shift = np.array([x if x is not None and math.isfinite(x) else 0.0 for x in head])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shift)
        total = np.zeros((5, size, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - shift
            # Arrow shows a NULL as NaN here; NaN itself counts as missing, as everywhere in the profile.
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            total += [m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, x.T @ x]
        i, j = np.triu_indices(size, 1)
        n, sx, sy, sxx, sxy = (part[i, j] for part in total)
        syy = total[3].T[i, j]
        yield pa.RecordBatch.from_arrays(
            [pa.array(a) for a in (i.astype(np.int32), j.astype(np.int32), n, sx, sy, sxx, syy, sxy)], names=MOMENTS)

    schema = "i int, j int, " + ", ".join(f"{c} double" for c in MOMENTS[2:])
    return values.mapInArrow(block, schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in MOMENTS[2:]])


MOMENTS = ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"]


def _correlated(moments: DataFrame) -> DataFrame:
    """Co-moments with ``correlation``."""
    def centred(square, a, b):
        return F.col(square) - F.try_divide(F.col(a) * F.col(b), F.col("n"))

    # What rounding leaves of the variance of a constant column counts as none.
    def varies(square, a):
        return centred(square, a, a) > F.col(square) * 1e-14

    r = F.try_divide(centred("sxy", "sx", "sy"), F.sqrt(centred("sxx", "sx", "sx") * centred("syy", "sy", "sy")))
    sure = (F.col("n") > 1) & varies("sxx", "sx") & varies("syy", "sy")
    return moments.withColumn("correlation", F.when(sure, F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))))


def correlation_matrix(df: DataFrame, columns=None) -> DataFrame:
    """(column_a, column_b, correlation) of all pairs of columns, from one pass; missing values pairwise."""
    names = list(columns or numeric_columns(df))
    known = F.array(*[F.lit(c) for c in names])
    return _correlated(co_moments(df, names)).select(
        known[F.col("i")].alias("column_a"), known[F.col("j")].alias("column_b"), "correlation")
