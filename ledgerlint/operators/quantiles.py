"""Exact quantiles of numeric columns whose state stays small however many distinct values there are."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlint.functions.values import named

LAST_MILE = 100_000
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, columns, probabilities, last_mile: int = LAST_MILE):
    """{column: [quantile, ...]} with linear interpolation; None for a column without values.

    Each wanted rank is bracketed: an approximate sketch of bounded size gives two data values around the
    rank, one aggregate counts the rows on either side, and the next round looks only between the two. The
    bracket shrinks by a factor of thousands per round, so two rounds serve 10^12 rows. The last few rows of all brackets
    are read in one pass, whatever the number of columns and ranks, and ordered bracket by bracket. The same is
    done at every size of the table; no state holds all distinct values.
    """
    columns = list(columns)
    counts = df.agg(*[F.count(named(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    sizes = {c: counts[f"n{i}"] for i, c in enumerate(columns)}

    wanted = {}
    for c in columns:
        for p in probabilities:
            place = (sizes[c] - 1) * p
            for rank in {math.floor(place), math.ceil(place)} if sizes[c] else ():
                wanted[(c, rank)] = None
    values = order_statistics(df, sizes, list(wanted), last_mile)

    result = {}
    for c in columns:
        if not sizes[c]:
            result[c] = None
            continue
        result[c] = []
        for p in probabilities:
            place = (sizes[c] - 1) * p
            low, high = math.floor(place), math.ceil(place)
            a, b = values[(c, low)], values[(c, high)]
            result[c].append(a if low == high else (high - place) * a + (place - low) * b)
    return result


def order_statistics(df: DataFrame, sizes: dict, ranks: list, last_mile: int = LAST_MILE) -> dict:
    """{(column, rank): value} for 0-based ranks, searching all of them together."""
    found: dict = {}
    # per rank: open interval (low, high) of values, rows at or below low, rows inside
    open_ranks = {r: (None, None, 0, sizes[r[0]]) for r in ranks}
    last: dict = {}
    while open_ranks:
        last.update({r: found_in for r, found_in in open_ranks.items() if found_in[3] <= last_mile})
        open_ranks = {r: found_in for r, found_in in open_ranks.items() if r not in last}
        if open_ranks:
            open_ranks = _narrow(df, open_ranks, found)
    return found | _read_ranks(df, last)


def _inside(column: str, low, high):
    value = named(column).cast("double")
    condition = value.isNotNull()
    if low is not None:
        condition &= value > F.lit(low)
    if high is not None:
        condition &= value < F.lit(high)
    return F.when(condition, value)


def _read_ranks(df: DataFrame, brackets: dict) -> dict:
    """{(column, rank): value}: one pass brings the values of all brackets, each of at most LAST_MILE rows."""
    if not brackets:
        return {}
    # Ranks of a column in one bracket share its rows.
    windows = list(dict.fromkeys((r[0], low, high) for r, (low, high, _, _) in brackets.items()))
    inside = F.array(*[
        F.struct(F.lit(i).alias("bracket"), _inside(c, low, high).alias("v")) for i, (c, low, high) in enumerate(windows)])
    values = df.select(F.inline(F.filter(inside, lambda x: x["v"].isNotNull())))
    wanted = [(windows.index((r[0], low, high)), r[1] - below) for r, (low, high, below, _) in brackets.items()]
    place = F.row_number().over(Window.partitionBy("bracket").orderBy("v")) - 1
    chosen = values.select("bracket", "v", place.alias("place")).where(
        F.struct("bracket", F.col("place").cast("int")).isin(*[
            F.struct(F.lit(b), F.lit(int(p))) for b, p in set(wanted)]))
    read = {(r["bracket"], r["place"]): r["v"] for r in chosen.collect()}  # one row per wanted rank
    return {r: read[w] for r, w in zip(brackets, wanted)}


def _narrow(df, open_ranks, found):
    ranks = list(open_ranks)
    # Ranks that look into the same window of a column share one sketch.
    probes: dict = {}
    for r in ranks:
        low, high, below, inside = open_ranks[r]
        at = (r[1] - below + 0.5) / inside
        probes.setdefault((r[0], low, high), {})[r] = [max(0.0, at - 2 / ACCURACY), min(1.0, at + 2 / ACCURACY)]
    sketched = df.agg(*[
        F.percentile_approx(_inside(*window), [p for around in wanted.values() for p in around], ACCURACY).alias(f"w{i}")
        for i, (window, wanted) in enumerate(probes.items())
    ]).first()
    brackets = {
        r: sketched[f"w{i}"][2 * j : 2 * j + 2]
        for i, wanted in enumerate(probes.values()) for j, r in enumerate(wanted)
    }

    # Neighbouring ranks mostly have the same borders; each border is counted once.
    borders = list(dict.fromkeys(
        (r[0], *open_ranks[r][:2], border) for r in ranks for border in brackets[r]))
    tally = df.agg(*[
        count.alias(f"{kind}_{i}") for i, (column, low, high, border) in enumerate(borders)
        for kind, count in (("lt", F.count_if(_inside(column, low, high) < border)),
                            ("le", F.count_if(_inside(column, low, high) <= border)))
    ]).first()
    place = {border: i for i, border in enumerate(borders)}

    still_open = {}
    for r in ranks:
        low, high, below, inside = open_ranks[r]
        b0, b1 = brackets[r]
        at = r[1] - below
        lt0, le0, lt1, le1 = (
            tally[f"{kind}_{place[r[0], low, high, border]}"] for border in (b0, b1) for kind in ("lt", "le"))
        if at < lt0:
            still_open[r] = (low, b0, below, lt0)
        elif at < le0:
            found[r] = b0
        elif at < lt1:
            still_open[r] = (b0, b1, below + le0, lt1 - le0)
        elif at < le1:
            found[r] = b1
        else:
            still_open[r] = (b1, high, below + le1, inside - le1)
    return still_open
