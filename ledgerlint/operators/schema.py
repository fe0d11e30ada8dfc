"""What the columns of a table mean, judged from the data first and from the names second."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlint.functions.values import is_complex, is_numeric, is_temporal, named, parse_date, parse_date_text, parse_number, printable, row_digest, row_hash
from ledgerlint.operators.profile import approximate_facts, value_counts
from ledgerlint.session import stored
from ledgerlint.settings import DATE_FORMATS, ColumnRoles, name_has

EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
SURE = 0.8

# Ordered name rules; the first that matches decides.
FILE_NAME_RULES = (
    (("date", "start", "end"), "date"),
    (("status",), "status"),
    (("id",), "id"),
    (("budget", "cost", "amount"), "numeric"),
    (("pct", "percent"), "percentage"),
)
SHEET_NAME_RULES = (
    (("date", "deadline", "due"), "date"),
    (("status", "priority"), "picklist"),
    (("cost", "amount", "budget"), "numeric"),
)


def type_by_name(column: str, numeric: bool, rules=FILE_NAME_RULES) -> str:
    for parts, meaning in rules:
        if name_has(column, parts):
            return meaning
    return "numeric" if numeric and rules is FILE_NAME_RULES else "text"


def column_evidence(df: DataFrame, columns=None, formats=DATE_FORMATS, exact: bool = True) -> DataFrame:
    """Per column the shares of values that look like dates, numbers, 0..100 and e-mail, and the
    share of distinct values.

    Exactly, equal values are brought together and each is parsed once. Otherwise every value is
    parsed where it lies and the distinct count is sketched: one aggregate, nothing to shuffle.
    """
    fields = [df.schema[c] for c in (columns or df.columns)]
    if exact:
        counts = value_counts(df, [f.name for f in fields])
        text, number, weight = F.col("value"), parse_number(F.col("value")), F.col("n")
        temporal = [f.name for f in fields if is_temporal(f)]
        is_date = F.col("column").isin(*temporal) if temporal else F.lit(False)
        sums = _evidence(text, number, is_date, formats, lambda c: F.coalesce(F.sum(F.when(c, weight)), F.lit(0)))
        facts = counts.groupBy("column").agg(
            F.sum("n").alias("n_rows"), F.count("value").alias("n_distinct"),
            *[total.alias(name) for name, total in sums.items()],
        )
    else:
        agg, rows = [F.count("*").alias("n")], []
        for i, field in enumerate(fields):
            text = printable(field)
            sums = _evidence(text, parse_number(text), F.lit(is_temporal(field)), formats, F.count_if)
            sums["n_distinct"] = F.approx_count_distinct(named(field.name))
            agg += [total.alias(f"{name}_{i}") for name, total in sums.items()]
            rows.append(F.struct(
                F.lit(field.name).alias("column"), F.col("n").alias("n_rows"),
                *[F.col(f"{name}_{i}").alias(name) for name in sums],
            ))
        facts = df.agg(*agg).select(F.inline(F.array(*rows)))

    def share(name):
        return F.try_divide(F.col(name).cast("double"), F.col("n_values"))

    return facts.select(
        "column", "n_rows", "n_values", "n_distinct",
        *[share(f"n_{kind}").alias(f"{kind}_ratio") for kind in ("date", "number", "percent", "email", "distinct")],
    )


def _evidence(text, number, is_date, formats, total) -> dict:
    present = text.isNotNull()
    return {
        "n_values": total(present),
        "n_date": total(present & (is_date | parse_date_text(text, formats, any_text=True).isNotNull())),
        "n_number": total(number.isNotNull()),
        "n_percent": total(number.between(0, 100)),
        "n_email": total(text.rlike(EMAIL)),
    }


def semantic_types(df: DataFrame, columns=None, formats=DATE_FORMATS, exact: bool = True) -> DataFrame:
    """(column, spark_type, semantic_type) plus the evidence.

    Data decides where it can: dates, e-mail addresses, numbers. Names settle what data cannot:
    which numbers are percentages or identifiers, which text is a status, however many spellings it has.
    """
    names = list(columns or df.columns)
    evidence = column_evidence(df, names, formats, exact)
    types = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(df.schema[n].dataType.simpleString()))])
    name = F.lower("column")

    def named(*parts):
        return name.rlike("|".join(parts))

    unique = F.col("distinct_ratio") >= 0.9
    meaning = (
        F.when(F.col("n_values") == 0, "text")
        .when(F.col("date_ratio") >= SURE, "date")
        .when(F.col("email_ratio") >= SURE, "email")
        .when((F.col("number_ratio") >= SURE) & named("pct", "percent"), "percentage")
        .when((F.col("number_ratio") >= SURE) & named("id$", "key$") , "id")
        .when(F.col("number_ratio") >= SURE, "numeric")
        .when(named("status"), "status")
        .when(unique & named("id$", "key$"), "id")
        .when(named("name"), "name")
        .otherwise("text")
    )
    return evidence.select(
        "column",
        types[F.col("column")].alias("spark_type"),
        meaning.alias("semantic_type"),
        "n_values",
        "n_distinct",
        "date_ratio",
        "number_ratio",
        "percent_ratio",
        "email_ratio",
        "distinct_ratio",
    )


def date_pairs(df: DataFrame, date_columns, formats=DATE_FORMATS, min_ratio: float = 0.5) -> DataFrame:
    """Start and end columns, proposed by name and kept where most rows are in order.

    All candidate pairs are judged in one aggregate.
    """
    starts = [c for c in date_columns if name_has(c, ("start",))]
    ends = [c for c in date_columns if name_has(c, ("end", "due"))]
    pairs = [(s, e) for s in starts for e in ends if s != e]
    if len(date_columns) < 2 or not pairs:
        return df.sparkSession.createDataFrame(
            [], "start_column string, end_column string, n_rows bigint, ordered_ratio double"
        )
    agg = []
    for i, (s, e) in enumerate(pairs):
        ordered = parse_date(df, s, formats) <= parse_date(df, e, formats)
        agg += [F.count(ordered).alias(f"n_{i}"), F.avg(ordered.cast("int")).alias(f"r_{i}")]
    rows = [
        F.struct(
            F.lit(s).alias("start_column"),
            F.lit(e).alias("end_column"),
            F.col(f"n_{i}").alias("n_rows"),
            F.col(f"r_{i}").alias("ordered_ratio"),
        )
        for i, (s, e) in enumerate(pairs)
    ]
    return df.agg(*agg).select(F.inline(F.array(*rows))).where(F.col("ordered_ratio") > min_ratio)


def key_candidates(df: DataFrame, columns=None) -> DataFrame:
    """Columns that name rows: every row has a value and no two rows share one.

    A sketch of fixed size first rules out the columns that are far from unique, so that only the
    plausible ones have their values brought together. It allows for ten standard errors.
    """
    names = list(columns or df.columns)
    place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    rough = approximate_facts(df, names).where("null_count = 0 and distinct_count >= 0.5 * n_rows")
    plausible = [r["column"] for r in rough.select("column").collect()]
    if not plausible:
        return df.sparkSession.createDataFrame([], "column string, position int, n_rows bigint")
    facts = value_counts(df, plausible).groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.count("value").alias("n_distinct")
    )
    return facts.where(F.col("n_rows") == F.col("n_distinct")).select(
        "column", place[F.col("column")].alias("position"), "n_rows"
    )


def minimal_keys(df: DataFrame, columns=None, most: int = 3) -> DataFrame:
    """(columns, n_rows): all minimal sets of up to ``most`` columns that name rows: no missing part, no two rows alike.

    Level by level: a set is looked at only if no smaller set inside it is a key, and if its columns can tell
    that many rows apart at all (the product of their distinct counts). Sketches of the sets that are left, all of a level in
    one aggregate, rule out those that are far from unique, with ten standard errors to spare; what remains of the level is
    verified exactly in one shuffle of digests. Only counts per set come to the driver.
    """
    names = list(columns or df.columns)
    facts = {r["column"]: r for r in approximate_facts(df, names).collect()}
    n_rows = max((r["n_rows"] for r in facts.values()), default=0)
    whole = [c for c in names if facts[c]["null_count"] == 0]
    found: list[tuple[str, ...]] = []
    for size in range(1, most + 1):
        level = [
            s for s in combinations(whole, size)
            if not any(set(k) <= set(s) for k in found)
            and math.prod(max(facts[c]["distinct_count"], 1) * (1 + SKETCH_SLACK) for c in s) >= n_rows
        ]
        for at in range(0, len(level), SETS_AT_ONCE):
            some = level[at : at + SETS_AT_ONCE]
            sketch = df.agg(*[
                F.approx_count_distinct(_rough_hash(df, s), SKETCH_ERROR).alias(f"s{i}") for i, s in enumerate(some)]).first()
            found += _verified(df, [s for i, s in enumerate(some) if sketch[f"s{i}"] >= n_rows * (1 - SKETCH_SLACK)], n_rows)
    return df.sparkSession.createDataFrame([(list(k), n_rows) for k in found], "columns array<string>, n_rows bigint")


#: Standard error of the sketches of column sets, and what is allowed for it.
SKETCH_ERROR = 0.02
SKETCH_SLACK = 0.2
#: Column sets that one pass looks at.
SETS_AT_ONCE = 64


def _rough_hash(df: DataFrame, columns) -> Column:
    """A cheap hash that may tell equal rows apart (0.0 and -0.0) but hardly merges different ones: sketches only rule out."""
    return F.xxhash64(*[printable(df.schema[c]) if is_complex(df.schema[c]) else named(c) for c in columns])


#: Sets with two equal rows are mostly found out by the first of so many slices of the hashes.
SLICES = 16
#: Up to so many repeated hashes are broadcast.
FEW_REPEATED = 100_000


def _verified(df: DataFrame, sets: list, n_rows: int) -> list:
    """The sets of which no two rows are alike.

    Equal rows have equal hashes, so one slice of the hashes is enough to find that a set repeats; all hashes are brought
    together only for the sets that the slice does not rule out. Rows whose hashes agree are compared by their digests.
    """
    if not sets or not n_rows:
        return []
    left = list(sets)
    for slices in (SLICES, 1):
        if left:
            bad = _repeating(df, left, slices)
            left = [s for s in left if s not in bad]
    return left


def _repeating(df: DataFrame, sets: list, slices: int) -> set:
    """The sets with two equal rows in the first of so many slices of their hashes."""
    used = list(dict.fromkeys(c for s in sets for c in s))
    hashes = F.array(*[F.struct(F.lit(i).alias("__s"), row_hash(df, s).alias("__h")) for i, s in enumerate(sets)])
    if slices > 1:
        hashes = F.filter(hashes, lambda x: F.pmod(x["__h"], F.lit(slices)) == 0)
    rows = df.select(*map(named, used), F.inline(hashes))
    twice = stored(rows.groupBy("__s", "__h").agg(F.count("*").alias("n")).where("n > 1").select("__s", "__h"), "repeated")
    n_twice = twice.count()
    if not n_twice:
        return set()
    met = rows.join(twice.hint("broadcast" if n_twice <= FEW_REPEATED else "merge"), ["__s", "__h"], "left_semi")
    digest = F.coalesce(*[F.when(F.col("__s") == i, row_digest(df, s)) for i, s in enumerate(sets)])
    repeated = met.select("__s", digest.alias("digest")).groupBy("__s", "digest").agg(F.count("*").alias("n")).where("n > 1")
    return {sets[r["__s"]] for r in repeated.select("__s").distinct().collect()}  # at most one row per set


def infer_roles(df: DataFrame, formats=DATE_FORMATS, by_name: bool = False, key=None) -> ColumnRoles:
    """Column roles for an audit. Reads back one small row per column; distinct counts are sketched,
    the key is verified exactly.

    ``by_name`` uses the ordered name rules only and the first column as key.
    """
    if by_name:
        types = {f.name: type_by_name(f.name, is_numeric(f)) for f in df.schema.fields}
        dates = [c for c, t in types.items() if t == "date"]
        pairs = [
            (s, e)
            for s in dates if name_has(s, ("start",))
            for e in dates if name_has(e, ("end", "due"))
        ] if len(dates) >= 2 else []
        return ColumnRoles(types, tuple(key or df.columns[:1]), tuple(pairs), tuple(formats))
    found = {r["column"]: r["semantic_type"] for r in semantic_types(df, formats=formats, exact=False).collect()}
    types = {c: found.get(c, "text") for c in df.columns}
    dates = [c for c, t in types.items() if t == "date"]
    pairs = tuple((r["start_column"], r["end_column"]) for r in date_pairs(df, dates, formats).collect())
    if key is None:
        unique = key_candidates(df).orderBy("position").limit(1).collect()
        key = (unique[0]["column"],) if unique else tuple(df.columns[:1])
    return ColumnRoles(types, tuple(key), pairs, tuple(formats))
