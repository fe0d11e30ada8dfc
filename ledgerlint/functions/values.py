"""Column expressions for messy values. All of them stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlint.settings import (
    DATE_FORMATS,
    NULL_TOKENS,
    NUMBER_PLACEHOLDERS,
    SEVERITY_RANK,
    UNKNOWN_SEVERITY_RANK,
)

KEY_SEPARATOR = "|"


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters the name has (dots, blanks, backticks)."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StringType)


def is_complex(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def is_temporal(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f)]


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def holds(condition: Column) -> Column:
    """A condition with SQL's 'unknown' read as false."""
    return F.coalesce(condition, F.lit(False))


def null_tokens_to_null(column: Column, tokens=NULL_TOKENS) -> Column:
    return F.when(~column.isin(*tokens), column)


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"


def parse_number(column: Column) -> Column:
    """Text to double; NULL where it is no number ('nan' is none).

    A failed cast costs far more than a pattern match, so only what looks like a number is cast.
    """
    return F.when(column.rlike(NUMBER), column.try_cast("double"))


#: All text that a cast to a whole number takes; the cast also passes over control characters around it.
WHOLE = r"^[\x00-\x20\x7f]*[+-]?[0-9]+[\x00-\x20\x7f]*$"


def parse_whole(column: Column) -> Column:
    """Text to bigint; NULL where it is no whole number or too large. As above, only what looks like one is cast."""
    return F.when(column.rlike(WHOLE), column.try_cast("bigint"))


def loose_number(column: Column) -> Column:
    """Currency or percentage text to double, with 0 for missing, placeholder and other text."""
    bare = F.trim(F.regexp_replace(column.cast("string"), "[%$,]", ""))
    number = F.when(~bare.isin(*NUMBER_PLACEHOLDERS), parse_number(bare))
    return F.coalesce(number, F.lit(0.0))


def parse_date(df: DataFrame, name: str, formats=DATE_FORMATS) -> Column:
    """A date or timestamp column as it is; text by the first format that fits, else NULL."""
    field = df.schema[name]
    column = named(name)
    if is_temporal(field):
        return column
    return parse_date_text(column.cast("string"), formats)


def date_shape(date_format: str) -> str:
    """A regular expression that every text of the date format matches."""
    def piece(run: str) -> str:
        if run[0] in "yu":
            return r"[+-]?\d{%d,}" % (len(run) if len(run) == 2 else min(len(run), 4))
        if run[0] in "MdHhms" and len(run) <= 2:
            return r"\d{2}" if len(run) == 2 else r"\d{1,2}"
        return ".+" if run[0].isalpha() or run[0] in "'[]" else re.escape(run)

    return "^" + "".join(piece(m.group()) for m in re.finditer(r"([A-Za-z'\[\]])\1*|[^A-Za-z'\[\]]", date_format)) + "$"


def parse_date_text(column: Column, formats=DATE_FORMATS, any_text: bool = False) -> Column:
    """Date by the first format that fits. ``any_text`` says that most values may be no dates at all:
    they then cost a pattern match, not a failed parse."""
    def text(f):
        return F.when(column.rlike(date_shape(f)), column) if any_text else column

    return F.coalesce(*[F.try_to_date(text(f), f) for f in formats])


def printable(field: T.StructField) -> Column:
    """A column as text: JSON for nested values, the plain cast otherwise."""
    column = named(field.name)
    if isinstance(field.dataType, T.StringType):
        return column
    if is_complex(field):
        return F.to_json(column)
    return column.cast("string")


def key_text(*names: str) -> Column:
    """Readable row key; a missing part shows as an empty string."""
    return F.concat_ws(KEY_SEPARATOR, *[F.coalesce(named(n).cast("string"), F.lit("")) for n in names])


def _canonical(column: Column, data_type: T.DataType) -> Column:
    """``column`` as a value whose JSON text differs whenever the value does.

    NaN counts as missing and -0.0 as 0.0, inside nested values too. Times are written to the microsecond: as
    counts since the epoch, which no format and no time zone can round or merge.
    """
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return nan_to_null(column) + F.lit(0.0)
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(data_type, T.TimestampNTZType):
        return column.cast("string")
    if isinstance(data_type, T.VariantType):
        return F.to_json(column)
    if isinstance(data_type, T.ArrayType):
        return F.transform(column, lambda x: _canonical(x, data_type.elementType))
    if isinstance(data_type, T.StructType):
        fields = [_canonical(column.getField(f.name), f.dataType).alias(f.name) for f in data_type.fields]
        return F.when(column.isNotNull(), F.struct(*fields)) if fields else column
    if isinstance(data_type, T.MapType):
        return F.array_sort(F.transform(F.map_entries(column), lambda e: F.to_json(F.struct(
            _canonical(e["key"], data_type.keyType).alias("k"), _canonical(e["value"], data_type.valueType).alias("v"),
        ), {"ignoreNullFields": "false"})))
    return column


def row_digest(df: DataFrame, names) -> Column:
    """32 bytes that are equal exactly when all the named columns are equal, nulls included.

    NaN counts as missing and -0.0 equals 0.0, as in the checks that use it; times differ by the microsecond.
    """
    canonical = [_canonical(named(n), df.schema[n].dataType).alias(n) for n in names]
    text = F.to_json(F.struct(*canonical), {"ignoreNullFields": "false"})
    # Never NULL, and declared so: joins on the digest then need no null test of all the columns.
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


def row_hash(df: DataFrame, names) -> Column:
    """8 bytes that are equal where ``row_digest`` is, and hardly ever elsewhere."""
    return F.xxhash64(*[_canonical(named(n), df.schema[n].dataType) for n in names])


def value_digest(column: Column) -> Column:
    """32 bytes that stand for a text in joins; never NULL."""
    return F.coalesce(F.unhex(F.sha2(column, 256)), F.lit(b""))


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One row with the columns of several one-row tables, by a union and an aggregate."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def severity_rank(column: Column) -> Column:
    ranked = F.when(F.lit(False), F.lit(UNKNOWN_SEVERITY_RANK))
    for severity, rank in SEVERITY_RANK.items():
        ranked = ranked.when(column == severity, F.lit(rank))
    return ranked.otherwise(F.lit(UNKNOWN_SEVERITY_RANK))


def column_list(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")
