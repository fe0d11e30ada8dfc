"""Input clean-up that the checks rely on, and stable row numbers for file scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlint.functions.values import named, nan_to_null, null_tokens_to_null
from ledgerlint.session import stored
from ledgerlint.settings import NULL_TOKENS


def normalize(df: DataFrame, tokens=NULL_TOKENS) -> DataFrame:
    """Missing-value words in text columns and NaN in number columns become NULL. One projection."""
    def clean(field: T.StructField):
        column = named(field.name)
        if isinstance(field.dataType, T.StringType) and tokens:
            return null_tokens_to_null(column, tokens).alias(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return nan_to_null(column).alias(field.name)
        return column

    return df.select(*[clean(f) for f in df.schema.fields])


#: Tables of file blocks are broadcast up to this many rows, each of a path and three numbers.
BLOCKS_TO_BROADCAST = 50_000


def place_rows(scan: DataFrame) -> DataFrame:
    """The rows of a file scan, stored with the place they were read from: file, block, number within the task.

    ``scan`` must read files directly (no shuffle in between). The numbers are drawn once, here; whatever is
    derived later reads the stored ones, so it does not matter how a second scan would split the files.
    """
    return stored(scan.select(
        F.col("_metadata.file_path").alias("__path"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__seen"),
        *map(named, scan.columns),
    ), "placed")


def number_placed(rows: DataFrame, placed: DataFrame | None = None, order: str = "row_index") -> DataFrame:
    """Stored rows with their 0-based position over all files, in the order of file name, then place in the file.

    The rows of each block are counted; sums over the blocks before give every block its first number. ``placed`` are the
    stored rows if ``rows`` were derived from them.
    """
    blocks = (rows if placed is None else placed).groupBy("__path", "__block").agg(
        F.count("*").alias("__rows"), F.min("__seen").alias("__first")
    )
    # One row per block of the files, not per row of the table.
    before = Window.orderBy("__path", "__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(blocks.select(
        "__path", "__block", "__first",
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).cast("bigint").alias("__offset"),
    ), "blocks")
    side = F.broadcast(offsets) if offsets.count() <= BLOCKS_TO_BROADCAST else offsets
    return (
        rows.join(side, ["__path", "__block"])
        .withColumn(order, F.col("__offset") + F.col("__seen") - F.col("__first"))
        .drop("__path", "__block", "__seen", "__first", "__offset")
    )


def number_rows(scan: DataFrame, order: str = "row_index") -> DataFrame:
    """A file scan with the 0-based position of every row over all its files."""
    return number_placed(place_rows(scan), order=order)


def as_snapshot(numbered: DataFrame, first_row_id: int = 20000, tokens=NULL_TOKENS) -> DataFrame:
    """Numbered rows as a sheet: row_id, row_number and the columns with missing words as NULL."""
    return normalize(
        numbered.select(
            (F.col("row_index") + first_row_id).alias("row_id"),
            (F.col("row_index") + 1).alias("row_number"),
            *[named(c) for c in numbered.columns if c != "row_index"],
        ),
        tokens,
    )


def sheet_snapshot(scan: DataFrame, first_row_id: int = 20000, tokens=NULL_TOKENS) -> DataFrame:
    """A file scan as a sheet."""
    return as_snapshot(number_rows(scan), first_row_id, tokens)
