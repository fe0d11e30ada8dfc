"""What an audit writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlint.functions.values import named, text_columns
from ledgerlint.session import stored

#: Values of so many partitions are listed in a filter; more are joined.
PARTITIONS_TO_LIST = 1000

AUDIT_COLUMNS = [
    "Issue ID", "Severity", "Agent", "Title", "Description", "Affected Rows", "Suggested Fix", "Status",
]


def safe_file_name(name: str | None) -> str:
    """A file name for a corrected table: blanks become underscores, non-ASCII characters go."""
    plain = (name or "sheet").replace(" ", "_").encode("ascii", "ignore").decode("ascii")
    return f"{plain}_corrected.csv"


def corrected_columns(df: DataFrame, header) -> DataFrame:
    """The columns of the header in its order, as text, with empty text for NULL and absent columns."""
    return df.select(*[
        (F.coalesce(named(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c)
        for c in header
    ])


def write_corrected_csv(df: DataFrame, header, path: str) -> None:
    (
        corrected_columns(df, header).write.option("header", True).option("emptyValue", "").option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def audit_sheet_name(source_name: str, run_date: str) -> str:
    return f"AUDIT REPORT - {source_name} - {run_date}"


def audit_table(issues: DataFrame, resolved: Column | None = None) -> DataFrame:
    """The eight columns of the audit sheet, one row per issue."""
    done = F.lit(False) if resolved is None else resolved
    return issues.select(
        F.col("issue_id").alias("Issue ID"),
        F.col("severity").alias("Severity"),
        F.col("agent").alias("Agent"),
        F.col("title").alias("Title"),
        F.col("description").alias("Description"),
        F.array_join("affected_rows", ", ").alias("Affected Rows"),
        F.col("suggested_fix").alias("Suggested Fix"),
        F.when(done, "Resolved").otherwise("Open").alias("Status"),
    )


def write_audit_table(issues: DataFrame, path: str, source_name: str, run_date: str, resolved=None) -> None:
    """Append the audit of one run; runs are partitions."""
    audit_table(issues, resolved).withColumns(
        {"audit_name": F.lit(audit_sheet_name(source_name, run_date)), "run_date": F.lit(run_date)}
    ).write.mode("append").partitionBy("run_date").parquet(path)


def check_comments(comments: DataFrame) -> DataFrame:
    """(row_id, comment, status, error, echo): comments without a row or text are rejected."""
    text = F.trim(F.coalesce("comment", F.lit("")))
    error = (
        F.when(F.col("row_id").isNull(), "a comment needs a row")
        .when(text == "", "a comment needs text")
    )
    return comments.select(
        "row_id",
        "comment",
        F.when(error.isNull(), "success").otherwise("failed").alias("status"),
        error.alias("error"),
        F.when(error.isNull(), F.substring("comment", 1, 50)).alias("echo"),
    )


def append_comments(comments: DataFrame, path: str) -> DataFrame:
    """Append the accepted comments; returns the outcome of every comment."""
    checked = check_comments(comments)
    checked.where("status = 'success'").select("row_id", "comment").write.mode("append").parquet(path)
    return checked


def append_cell_flags(flags: DataFrame, path: str) -> None:
    """Append notes on cells; the cells keep their values."""
    flags.select(
        F.col("row_id").cast("bigint").alias("row_id"), F.col("column").cast("string").alias("column"),
        F.col("note").cast("string").alias("note"),
    ).write.mode("append").parquet(path)


def update_cells(df: DataFrame, updates: DataFrame, row_id: str) -> DataFrame:
    """The table with single cells replaced; ``updates`` is (seq, row_id, column, new_value).

    The last update of a cell wins. Unknown rows and columns, and columns that are not text, change
    nothing.
    """
    names = [c for c in text_columns(df) if c != row_id]
    last = updates.groupBy(F.col("row_id").alias("__row"), F.lower("column").alias("column")).agg(
        F.max(F.struct("seq", F.coalesce("new_value", F.lit("")).alias("v"))).alias("u")
    )
    wide = last.groupBy("__row").agg(*[
        F.max(F.when(F.col("column") == c.lower(), F.col("u.v"))).alias(f"__u{i}") for i, c in enumerate(names)
    ])
    joined = df.join(wide, named(row_id) == F.col("__row"), "left")
    new = {c: F.coalesce(F.col(f"__u{i}"), named(c)).alias(c) for i, c in enumerate(names)}
    return joined.select(*[new.get(c, named(c)) for c in df.columns])


def rewrite_partitions(spark: SparkSession, path: str, rows: DataFrame, row_id: str, partition: str, change) -> int:
    """Rewrite only those partitions of a stored table that hold ``rows`` (a column of row ids); returns their number.

    ``change`` maps the rows of these partitions to their new form. That is stored first, so the table is never read while it
    is overwritten, and then replaces the partitions dynamically: all others keep their files.
    """
    table = spark.read.parquet(path)
    wanted = rows.select(F.col(rows.columns[0]).cast("string").alias("__row")).distinct()
    touched = stored(table.join(wanted, named(row_id).cast("string") == F.col("__row"), "left_semi").select(
        named(partition).alias("__part")).distinct(), "touched")
    n_touched = touched.count()
    if not n_touched:
        return 0
    if n_touched <= PARTITIONS_TO_LIST:  # then the scan lists only their files
        values = [r["__part"] for r in touched.collect()]
        inside = named(partition).isin([v for v in values if v is not None])
        concerned = table.where(inside | named(partition).isNull() if None in values else inside)
    else:
        concerned = table.join(touched, named(partition).eqNullSafe(F.col("__part")), "left_semi")
    new = stored(change(concerned).select(*map(named, table.columns)), "rewritten")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return n_touched


def update_stored_cells(spark: SparkSession, path: str, updates: DataFrame, row_id: str, partition: str) -> int:
    """update_cells on a stored, partitioned table; only partitions with an updated row are written."""
    return rewrite_partitions(
        spark, path, updates.select("row_id"), row_id, partition, lambda rows: update_cells(rows, updates, row_id))


def write_report(report: DataFrame, issues: DataFrame, path: str) -> None:
    """The report document, and all issues beside it."""
    report.write.json(f"{path}/report")
    issues.write.json(f"{path}/issues")
