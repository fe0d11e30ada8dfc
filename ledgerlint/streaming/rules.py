"""Row checks on streams. They hold no state, so the batch rules run unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlint.operators.findings import RowKey, RowRule, row_findings


def stream_findings(stream: DataFrame, rules: list[RowRule], key: RowKey) -> DataFrame:
    """Findings of the row rules, as an append-only stream."""
    return row_findings(stream, rules, key)


def violation_rate(
    table: DataFrame, event_time: str, condition: Column, window: str = "1 day", late: str = "1 day"
) -> DataFrame:
    """(window_start, n_rows, n_violations) per time window, for streams and for tables alike."""
    timed = table.withColumn("__at", F.col(event_time).cast("timestamp"))
    if table.isStreaming:
        timed = timed.withWatermark("__at", late)
    return (
        timed.groupBy(F.window("__at", window))
        .agg(F.count("*").alias("n_rows"), F.count_if(condition).alias("n_violations"))
        .select(F.col("window.start").alias("window_start"), "n_rows", "n_violations")
    )
