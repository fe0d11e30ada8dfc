"""Duplicate keys on streams: keyed state with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerlint.functions.values import column_list, named, row_digest
from ledgerlint.operators.findings import FINDING_COLUMNS, RowKey

OUTPUT = "digest binary, row_key string, row_order bigint"
STATE = "row_key string, row_order bigint, latest double, reported boolean"


def stream_duplicate_keys(stream: DataFrame, key_columns, key: RowKey, event_time: str, keep: str = "1 day") -> DataFrame:
    """D2 findings as an append-only stream: every row whose key another row of the last ``keep`` has too.

    The state of a key is its first row until a second one comes, then only that there was one; the first row is reported
    together with the second. Rows may come late by up to ``keep``; rows later than that are dropped by the watermark,
    and a key that is quiet for longer is forgotten. If equal keys lie closer together than ``keep``, the findings are those of
    the batch check. Missing key parts count as equal, as there.
    """
    names = list(key_columns)
    rows = (
        stream.withColumn("__at", named(event_time).cast("timestamp")).withWatermark("__at", keep)
        .select("__at", row_digest(stream, names).alias("digest"), key.text().alias("row_key"), key.position().alias("row_order"))
    )
    kept_ms = int(pd.Timedelta(keep).total_seconds() * 1000)

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first_key, first_order, latest, reported = state.get if state.exists else (None, None, 0.0, None)
        for frame in frames:
            found = frame.sort_values(["row_order", "row_key"])
            if not len(found):
                continue
            latest = max(latest, found["__at"].max().timestamp() * 1000)
            out = found[["row_key", "row_order"]]
            if reported is None:
                first_key, first_order, reported = out.iloc[0]["row_key"], out.iloc[0]["row_order"], False
                out = out.iloc[1:]
            if len(out):
                if not reported:
                    first = pd.DataFrame({"row_key": [first_key], "row_order": [first_order]})
                    out, reported = pd.concat([first, out]), True
                yield out.assign(digest=group[0])[["digest", "row_key", "row_order"]]
        state.update((first_key, None if pd.isna(first_order) else int(first_order), latest, reported))
        watermark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(int(max(latest, watermark) + kept_ms))

    found = rows.groupBy("digest").applyInPandasWithState(
        update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(
        F.lit("D2").alias("check_id"), F.lit("duplicate_hunter").alias("agent"),
        F.lit("duplicate_primary_keys").alias("finding_type"), column_list(*names).alias("columns"),
        F.lit(None).cast("string").alias("group_key"), "row_key", "row_order", F.lit("MEDIUM").alias("severity"),
        F.lit(None).cast("string").alias("detail"), F.lit(1).cast("bigint").alias("weight")).select(*FINDING_COLUMNS)
