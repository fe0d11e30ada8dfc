"""Duplicate keys on a stream with late and repeated keys against the batch check."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerlint.operators import duplicates
from ledgerlint.operators.findings import RowKey
from ledgerlint.streaming.duplicates import stream_duplicate_keys

KEY = RowKey(("id",), "id")
START = dt.datetime(2024, 1, 1)


def rows(n=400):
    draw = random.Random(6)
    return [
        (i, draw.choice([None, *(f"k{j}" for j in range(260))]), START + dt.timedelta(minutes=i * 5 - draw.choice([0, 0, 200, 600])))
        for i in range(n)
    ]


def run(spark, tmp_path, parts, keep):
    path = str(tmp_path / "in")
    schema = "id bigint, `the.key` string, seen timestamp"
    for number, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/p={number:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    found = stream_duplicate_keys(stream, ["the.key"], KEY, "seen", keep)
    name = f"found_{abs(hash(str(tmp_path)))}"
    query = found.writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(int(r["row_key"]) for r in spark.table(name).collect())


def test_late_and_repeated_keys_equal_the_batch_check(spark, tmp_path):
    data = rows()
    batch = duplicates.duplicate_keys(
        spark.createDataFrame(data, "id bigint, `the.key` string, seen timestamp"), ["the.key"], KEY)
    want = sorted(int(r["row_key"]) for r in batch.collect())
    assert run(spark, tmp_path, [data[:150], data[150:160], data[160:]], "7 days") == want and len(want) > 200


def test_keys_are_forgotten_behind_the_watermark(spark, tmp_path):
    def at(hours):
        return START + dt.timedelta(hours=hours)

    parts = [
        [(0, "a", at(0)), (1, "b", at(0))],
        [(2, "a", at(1))],
        [(3, "x", at(100))], [(4, "y", at(200))], [(5, "z", at(300))],
        [(6, "b", at(301))],
    ]
    # a repeats within the time kept; b comes again long after it was forgotten
    assert run(spark, tmp_path, parts, "2 hours") == [0, 2]
