"""Small helpers that several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlint.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: one evaluation, no lineage to recompute."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def globally_ordered(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """``df`` with ``__part`` and ``__at``: parts follow each other in ``order``, rows count from 1 in a part.

    Rows are range-partitioned, so no task sees more than its share; the result is stored, since a
    second evaluation could draw other range borders. Meant for narrow rows (ids, not texts).
    """
    spread = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    parts = spread.withColumn("__part", F.spark_partition_id())
    own = Window.partitionBy("__part").orderBy(*order)
    return stored(parts.withColumn("__at", F.row_number().over(own)), "ordered")
