"""Joining rows to facts about their group when one group may hold a large part of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlint.functions.values import named

HOT_KEYS = 1000
SALTS = 256


def join_to_groups(
    rows: DataFrame, groups: DataFrame, key: list[str], weight: str, spread_by: list[str],
    hot_keys: int = HOT_KEYS, salts: int = SALTS,
) -> DataFrame:
    """Inner join of ``rows`` to ``groups`` (one row per key, ``weight`` = rows in the group).

    The ``hot_keys`` largest groups are spread over ``salts`` partitions: their rows get a salt from
    a hash of ``spread_by`` and their group row is copied once per salt. Every other group holds
    less than 1/``hot_keys`` of the rows. The broadcast side is ``hot_keys`` keys by construction,
    whatever the size of the table. Keys must not be NULL; long texts go by their digest (``value_digest``), so that the
    broadcast keys are small ones.
    """
    hot = groups.orderBy(F.desc(weight), *key).limit(hot_keys).select(*key, F.lit(True).alias("__hot"))
    salted_rows = rows.join(F.broadcast(hot), key, "left").withColumn(
        "__salt",
        F.when(F.col("__hot"), F.pmod(F.xxhash64(*map(named, spread_by)), F.lit(salts)).cast("int")).otherwise(0),
    ).drop("__hot")
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_groups = (
        groups.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    )
    return salted_rows.join(salted_groups, [*key, "__salt"]).drop("__salt")
