"""Proposed corrections: approval, execution and the patched table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlint.functions.values import named, value_digest
from ledgerlint.operators.skew import join_to_groups
from ledgerlint.session import stored
from ledgerlint.settings import PATCH_TYPES

DEFAULT_COLUMN = "Status"
#: Actions that one task compares with their approvals, about.
ROWS_A_TASK = 500_000


def approve(actions: DataFrame, policy: str = "safe", toggled: DataFrame | None = None) -> DataFrame:
    """(action_id, approved) by policy: safe, all or none; ``toggled`` action ids are reversed."""
    rule = {"safe": F.col("risk_level") == "SAFE", "all": F.lit(True), "none": F.lit(False)}[policy]
    approvals = actions.select("action_id", rule.alias("approved"))
    if toggled is None:
        return approvals
    # A toggle that is listed an even number of times cancels out.
    odd = toggled.groupBy("action_id").agg((F.count("*") % 2 == 1).alias("odd"))
    return approvals.join(odd, "action_id", "left").select(
        "action_id", (F.col("approved") != F.coalesce("odd", F.lit(False))).alias("approved")
    )


def approved_actions(actions: DataFrame, approvals: DataFrame, ids: bool = True) -> DataFrame:
    """The actions with an approval; without ``ids`` these are left out, and their digests meet."""
    if ids:
        return actions.join(approvals.where("approved"), "action_id", "left_semi")
    approved = approvals.where(F.col("approved") & F.col("action_id").isNotNull())
    dealt, approved = (df.withColumn("__id", value_digest(F.col("action_id").cast("string"))).drop("action_id") for df in (actions, approved))
    return dealt.join(approved, "__id", "left_semi").drop("__id")


def unapproved_actions(actions: DataFrame, approvals: DataFrame) -> DataFrame:
    """Actions without an approval. Tasks are dealt by rows: ids compress so well that by bytes a task would sort millions."""
    least = int(actions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, math.ceil(actions.count() / ROWS_A_TASK))
    dealt, approved = (df.repartition(tasks, "action_id") for df in (actions, approvals.where("approved").select("action_id")))
    return dealt.join(approved.hint("merge"), "action_id", "left_anti")


def execution_log(df: DataFrame, actions: DataFrame, approvals: DataFrame, row_id: str, columns=None) -> DataFrame:
    """Every approved action with what the correction did with it: applied to the table, or skipped and why."""
    names = list(columns or [c for c in df.columns if c != row_id])
    checked = check_targets(df, approved_actions(actions, approvals), row_id, names)
    return checked.withColumn("status", F.when(F.col("reason_skipped").isNull(), "applied").otherwise("skipped"))


def execution_summary(log: DataFrame) -> DataFrame:
    """One row: total, successes, failures."""
    return log.agg(
        F.count("*").alias("total_executed"),
        F.count_if(F.col("status") == "applied").alias("success_count"),
        F.count_if(F.col("status") == "skipped").alias("failed_count"),
    )


def _target_column(title: Column, columns) -> Column:
    """The table's own spelling of the column title; NULL where it has none."""
    wanted = F.lower(F.when(F.coalesce(title, F.lit("")) == "", DEFAULT_COLUMN).otherwise(title))
    own = F.when(F.lit(False), F.lit(None).cast("string"))
    for c in columns:
        own = own.when(wanted == c.lower(), F.lit(c))
    return own


def _reason(known_row: Column, column: Column) -> Column:
    return (
        F.when(~F.coalesce(F.col("action_type").isin(*PATCH_TYPES), F.lit(False)), "unsupported action type")
        .when(F.col("target_row_id").isNull(), "missing row id")
        .when(known_row.isNull(), "unknown row")
        .when(column.isNull(), "unknown column")
    )


def check_targets(df: DataFrame, actions: DataFrame, row_id: str, columns) -> DataFrame:
    """The actions with the table's column name in ``column`` and a ``reason`` where they cannot apply."""
    rows = df.select(F.col(row_id).cast("string").alias("__row")).distinct()
    # Actions without a row meet no row: keys of their own keep them out of one hot partition.
    nowhere = F.concat(F.lit("no row "), F.pmod(F.xxhash64("action_id"), F.lit(4096)).cast("string"))
    hot = actions.withColumn("__row", F.coalesce(F.col("target_row_id").cast("string"), nowhere))
    return (
        hot.join(rows.withColumn("__known", F.lit(True)), "__row", "left")
        .withColumn("column", _target_column(F.col("column_title"), columns))
        .withColumn("reason_skipped", _reason(F.col("__known"), F.col("column")))
        .drop("__row", "__known")
    )


def skipped_actions(df: DataFrame, actions: DataFrame, row_id: str, columns=None) -> DataFrame:
    """Actions that cannot be applied to the table, and why."""
    names = list(columns or [c for c in df.columns if c != row_id])
    return check_targets(df, actions, row_id, names).where(F.col("reason_skipped").isNotNull())


def fold_patches(actions: DataFrame, columns, ids: bool = True) -> DataFrame:
    """(row, column, overwritten, value, comments, action_ids): the net patch of every cell; the ids only where wanted, as
    they are most of an action's bytes.

    An overwrite makes everything before it irrelevant, so the last one is found by an aggregate, and so is a cell's
    only comment. For cells with several comments the actions are read again, to gather those after the overwrite, newest
    first. Without ids the aggregate is stored, so this is left out if there are no such cells.
    """
    parts = ("seq", "value", *(["action_id"] if ids else []))
    cells = actions.select(
        F.col("target_row_id").cast("string").alias("row"),
        _target_column(F.col("column_title"), columns).alias("column"),
        "seq",
        *(["action_id"] if ids else []),
        F.col("action_type").isin(*PATCH_TYPES).alias("patches"),
        (F.col("action_type") == "add_comment").alias("is_comment"),
        F.coalesce("proposed_value", F.lit("")).alias("value"),
    ).where(F.col("row").isNotNull() & F.col("column").isNotNull() & F.col("patches"))
    patch, before = F.struct(*parts), F.coalesce("overwrite.seq", F.lit(-(2**63) + 1))
    last = cells.groupBy("row", "column").agg(
        F.count("*").alias("n_patches"),
        F.count_if("is_comment").alias("n_comments"),
        F.max(F.when(~F.col("is_comment"), patch)).alias("overwrite"),
        F.max(F.when(F.col("is_comment"), patch)).alias("newest"),
    )
    last = last if ids else stored(last, "patches")
    only = F.array(F.when(F.col("n_comments") == 1, F.col("newest")))
    folded = last.withColumn("c", F.filter(only, lambda c: c["seq"] > before))
    crowded = last.where("n_comments > 1")
    if ids or not crowded.isEmpty():
        later = (
            join_to_groups(cells.where("is_comment"), crowded, ["row", "column"], "n_patches", list(parts))
            .where(F.col("seq") > before)
            .groupBy("row", "column")
            .agg(F.sort_array(F.collect_list(patch), asc=False).alias("later"))
        )
        folded = folded.join(later, ["row", "column"], "left").withColumn("c", F.coalesce("later", "c"))
    overwrite = F.col("overwrite")
    return folded.select(
        "row", "column", overwrite.isNotNull().alias("overwritten"), overwrite["value"].alias("value"),
        F.col("c.value").alias("comments"),
        *([F.concat(F.col("c.action_id"), F.array_compact(F.array(overwrite["action_id"]))).alias("action_ids")] if ids else []))


def _patched(patch: Column, old: Column) -> Column:
    """``newest comment | ... | oldest comment | base``, the base being the overwrite or the old value."""
    base = F.when(patch["overwritten"], patch["value"]).otherwise(F.coalesce(old.cast("string"), F.lit("")))
    return F.array_join(F.concat(patch["comments"], F.array(base)), " | ")


def apply_patches(df: DataFrame, actions: DataFrame, row_id: str, columns=None) -> DataFrame:
    """The table with all its cells patched; columns become text.

    The patches are pivoted to one row per table row and joined once. Every table row is kept.
    """
    names = list(columns or [c for c in df.columns if c != row_id])
    folded = fold_patches(actions, names, ids=False).withColumn("patch", F.struct("overwritten", "value", "comments"))
    wide = folded.groupBy("row").agg(
        *[F.first(F.when(F.col("column") == c, F.col("patch")), ignorenulls=True).alias(f"__p{i}") for i, c in enumerate(names)]
    )
    joined = df.join(wide, F.col(row_id).cast("string") == F.col("row"), "left")
    patch_of = {c: F.col(f"__p{i}") for i, c in enumerate(names)}
    return joined.select(*[
        F.when(patch_of[c].isNotNull(), _patched(patch_of[c], named(c))).otherwise(named(c).cast("string")).alias(c)
        if c in patch_of
        else named(c)
        for c in df.columns
    ])


def change_log(df: DataFrame, actions: DataFrame, row_id: str, columns=None) -> DataFrame:
    """(row, column, old_value, new_value, action_ids) for every patched cell."""
    names = list(columns or [c for c in df.columns if c != row_id])
    folded = fold_patches(actions, names)
    old = F.when(F.lit(False), F.lit(None).cast("string"))
    for c in names:
        old = old.when(F.col("column") == c, F.col(f"t.{c}").cast("string"))
    patch = F.struct("overwritten", "value", "comments")
    return (
        folded.join(df.alias("t"), F.col(f"t.{row_id}").cast("string") == F.col("row"))
        .select("row", "column", F.coalesce(old, F.lit("")).alias("old_value"), patch.alias("patch"), "action_ids")
        .select(
            "row", "column", "old_value", _patched(F.col("patch"), F.col("old_value")).alias("new_value"), "action_ids"
        )
    )
