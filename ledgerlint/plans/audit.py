"""Whole audits: all checks of a table or a sheet, written as findings, issues and a report."""

from __future__ import annotations

import datetime as dt
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlint.functions.values import named, numeric_columns, text_columns
from ledgerlint.operators import (
    actions as act,
    anomalies,
    documents,
    duplicates,
    findings as fnd,
    fuzzy,
    issues as iss,
    logic,
    profile,
    quality,
    schema,
    sheet_checks,
    stale,
)
from ledgerlint.operators.findings import RowKey
from ledgerlint.session import stored
from ledgerlint.settings import AGENTS, ColumnRoles, SheetColumns, Thresholds
from ledgerlint.sources import files

RUN_STATS_SCHEMA = "name string, status string, duration_ms bigint, issue_count bigint, error string"


@dataclass(frozen=True)
class CheckContext:
    """What a check gets to know besides the table."""

    roles: ColumnRoles
    key: RowKey
    as_of: dt.date
    limits: Thresholds = Thresholds()
    near_duplicate_metric: object = fuzzy.Indel()
    #: Columns to compare for near-duplicates; None takes every name and text column.
    near_duplicate_columns: tuple | None = None
    #: Columns whose values have at least this many characters on average hold documents, which are compared by this.
    document_length: int = 200
    document_metric: documents.Shingles = documents.Shingles()
    #: Jobs that run at once.
    jobs_at_once: int = 8

    def compared(self, df: DataFrame) -> list[str]:
        wanted = self.roles.of_type("name", "text") if self.near_duplicate_columns is None else self.near_duplicate_columns
        return [c for c in wanted if c in df.columns]

    def not_compared(self, df: DataFrame) -> list[str]:
        return [c for c in self.roles.of_type("name", "text") if c in df.columns and c not in self.compared(df)]


@dataclass(frozen=True)
class Checks:
    """What a check family wants done: rules for the shared pass over the rows, and findings that
    need jobs of their own: tables, or functions that make one when their turn comes."""

    rules: tuple = ()
    findings: tuple = ()


@dataclass(frozen=True)
class AuditResult:
    findings: DataFrame
    summary: DataFrame
    issues: DataFrame
    run_stats: DataFrame
    health: DataFrame


def measured_columns(df: DataFrame, ctx: CheckContext) -> list[str]:
    return [c for c in numeric_columns(df) if c != ctx.key.order]


def take_profile(df: DataFrame, ctx: CheckContext) -> DataFrame:
    """One row with every count that the checks start from; each column is read once.

    Text columns share one aggregate (type classes, readable due dates), all others share a second
    one (null counts, moments, extremes). Together in one they exceed what the JVM compiles well,
    and a columnar scan reads no column twice this way.
    """
    texts, numbers = text_columns(df), measured_columns(df, ctx)
    others = [c for c in df.columns if c not in texts]
    due, formats = stale.stale_columns(df, ctx.roles).due, ctx.roles.date_formats
    place = {c: i for i, c in enumerate(df.columns)}

    def due_in(columns):
        return stale.due_aggregates(df, due, formats) if due in columns else []

    of_text = quality.with_classes(df.select(*map(named, texts)), quality.text_classes(texts, formats)).agg(
        F.count("*").alias("n"), *quality.mix_aggregates(texts), *due_in(texts),
        *[F.avg(F.char_length(named(c))).alias(f"len_{place[c]}") for c in texts],
    )
    of_others = df.agg(
        F.count("*").alias("n"), *[F.count(named(c)).alias(f"c_{place[c]}") for c in others],
        *profile.numeric_aggregates(numbers), *due_in(others),
    )
    text_row = of_text.select(
        "*", *[
            sum(F.col(f"{kind}_{i}") for kind in quality.TYPE_CLASSES).alias(f"c_{place[c]}")
            for i, c in enumerate(texts)
        ],
    )
    sides = [side for side, columns in ((text_row, texts), (of_others.drop("n") if texts else of_others, others)) if columns]
    rows = [(r, side.schema) for side in sides for r in side.collect()]
    return df.sparkSession.createDataFrame(
        [tuple(v for r, _ in rows for v in r)], T.StructType([f for _, schema in rows for f in schema.fields])
    )


# A check family takes the table, the context and the profile row and returns Checks. To add a check,
# add a function with this signature to a copy of FAMILIES and pass it to audit_table.


def duplicate_family(df: DataFrame, ctx: CheckContext, counted: DataFrame) -> Checks:
    found = [duplicates.exact_duplicates(df, ctx.key)]
    if any(c in df.columns for c in ctx.roles.key):
        found.append(duplicates.duplicate_keys(df, ctx.roles.key, ctx.key))
    lengths = counted.first().asDict()
    place = {c: i for i, c in enumerate(df.columns)}
    long = [c for c in ctx.compared(df) if (lengths.get(f"len_{place[c]}") or 0) >= ctx.document_length]
    short = [c for c in ctx.compared(df) if c not in long]
    if short:
        # The distinct values of all compared columns come from one scan.
        counts = stored(profile.value_counts(df, short).where(F.col("value").isNotNull()), "compared")
    for column in short:
        found.append(partial(fuzzy.near_duplicates, df, column, ctx.key, ctx.near_duplicate_metric, counts=counts))
    for column in long:
        found.append(partial(fuzzy.near_duplicates, df, column, ctx.key, ctx.document_metric))
    return Checks((), tuple(found))


def quality_family(df: DataFrame, ctx: CheckContext, counted: DataFrame) -> Checks:
    dense = quality.null_density(df, None, ctx.limits, counted).collect()  # at most one row per column
    found = []
    if text_columns(df):
        found.append(quality.mixed_type_findings(df, text_columns(df), ctx.roles.date_formats, counted))
    casing = quality.casing_findings(df, [c for c in ctx.roles.of_type("status") if c in df.columns], ctx.key)
    if casing is not None:
        found.append(casing)
    return Checks((*quality.null_rules(dense), *quality.percentage_rules(df, ctx.roles)), tuple(found))


def logic_family(df: DataFrame, ctx: CheckContext, counted: DataFrame) -> Checks:
    roles = ctx.roles
    return Checks((
        *logic.date_order_rules(df, roles.date_pairs, roles.date_formats),
        *logic.negative_amount_rules(df),
        *logic.over_budget_rules(df, roles.actual, roles.budget),
        *logic.status_percentage_rules(df, roles),
        *logic.date_format_rules(df, roles.of_type("date"), roles.date_formats),
    ))


def stale_family(df: DataFrame, ctx: CheckContext, counted: DataFrame) -> Checks:
    columns, formats = stale.stale_columns(df, ctx.roles), ctx.roles.date_formats
    rules = stale.stale_rules(df, columns, ctx.as_of, formats, ctx.limits)
    if columns.due:
        rules = stale.missing_deadline_rules(df, columns.due, formats, ctx.limits, counted) + rules
    return Checks(tuple(rules))


def anomaly_family(df: DataFrame, ctx: CheckContext, counted: DataFrame) -> Checks:
    numbers = measured_columns(df, ctx)
    if not numbers:
        return Checks()
    facts = anomalies.column_limits(df, numbers, ctx.limits, counted)
    rules = anomalies.outlier_rules(facts, anomalies.outlier_severities(facts, ctx.limits), ctx.limits)
    return Checks(
        (*rules, *anomalies.impossible_negative_rules(facts)),
        (anomalies.skew_findings(df, numbers, ctx.limits, counted),),
    )


FAMILIES = {
    "duplicate_hunter": duplicate_family,
    "data_quality": quality_family,
    "business_logic": logic_family,
    "stale_records": stale_family,
    "anomaly_detector": anomaly_family,
}


class _Run:
    """Outcome of every family so far; one failure does not stop the others."""

    def __init__(self):
        self.spent, self.errors = {}, {}
        self.lock = threading.Lock()

    def attempt(self, names, work):
        """Do some work for the families; its time counts for each of them."""
        started = time.monotonic()
        try:
            return work()
        except Exception as failure:
            with self.lock:
                for name in names:
                    self.errors.setdefault(name, str(failure).splitlines()[0][:500])
            return None
        finally:
            with self.lock:
                for name in names:
                    self.spent[name] = self.spent.get(name, 0.0) + time.monotonic() - started


def _at_once(spark: SparkSession, jobs: list, threads: int) -> None:
    """Run (pool, function) jobs from several driver threads; each family has a scheduler pool of its own, which divides
    the executors fairly where the cluster's scheduler mode is FAIR."""

    def run(pool, work):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        work()

    with ThreadPoolExecutor(threads) as executor:
        started = [executor.submit(inheritable_thread_target(spark)(run), pool, work) for pool, work in jobs]
        for job in started:
            job.result()


def audit_table(
    df: DataFrame, ctx: CheckContext, folder: str, agents=AGENTS, enrichment: DataFrame | None = None,
    families=None,
) -> AuditResult:
    """Run the check families and write their findings below ``folder``.

    The table is written there once, and every job reads that copy: a text source is parsed once, computed
    columns are computed once, and all checks see the same rows. One scan takes the profile, one pass applies the row rules of all families together; only group
    checks add jobs. Scores and reports read the written findings, so no check runs twice and a lost
    executor costs at most the running job. A family that fails is recorded and does not stop the
    others; the score is then NULL. The row pass and all group checks run at once, from driver threads.
    """
    spark, run = df.sparkSession, _Run()
    df.write.mode("overwrite").parquet(f"{folder}/input")
    df = spark.read.schema(df.schema).parquet(f"{folder}/input")
    families = families or FAMILIES
    wanted = [a for a in AGENTS if a in agents]
    counted = run.attempt(wanted, lambda: take_profile(df, ctx))
    checks = {}
    for name in wanted if counted is not None else ():
        built = run.attempt([name], lambda: families[name](df, ctx, counted))
        if built is not None:
            checks[name] = built

    written = []

    def write(found, label: str) -> None:
        path = f"{folder}/findings/{label}"
        found = found() if callable(found) else found
        found.select(*fnd.FINDING_COLUMNS).write.mode("overwrite").parquet(path)
        written.append(path)

    by_row = {n: c.rules for n, c in checks.items() if c.rules}

    def row_pass() -> None:
        all_rules = [r for rules in by_row.values() for r in rules]
        together = _Run()
        together.attempt(by_row, lambda: write(fnd.row_findings(df, all_rules, ctx.key), "rows"))
        if together.errors:  # find out which family it was; the others still get their findings
            for name, rules in by_row.items():
                run.attempt(
                    [name], lambda: write(fnd.row_findings(df, list(rules), ctx.key), f"rows-{name}")
                )
        with run.lock:
            for name, seconds in together.spent.items():
                run.spent[name] += seconds
    jobs = [
        (name, partial(run.attempt, [name], partial(write, found, f"{name}-{i}")))
        for name, built in checks.items() for i, found in enumerate(built.findings)
    ]
    _at_once(spark, ([("rows", row_pass)] if by_row else []) + jobs, ctx.jobs_at_once)

    found = spark.read.schema(fnd.FINDING_SCHEMA).parquet(*written) if written else fnd.empty_findings(df)
    fnd.summarise(found).write.mode("overwrite").parquet(f"{folder}/summary")
    summary = spark.read.parquet(f"{folder}/summary")
    n_rows = counted.first()["n"] if counted is not None else df.count()
    issues = iss.dedupe(iss.to_issues(iss.severity_policy(summary, F.lit(n_rows)), enrichment))
    issues.write.mode("overwrite").parquet(f"{folder}/issues")
    issues = spark.read.parquet(f"{folder}/issues")
    per_agent = {r["agent"]: r["n"] for r in summary.groupBy("agent").agg(F.count("*").alias("n")).collect()}
    stats = []
    for name in AGENTS:
        if name not in wanted:
            stats.append((name, "skipped", 0, 0, None))
            continue
        elapsed = max(1, int(run.spent.get(name, 0.0) * 1000))
        status = "failed" if name in run.errors else "done"
        count = 0 if name in run.errors else per_agent.get(name, 0)
        left = ctx.not_compared(df) if name == "duplicate_hunter" else []
        note = f"near-duplicates not compared in: {', '.join(left)}" if left else None
        stats.append((name, status, elapsed, count, run.errors.get(name, note)))
    run_stats = spark.createDataFrame(stats, RUN_STATS_SCHEMA)
    return AuditResult(found, summary, issues, run_stats, iss.file_health_score(issues, run_stats))


def audit_file(
    spark: SparkSession, path: str, folder: str, key: RowKey, as_of: dt.date, domain: str = "general",
    roles: ColumnRoles | None = None, agents=AGENTS,
) -> AuditResult:
    """A CSV file from the scan to the report: typed and normalised, audited, and reported below ``folder``.

    Roles are inferred unless given. ``folder``/report holds the document, ``folder``/all_issues what it is drawn from.
    """
    table = files.read_records(spark, path)
    context = CheckContext(roles or schema.infer_roles(table), key, as_of)
    result = audit_table(table, context, folder, agents)
    metadata = files.dataset_metadata(spark.read.parquet(f"{folder}/input"), path.rsplit("/", 1)[-1], "csv")
    document = iss.report(result.issues, result.run_stats, metadata, domain, f"{as_of}T00:00:00")
    document.write.json(f"{folder}/report")
    result.issues.write.json(f"{folder}/all_issues")
    return result


def run_stats_totals(run_stats: DataFrame) -> DataFrame:
    """One row: families that ran (done, with a duration), failed and were skipped."""
    return run_stats.agg(
        F.count_if((F.col("status") == "done") & (F.col("duration_ms") > 0)).alias("n_ran"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.count_if(F.col("status") == "skipped").alias("n_skipped"),
        F.coalesce(F.sum("issue_count"), F.lit(0)).alias("n_issues"),
    )


@dataclass(frozen=True)
class SheetAudit:
    issues: DataFrame
    actions: DataFrame
    health: DataFrame
    group_rows: DataFrame | None = None


def audit_sheet(
    sheet: DataFrame, as_of: dt.date, folder: str, names: SheetColumns = SheetColumns()
) -> SheetAudit:
    """Issues and proposed corrections of a sheet, written once and read back for the score.

    ``group_rows`` links every row of a group of duplicates to its issue by ``issue_id``.
    """
    spark = sheet.sparkSession
    grouped = {names.task_id, names.task_name, names.owner} <= set(sheet.columns)
    if grouped:
        sheet_checks.group_rows(sheet, names).write.parquet(f"{folder}/group_rows")
    sheet_checks.sheet_issues(sheet, as_of, names).write.parquet(f"{folder}/issues")
    sheet_checks.sheet_actions(sheet, as_of, names).write.parquet(f"{folder}/actions")
    issues = spark.read.parquet(f"{folder}/issues")
    return SheetAudit(
        issues, spark.read.parquet(f"{folder}/actions"), iss.sheet_health_score(issues),
        spark.read.parquet(f"{folder}/group_rows") if grouped else None,
    )


@dataclass(frozen=True)
class Correction:
    table: DataFrame
    changes: DataFrame
    skipped: DataFrame
    log: DataFrame


def correct(
    sheet: DataFrame, actions: DataFrame, approvals: DataFrame, names: SheetColumns = SheetColumns()
) -> Correction:
    """The sheet with its approved corrections applied, what changed, and what could not be applied."""
    approved = act.approved_actions(actions, approvals)
    columns = [c for c in sheet.columns if c not in (names.row_id, names.row_number)]
    return Correction(
        act.apply_patches(sheet, act.approved_actions(actions, approvals, ids=False), names.row_id, columns),
        act.change_log(sheet, approved, names.row_id, columns),
        act.skipped_actions(sheet, approved, names.row_id, columns),
        act.execution_log(sheet, actions, approvals, names.row_id, columns),
    )
