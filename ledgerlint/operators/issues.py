"""From findings to issues, scores and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlint.functions.values import severity_rank, side_by_side
from ledgerlint.operators.duplicates import duplicate_severity
from ledgerlint.settings import (
    AGENTS,
    DEFAULT_CONFIDENCE,
    DEFAULT_FIX,
    DOMAIN_NAMES,
    FILE_PENALTY,
    SHEET_FLOOR,
    SHEET_PENALTY,
)

ISSUE_COLUMNS = [
    "issue_id", "check_id", "agent", "title", "description", "severity", "affected_rows",
    "affected_columns", "suggested_fix", "count", "confidence", "seq",
]


def by_agent(values: dict, agent: Column, otherwise) -> Column:
    chosen = F.when(F.lit(False), F.lit(otherwise))
    for name, value in values.items():
        chosen = chosen.when(agent == name, F.lit(value))
    return chosen.otherwise(F.lit(otherwise))


def severity_policy(summary: DataFrame, n_rows: Column) -> DataFrame:
    """Severity without a reviewer: duplicates by their share of the rows, the rest as the check says."""
    return summary.withColumn(
        "severity",
        F.when(F.col("check_id").isin("D1", "D2", "D3"), duplicate_severity(F.col("count"), n_rows))
        .otherwise(F.coalesce("severity", F.lit("MEDIUM"))),
    )


def to_issues(summary: DataFrame, enrichment: DataFrame | None = None) -> DataFrame:
    """One issue per finding, with default texts; ``enrichment`` overrides them.

    ``enrichment`` is keyed by (check_id, columns): title, description, severity, suggested_fix
    (an array of sentences) and confidence, each of which may be NULL.
    """
    defaults = summary.select(
        F.sha2(F.concat_ws("|", "check_id", F.concat_ws(",", "columns"), "group_key"), 256).alias("issue_id"),
        "check_id",
        "agent",
        "columns",
        F.concat(F.lit("System: "), F.col("finding_type")).alias("title"),
        F.format_string(
            "%s in %s: %s rows.",
            F.col("finding_type"),
            F.when(F.size("columns") > 0, F.concat_ws(", ", "columns")).otherwise("whole rows"),
            F.col("count").cast("string"),
        ).alias("description"),
        F.coalesce("severity", F.lit("MEDIUM")).alias("severity"),
        "affected_rows",
        by_agent(DEFAULT_FIX, F.col("agent"), "Review.").alias("suggested_fix"),
        "count",
        by_agent(DEFAULT_CONFIDENCE, F.col("agent"), 0.8).alias("confidence"),
        F.concat_ws(
            "|", by_agent({a: str(i) for i, a in enumerate(AGENTS)}, F.col("agent"), "9"),
            "check_id", F.concat_ws(",", "columns"), "group_key",
        ).alias("seq"),
    )
    if enrichment is not None:
        over = enrichment.select(
            F.col("check_id").alias("o_check"),
            F.col("columns").alias("o_columns"),
            F.col("title").alias("o_title"),
            F.col("description").alias("o_description"),
            F.col("severity").alias("o_severity"),
            F.when(F.size("suggested_fix") > 0, F.array_join("suggested_fix", ". ")).alias("o_suggested_fix"),
            F.col("confidence").alias("o_confidence"),
        )
        defaults = defaults.join(
            over, (F.col("check_id") == F.col("o_check")) & (F.col("columns") == F.col("o_columns")), "left"
        )
        for c in ("title", "description", "severity", "suggested_fix", "confidence"):
            defaults = defaults.withColumn(c, F.coalesce(F.col(f"o_{c}"), F.col(c)))
    return defaults.withColumnRenamed("columns", "affected_columns").select(*ISSUE_COLUMNS)


def dedupe(issues: DataFrame, by_columns: bool = True) -> DataFrame:
    """First issue per agent and title, and per columns and group unless ``by_columns`` is off.

    ``issue_id`` stands for check, columns and group, so the findings of one check that only their group tells
    apart (one per word, say) all stay.
    An aggregate, not a window: one kept issue per key and task crosses the network.
    """
    key = ["agent", "title"] + (["affected_columns", "issue_id"] if by_columns else [])
    kept = [c for c in issues.columns if c not in key]
    return (
        issues.groupBy(*key)
        .agg(F.min_by(F.struct(*kept), F.struct("seq", "issue_id")).alias("first"))
        .select(*key, "first.*")
        .select(*issues.columns)
    )


def ranked(issues: DataFrame) -> DataFrame:
    """Most severe first, then most certain."""
    return issues.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy(
        "severity_rank", F.desc("confidence"), "issue_id"
    )


def severity_counts(issues: DataFrame) -> DataFrame:
    """One row: issues by severity."""
    return issues.agg(
        F.count_if(F.col("severity") == "HIGH").alias("high"),
        F.count_if(F.col("severity") == "MEDIUM").alias("medium"),
        F.count_if(F.col("severity") == "LOW").alias("low"),
        F.count("*").alias("total"),
    )


def severity_cube(issues: DataFrame) -> DataFrame:
    """Issue counts by agent and severity with subtotals ('ALL')."""
    return (
        issues.cube("agent", "severity")
        .agg(F.count("*").alias("n_issues"), F.grouping_id().alias("level"))
        .select(
            F.when(F.col("level").bitwiseAND(2) > 0, "ALL").otherwise(F.col("agent")).alias("agent"),
            F.when(F.col("level").bitwiseAND(1) > 0, "ALL").otherwise(F.col("severity")).alias("severity"),
            "n_issues",
        )
    )


def file_health_score(issues: DataFrame, run_stats: DataFrame | None = None) -> DataFrame:
    """One row: 100 less points per issue, each severity limited, never below 0.

    With ``run_stats`` the score is NULL where a check family failed: what nobody checked has no score.
    """
    score = F.lit(100)
    for severity, column in (("HIGH", "high"), ("MEDIUM", "medium"), ("LOW", "low")):
        points, most = FILE_PENALTY[severity]
        score = score - F.least(F.col(column) * points, F.lit(most))
    return _scored(severity_counts(issues), F.greatest(score, F.lit(0)).cast("int"), run_stats)


def _scored(counts: DataFrame, score: Column, run_stats: DataFrame | None) -> DataFrame:
    if run_stats is None:
        return counts.withColumn("health_score", score)
    failed = run_stats.agg(F.count_if(F.col("status") == "failed").alias("n_failed"))
    return side_by_side(counts, failed).withColumn("health_score", F.when(F.col("n_failed") == 0, score))


def sheet_health_score(issues: DataFrame, run_stats: DataFrame | None = None) -> DataFrame:
    """One row: 100 less weighted issue counts, cut to a whole number, at least 15 with any issue.

    Computed in decimals, so that no point is lost to binary rounding.
    """
    penalty = sum(
        F.col(column).cast("decimal(18,0)") * F.lit(SHEET_PENALTY[severity]).cast("decimal(4,2)")
        for severity, column in (("HIGH", "high"), ("MEDIUM", "medium"), ("LOW", "low"))
    )
    floor = F.when(F.col("total") > 0, F.lit(SHEET_FLOOR)).otherwise(F.lit(100))
    return _scored(
        severity_counts(issues), F.greatest(floor.cast("decimal(30,2)"), F.lit(100) - penalty).cast("int"), run_stats)


def brief(issues: DataFrame, n: int = 20, width: int = 150) -> DataFrame:
    """The first issues in rank order with shortened descriptions."""
    return (
        ranked(issues)
        .limit(n)
        .select(
            "severity_rank", "issue_id", "agent", "title", "severity", "count", "confidence",
            F.substring("description", 1, width).alias("description"),
        )
    )


def top_priorities(issues: DataFrame, n: int = 3) -> DataFrame:
    """(priority, text) for the first issues in rank order."""
    top = ranked(issues).limit(n).agg(F.array_sort(F.collect_list(F.struct(
        "severity_rank", (-F.col("confidence")).alias("less_sure"), "issue_id", "agent", "title", "suggested_fix",
    ))).alias("kept"))
    return top.select(F.posexplode("kept").alias("place", "issue")).select(
        (F.col("place") + 1).alias("priority"),
        F.format_string(
            "Priority %d: [%s] %s - %s", F.col("place") + 1, "issue.agent", "issue.title", "issue.suggested_fix"
        ).alias("text"),
    )


def executive_summary(scored: DataFrame) -> DataFrame:
    """One row: the score with a sentence about it. ``scored`` comes from a health score."""
    found = F.format_string(
        "Data health score is %d/100. %d issues found (HIGH: %d, MEDIUM: %d, LOW: %d).",
        "health_score", "total", "high", "medium", "low",
    )
    text = F.when(F.col("total") == 0, "No issues detected. Dataset appears clean.").otherwise(found)
    if "n_failed" in scored.columns:
        text = F.when(F.col("n_failed") > 0, F.format_string(
            "No health score: %d check families failed. %d issues found by the others.", "n_failed", "total")).otherwise(text)
    return scored.withColumn("summary", text)


def issues_per_agent(issues: DataFrame) -> DataFrame:
    return issues.groupBy("agent").agg(F.count("*").alias("n_issues")).orderBy(F.desc("n_issues"), "agent")


def search(issues: DataFrame, severity: str = "ALL", text: str = "") -> DataFrame:
    """Issues of a severity whose title or description contains the text, whatever its case."""
    wanted = F.lit(text.lower())
    hit = F.contains(F.lower("title"), wanted) | F.contains(F.lower("description"), wanted)
    return issues.where(hit if severity == "ALL" else hit & (F.col("severity") == severity))


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "green").when(score >= 50, "amber").when(score.isNotNull(), "red").otherwise("unknown")


def domain_name(domain: Column) -> Column:
    known = F.create_map(*[x for k, v in DOMAIN_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(known[domain], domain)


def severity_shares(issues: DataFrame) -> DataFrame:
    """(severity, n_issues, share_pct)."""
    counts = issues.groupBy("severity").agg(F.count("*").alias("n_issues"))
    # The window runs over one row per severity.
    return counts.withColumn("share_pct", F.col("n_issues") * 100.0 / F.sum("n_issues").over(Window.partitionBy()))


def row_preview(rows: Column, count: Column, shown: int = 5) -> Column:
    """The first affected rows and how many more there are."""
    more = F.when(count > shown, F.concat(F.lit(" (+"), (count - shown).cast("string"), F.lit(" more)")))
    listed = F.concat(F.array_join(F.slice(rows, 1, shown), ", "), F.coalesce(more, F.lit("")))
    return F.when(F.size(rows) == 0, F.concat(listed, F.lit(" (Dataset wide)"))).otherwise(listed)


def report(
    issues: DataFrame, run_stats: DataFrame, metadata: DataFrame, domain: str, generated_at: str,
    model: str = "file",
) -> DataFrame:
    """One row with the scores, texts, run statistics and the first issues; all issues stay in
    their own table."""
    scored = (file_health_score if model == "file" else sheet_health_score)(issues, run_stats)
    texts = executive_summary(scored).select(
        "health_score",
        score_band(F.col("health_score")).alias("score_band"),
        F.col("summary").alias("executive_summary"),
        F.struct(F.col("high").alias("HIGH"), F.col("medium").alias("MEDIUM"), F.col("low").alias("LOW")).alias(
            "total_issues_by_severity"
        ),
    )
    first = top_priorities(issues).agg(F.array_sort(F.collect_list(F.struct("priority", "text"))).alias("p"))
    kept = brief(issues)
    listed = kept.agg(F.array_sort(F.collect_list(F.struct(*kept.columns))).alias("top_issues"))
    statuses = run_stats.agg(F.array_sort(F.collect_list(F.struct(
        "name", "status", "duration_ms", "issue_count"
    ))).alias("agent_statuses"))
    meta = metadata.select(F.struct(*metadata.columns).alias("metadata"))
    priorities = first.select(F.col("p.text").alias("top_priorities"))
    return side_by_side(meta, texts, priorities, listed, statuses).withColumns(
        {"domain": domain_name(F.lit(domain)), "generated_at": F.lit(generated_at)}
    )
