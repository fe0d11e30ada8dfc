"""Fixed values and parameters shared by every check."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: these must equal the audited product's lists for equal results -----------

# Readers treat these as missing in addition to real nulls.
NULL_TOKENS = ("", "—", "N/A", "None", "null")
# The sheet missing-value check looks for these literally (no trimming, no case folding).
SHEET_MISSING_TOKENS = ("", "null", "N/A")
# Text that counts as 0 when a sheet column is read as a number.
NUMBER_PLACEHOLDERS = ("", "—", "N/A", "null", "none", "done")
# Text that the sheet quality check proposes to replace by 0 (compared trimmed, lower case).
NON_NUMERIC_PLACEHOLDERS = ("done", "n/a", "—", "none")

DONE_STATUSES = ("done", "completed", "closed", "resolved")
COMPLETE_STATUSES = ("done", "completed")
SHEET_FINISHED_STATUSES = ("done", "cancelled")
SHEET_NOT_OVERDUE_STATUSES = ("done", "completed", "cancelled")

PERCENT_NAMES = ("pct", "percent")
AMOUNT_NAMES = ("price", "budget", "cost", "amount", "salary")
NON_NEGATIVE_NAMES = ("age", "years", "count", "quantity", "hours", "days", "score", "rating")
DUE_NAMES = ("due", "deadline")
UPDATED_NAMES = ("update", "modified")
START_NAMES = ("start",)

SEVERITY_RANK = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
UNKNOWN_SEVERITY_RANK = 3

AGENTS = (
    "duplicate_hunter",
    "data_quality",
    "business_logic",
    "stale_records",
    "anomaly_detector",
)
DEFAULT_CONFIDENCE = {
    "duplicate_hunter": 0.8,
    "data_quality": 0.8,
    "business_logic": 0.9,
    "anomaly_detector": 0.7,
    "stale_records": 0.85,
}
DEFAULT_FIX = {
    "duplicate_hunter": "Manual review needed.",
    "data_quality": "Review quality issue.",
    "business_logic": "Fix logic inconsistency.",
    "anomaly_detector": "Review outlier distribution.",
    "stale_records": "Review record status.",
}

# Health score of a file audit: points per issue and the most each severity can cost.
FILE_PENALTY = {"HIGH": (12, 55), "MEDIUM": (6, 30), "LOW": (2, 15)}
# Health score of a sheet audit: points per issue, and the floor when there is any issue.
SHEET_PENALTY = {"HIGH": "0.60", "MEDIUM": "0.15", "LOW": "0.05"}
SHEET_FLOOR = 15

PATCH_TYPES = ("update_cell_value", "update_status", "add_comment")

# Titles of sheet issues, and what corrections write into cells.
SHEET_TITLES = {
    "P1": "Duplicate Task ID",
    "P2": "Near-Duplicate Records",
    "P3": "Data Integrity Issue",
    "P5": "Status Conflict",
    "P6": "Completion Contradiction",
    "P7": "Overdue Task",
    "P8": "Budget Overrun",
}
STALE_NOTE = "[STALE] %sd overdue"
OVERRUN_NOTE = "[AI] Overrun detected."
RENAMED_ID = "_DUP"

DOMAIN_NAMES = {
    "generic": "Generic",
    "project_management": "Project Management",
    "hr": "Human Resources",
    "finance": "Finance",
}

# --- Parameters ------------------------------------------------------------------------------

DATE_FORMATS = ("yyyy-MM-dd",)
PREVIEW_ROWS = 100


@dataclass(frozen=True)
class Thresholds:
    null_low: float = 0.05
    null_medium: float = 0.20
    null_high: float = 0.50
    z: float = 2.5
    z_high: float = 4.0
    iqr_k: float = 1.5
    skew: float = 3.0
    min_values: int = 10
    due_fill: float = 0.8
    zombie_days: int = 60
    long_running_days: int = 90
    duplicate_share_high: float = 0.05


@dataclass(frozen=True)
class ColumnRoles:
    """What the columns of an audited table mean; see operators.schema.infer_roles."""

    types: dict = field(default_factory=dict)
    key: tuple = ()
    date_pairs: tuple = ()
    date_formats: tuple = DATE_FORMATS
    actual: str = "actual_cost"
    budget: str = "budget"
    not_percent: tuple = ()

    def of_type(self, *wanted: str) -> list[str]:
        return [c for c, t in self.types.items() if t in wanted]


@dataclass(frozen=True)
class SheetColumns:
    """Column names of an audited sheet."""

    row_id: str = "row_id"
    row_number: str = "row_number"
    task_id: str = "task_id"
    task_name: str = "task_name"
    owner: str = "assigned_to"
    status: str = "status"
    due: str = "due_date"
    completion: str = "completion_pct"
    subtasks: str = "subtask_count"
    budget: str = "budget_usd"
    actual: str = "actual_cost_usd"


def name_has(column: str, parts) -> bool:
    return any(p in column.lower() for p in parts)
