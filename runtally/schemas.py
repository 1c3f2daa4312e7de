"""Canonical schemas and fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_S, _I, _D, _B, _TS = (T.StringType(), T.IntegerType(), T.DoubleType(),
                       T.BooleanType(), T.TimestampType())
_PARAMS = T.MapType(T.StringType(), T.StringType())
_IDS = T.ArrayType(T.StringType())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


RUNS = _struct(
    ("run_id", _S), ("workflow", _S), ("taskfile_path", _S),
    ("start_time", _TS), ("end_time", _TS), ("duration_seconds", _D),
    ("status", _S), ("task_count", _I), ("success_count", _I), ("failure_count", _I),
    ("taskfile_name", _S), ("taskfile_description", _S), ("taskfile_author", _S),
    ("max_workers", _I), ("retries", _I), ("result_file", _S),
    ("exclusive", _B), ("optimize", _B), ("optimization_algorithm", _S),
)

TASKS = _struct(
    ("id", T.LongType()), ("run_id", _S), ("workflow", _S), ("task_id", _S),
    ("task_signature", _S), ("instance", _S), ("process", _S), ("chore", _S),
    ("parameters", _PARAMS), ("status", _S), ("start_time", _TS), ("end_time", _TS),
    ("duration_seconds", _D), ("retry_count", _I), ("error_message", _S),
    ("predecessors", _IDS), ("stage", _S), ("safe_retry", _B), ("timeout", _I),
    ("cancel_at_timeout", _B), ("require_predecessor_success", _B),
    ("succeed_on_minor_errors", _B),
)

# Task rows of all stores. The document store has no id; its key is "start time#task#random".
TASK_KEY = "task_result_id"
KEYED_TASKS = T.StructType([*TASKS.fields, T.StructField(TASK_KEY, _S, True)])

TASK_DEFS = _struct(
    ("workflow", _S), ("run_id", _S), ("pos", T.LongType()), ("id", _S),
    ("instance", _S), ("process", _S), ("chore", _S), ("parameters", _PARAMS),
    ("predecessors", _IDS), ("stage", _S), ("safe_retry", _B), ("timeout", _I),
    ("cancel_at_timeout", _B), ("require_predecessor_success", _B),
    ("succeed_on_minor_errors", _B),
)

# One task inside a JSON task document.
TASK_DOC = _struct(
    ("id", _S), ("instance", _S), ("process", _S), ("chore", _S),
    ("parameters", _PARAMS), ("predecessors", _IDS), ("stage", _S),
    ("safe_retry", _B), ("timeout", _I), ("cancel_at_timeout", _B),
    ("require_predecessor_success", _B), ("succeed_on_minor_errors", _B),
)

TASKFILE_DOC = _struct(
    ("version", _S),
    ("metadata", _struct(("workflow", _S), ("name", _S), ("description", _S), ("author", _S))),
    ("settings", _struct(
        ("max_workers", _I), ("retries", _I), ("result_file", _S), ("exclusive", _B),
        ("optimization_algorithm", _S), ("push_results", _B), ("auto_load_results", _B),
        ("stage_order", _IDS),
        ("stage_workers", T.MapType(T.StringType(), T.IntegerType())))),
    ("tasks", T.ArrayType(TASK_DOC)),
)

_RESULT = _struct(
    ("task_id", _S), ("success", _B), ("start_time", _S), ("end_time", _S),
    ("duration_seconds", _D), ("retry_count", _I), ("error_message", _S),
)

CHECKPOINT_DOC = _struct(
    ("version", _S), ("taskfile_path", _S), ("workflow", _S), ("taskfile_hash", _S),
    ("run_started", _S), ("checkpoint_created", _S), ("total_tasks", _I),
    ("completed_tasks", T.MapType(T.StringType(), _RESULT)),
    ("in_progress_tasks", _IDS), ("pending_tasks", _IDS),
    ("failed_tasks", _IDS), ("skipped_tasks", _IDS),
)

CELLS = _struct(("workflow", _S), ("run_id", _S), ("task_id", _S), ("measure", _S), ("value", _S))

# ---- Fixed values: they must equal the established formats ------------------

# Measures of a result cube with their role: (measure, is input, is result).
MEASURES = (
    ("instance", True, True),
    ("process", True, True),
    ("chore", True, True),
    ("parameters", True, True),
    ("status", False, True),
    ("start_time", False, True),
    ("end_time", False, True),
    ("duration_seconds", False, True),
    ("retries", True, False),
    ("retry_count", False, True),
    ("error_message", False, True),
    ("predecessors", True, True),
    ("stage", True, True),
    ("safe_retry", True, True),
    ("timeout", True, True),
    ("cancel_at_timeout", True, True),
    ("require_predecessor_success", True, True),
    ("succeed_on_minor_errors", True, True),
    ("wait", True, False),
    ("original_task_id", False, True),
)

# Input measures left out per mode.
INPUT_EXCLUSIONS = {
    "opt": ("wait",),
    "norm": ("require_predecessor_success", "succeed_on_minor_errors"),
}

# Column order of an uploaded result file.
UPLOAD_COLUMNS = (
    "workflow", "run_id", "task_id", "original_task_id", "instance", "process", "chore",
    "parameters", "status", "start_time", "end_time", "duration_seconds", "retries",
    "retry_count", "error_message", "predecessors", "stage", "safe_retry", "timeout",
    "cancel_at_timeout", "require_predecessor_success", "succeed_on_minor_errors",
)

# Usual order of pipeline stages.
STAGE_ORDER = ("extract", "input", "transform", "analysis", "load", "export", "reporting")

# Spellings of true in a cube cell; a task line also accepts "y".
TRUE_WORDS = ("true", "1", "yes", "t")
TRUE_WORDS_LINE = ("1", "y", "yes", "true", "t")

# Keys of a task line that are not process parameters.
RESERVED_KEYS = (
    "id", "instance", "process", "chore", "predecessors", "stage", "safe_retry", "timeout",
    "cancel_at_timeout", "require_predecessor_success", "succeed_on_minor_errors",
)

# Document fields a chore task must not carry, with the reason shown.
CHORE_FORBIDDEN = (
    ("parameters", "chores have no invocation parameters"),
    ("succeed_on_minor_errors", "chores have no minor-error tier"),
    ("timeout", "chore execution has no timeout"),
    ("cancel_at_timeout", "no timeout to cancel"),
)

# Warnings of the contention report.
CONTENTION_WARNINGS = {
    "no_history": "No historical data found for workflow",
    "no_tasks": "No task data found for workflow",
    "no_varying": "No varying parameters found — all tasks have identical parameters",
    "no_driver": "Could not identify a clear contention-driving parameter",
    "few_heavy": "Only %d heavy group(s) detected — chaining requires at least 2",
}

# Faults of a task file as a whole.
TASKFILE_FAULTS = {
    "version": "Missing 'version' field",
    "tasks": "'tasks' array cannot be empty",
    "max_workers": "settings.max_workers must be a positive integer",
    "retries": "settings.retries must be a non-negative integer",
}

# Errors of readers; the first two are followed by what they are about.
UNKNOWN_MODE = "Cannot determine execution mode: "
CHECKPOINT_LACKS = "Checkpoint missing required field: "
NO_TASKS = "file contains no task definitions"

TASKFILE_VERSION = "2.0"
FALLBACK_ESTIMATE = 10.0
CONTEXT_MAX_LENGTH = 64


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to ``schema``; columns the input lacks become typed NULLs."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def task_order(df: DataFrame):
    """Order of task rows: by id; rows of the document store, which have none, follow by start, task and key."""
    return F.struct(F.col("id").isNull().alias("keyed"), *[c for c in ("id", "start_time", "task_id", TASK_KEY) if c in df.columns])


# Message about a set that is not there, followed by its name.
UNKNOWN_SET = "unknown set: "
