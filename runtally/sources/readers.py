"""Readers: every source becomes one of the canonical schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from runtally.functions.scalars import (empty_map, key_values, last_wins, parse_bool, parse_params,
                                        predecessor_list, quotes_balanced, tokenize_line)
from runtally.operators.windows import wait_sequences
from runtally.schemas import (CHECKPOINT_DOC, CHECKPOINT_LACKS, KEYED_TASKS, MEASURES, NO_TASKS, RESERVED_KEYS, RUNS, TASK_DEFS, TASKFILE_DOC, TASKS,
                              UNKNOWN_MODE, conform)
from runtally.session import cut


def read_runs(spark: SparkSession, path: str, workflow: str | None = None) -> DataFrame:
    """Run headers, newest first."""
    df = spark.read.schema(RUNS).parquet(path).select(*RUNS.fieldNames())
    if workflow is not None:
        df = df.filter(F.col("workflow") == workflow)
    return df.orderBy(F.desc("start_time"))


def read_task_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TASKS).parquet(path).select(*TASKS.fieldNames())


def decode_tasks(df: DataFrame) -> DataFrame:
    """Rows as a relational store keeps them (1/0/NULL flags, JSON text, ISO times) to the task schema."""
    have = {f.name: f.dataType for f in df.schema.fields}

    def col(f: T.StructField) -> Column:
        if f.name not in have:
            return F.lit(None)
        c = F.col(f.name)
        if isinstance(have[f.name], T.StringType) and isinstance(f.dataType, (T.MapType, T.ArrayType)):
            c = F.from_json(c, f.dataType.simpleString())
        if f.name == "parameters":
            c = F.coalesce(c, empty_map())
        return c

    return df.select(*[col(f).cast(f.dataType).alias(f.name) for f in TASKS.fields])


def schema_evolve(old: DataFrame, schema: T.StructType) -> DataFrame:
    """History written before columns were added: the missing ones become typed NULLs."""
    return conform(old, schema)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Exported document-store items, one JSON object per line."""
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in KEYED_TASKS.fields])
    return normalise_items(spark.read.schema(raw).json(path))


def normalise_items(items: DataFrame) -> DataFrame:
    """Items to the task schema and their key: numbers parsed, missing retries 0, missing parameters empty."""
    have = set(items.columns)

    def text(name: str) -> Column:
        return F.col(name).cast("string") if name in have else F.lit(None).cast("string")

    out = {f.name: text(f.name).try_cast(f.dataType) for f in KEYED_TASKS.fields
           if not isinstance(f.dataType, (T.MapType, T.ArrayType))}
    out["retry_count"] = F.coalesce(text("retry_count").try_cast("int"), F.lit(0))
    out["parameters"] = F.coalesce(F.from_json(text("parameters"), "map<string,string>"), empty_map())
    out["predecessors"] = F.from_json(text("predecessors"), "array<string>")
    return items.select(*[out[f.name].alias(f.name) for f in KEYED_TASKS.fields])


# ---- task files -------------------------------------------------------------

def read_taskfiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON task documents ``…/{workflow}/{run_id}.json`` to (files, task definitions).

    One document is one JSON value, so one file is read by one task.
    """
    docs = spark.read.schema(TASKFILE_DOC).option("multiLine", True).json(path).select(
        "*", F.col("_metadata.file_path").alias("file"))
    return taskfile_tables(docs)


def taskfile_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed documents ``(file, version, metadata, settings, tasks)`` to files and definitions."""
    where = r"([^/]+)/([^/]+)\.json$"
    named = docs.withColumn("workflow", F.coalesce(F.col("metadata.workflow"), F.regexp_extract("file", where, 1))) \
        .withColumn("run_id", F.regexp_extract("file", where, 2))
    files = named.select("file", "workflow", "run_id", "version", "metadata.name", "metadata.description",
                         "metadata.author", "settings.*")
    tasks = named.select("file", "workflow", "run_id", F.posexplode("tasks").alias("pos", "t")) \
        .select("file", "workflow", "run_id", "pos", "t.*")
    return files, task_defaults(tasks)


def task_defaults(tasks: DataFrame) -> DataFrame:
    """Optional task fields filled in; an empty process or chore counts as absent."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    none = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    extra = [c for c in tasks.columns if c not in TASK_DEFS.fieldNames()]
    return tasks.select(
        *extra, "workflow", "run_id", F.col("pos").cast("long").alias("pos"), "id", "instance",
        none("process"), none("chore"), F.coalesce("parameters", empty_map()).alias("parameters"),
        F.coalesce("predecessors", F.array().cast("array<string>")).alias("predecessors"), "stage",
        flag("safe_retry"), "timeout", flag("cancel_at_timeout"), flag("require_predecessor_success"),
        flag("succeed_on_minor_errors"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as ``(file, line_no, value)``; large files stay split.

    A first scan counts the lines of every split of a file. A line's number is the number of lines in the splits before its own, and
    its place in that: the second scan neither sorts nor writes the text, and meets a table of one row for each split.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"), "value")
    splits = raw.groupBy("file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = splits.select("file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return raw.join(shifts, ["file", "_block"]).select("file", (F.col("_row") + F.col("_shift")).alias("line_no"), "value")


def _meaningful(lines: DataFrame) -> DataFrame:
    text = F.trim(F.col("value"), F.lit(" \t\r\n\f\v"))
    return lines.withColumn("value", text).filter((F.col("value") != "") & ~F.col("value").startswith("#"))


def detect_line_mode(lines: DataFrame) -> DataFrame:
    """Kind of every file and, from its first meaningful line, the mode of a line file."""
    first = _meaningful(lines).groupBy("file").agg(F.min_by("value", "line_no").alias("first_line"))
    v = F.col("first_line")
    ext = F.lower(F.regexp_extract("file", r"(\.[^./]*)$", 1))
    kind = F.when(ext == ".json", "json").when(ext == ".txt", "txt") \
        .when(v.startswith("{"), "json").otherwise("txt")
    mode = (F.when(F.lower(v) == "wait", "norm").when(v.startswith("id="), "opt")
            .when(v.startswith("instance="), "norm"))
    error = F.when(v.isNull(), NO_TASKS) \
        .when(mode.isNull(), F.concat(F.lit(UNKNOWN_MODE), F.substring(v, 1, 50)))
    is_txt = F.col("file_type") == "txt"
    return lines.select("file").distinct().join(first, "file", "left").withColumn("file_type", kind).select(
        "file", "file_type", F.when(is_txt, mode).alias("mode"), F.when(is_txt, error).alias("error"))


def parse_task_lines(lines: DataFrame) -> DataFrame:
    """Task lines ``(file, line_no, value)`` to definitions.

    A ``wait`` line starts a new sequence; its tasks wait for the whole sequence before,
    given as ``previous`` and ``previous_size`` instead of a list repeated on every task.
    Lines with unbalanced quotes are passed over. Tasks without an id are numbered.
    """
    ok = _meaningful(lines)
    is_wait = F.lower("value") == "wait"
    ok = ok.filter(is_wait | quotes_balanced("value"))
    pairs = key_values(tokenize_line("value"))
    known = F.transform(pairs, lambda p: F.struct(
        F.when(F.lower(p["key"]).isin(*RESERVED_KEYS), F.lower(p["key"])).otherwise(p["key"]).alias("key"),
        p["value"].alias("value")))
    kv = lambda k: F.col("_kv")[k]
    # The pairs are a column of their own: an expression used several times runs several times.
    parsed = ok.select("file", "line_no", is_wait.alias("_is_wait"), known.alias("_pairs")) \
        .select("file", "line_no", "_is_wait", last_wins(F.col("_pairs")).alias("_kv")) \
        .withColumn("_noid", (~F.col("_is_wait") & kv("id").isNull()).cast("long"))
    # Both steps of the running sums read the rows: parse them once.
    t = wait_sequences(cut(parsed), ["file"], "line_no", F.col("_is_wait"), compact=False, also={"_auto": "_noid"})
    listed = predecessor_list(kv("predecessors"))
    name = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    return t.select(
        "file", name.alias("workflow"), F.col("line_no").alias("pos"),
        F.coalesce(kv("id"), F.col("_auto").cast("string")).alias("id"),
        F.coalesce(kv("instance"), F.lit("")).alias("instance"),
        F.nullif(kv("process"), F.lit("")).alias("process"), F.nullif(kv("chore"), F.lit("")).alias("chore"),
        F.map_filter("_kv", lambda k, v: ~k.isin(*RESERVED_KEYS)).alias("parameters"),
        listed.alias("predecessors"), "sequence", "previous", "previous_size",
        F.nullif(kv("stage"), F.lit("")).alias("stage"), parse_bool(kv("safe_retry"), True).alias("safe_retry"),
        kv("timeout").try_cast("int").alias("timeout"),
        parse_bool(kv("cancel_at_timeout"), True).alias("cancel_at_timeout"),
        parse_bool(kv("require_predecessor_success"), True).alias("require_predecessor_success"),
        parse_bool(kv("succeed_on_minor_errors"), True).alias("succeed_on_minor_errors"))


def read_task_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_task_lines(read_lines(spark, path))


# ---- checkpoints ------------------------------------------------------------

REQUIRED_CHECKPOINT_FIELDS = ("taskfile_path", "workflow", "run_started")


def read_checkpoints(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.schema(CHECKPOINT_DOC).option("multiLine", True).json(path).select(
        "*", F.col("_metadata.file_path").alias("checkpoint"))
    return checkpoint_tables(docs)


def checkpoint_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents to one row per task and state, and the documents that lack a required field."""
    absent = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED_CHECKPOINT_FIELDS]))
    bad = docs.filter(F.size(absent) > 0).select(
        "checkpoint", F.concat(F.lit(CHECKPOINT_LACKS), F.element_at(absent, 1)).alias("error"))
    good = docs.filter(F.size(absent) == 0)

    def listed(column: str, state: str) -> Column:
        return F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda t: F.struct(
            t.alias("task_id"), F.lit(state).alias("state"), F.lit(None).cast("boolean").alias("success"),
            F.lit(None).cast("double").alias("duration_seconds"), F.lit(None).cast("int").alias("retry_count"),
            F.lit(None).cast("string").alias("error_message")))

    done = F.transform(F.coalesce(F.map_entries("completed_tasks"), F.array()), lambda e: F.struct(
        e["key"].alias("task_id"), F.lit("completed").alias("state"), e["value"]["success"].alias("success"),
        e["value"]["duration_seconds"].alias("duration_seconds"), e["value"]["retry_count"].alias("retry_count"),
        e["value"]["error_message"].alias("error_message")))
    rows = F.concat(done, listed("in_progress_tasks", "in_progress"), listed("pending_tasks", "pending"),
                    listed("failed_tasks", "failed"), listed("skipped_tasks", "skipped"))
    return good.select("checkpoint", "workflow", "taskfile_path", "taskfile_hash", "total_tasks", F.inline(rows)), bad


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each task file."""
    return spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("taskfile_path"), F.sha2("content", 256).alias("current_hash"))


# ---- cube cells -------------------------------------------------------------

def cells_to_tasks(cells: DataFrame, run: str = "Input") -> DataFrame:
    """Input slice of a cube to one wide row per task; empty cells and rows do not exist."""
    names = [m for m, is_input, _ in MEASURES if is_input]
    slice_ = cells.filter((F.col("run_id") == run) & F.col("measure").isin(*names)
                          & (F.coalesce("value", F.lit("")) != ""))
    return slice_.groupBy("workflow", "task_id").pivot("measure", names).agg(F.first("value"))


def tasks_from_wide(wide: DataFrame, mode: str = "norm", pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """Wide rows of text to (definitions, errors).

    Rows without an instance or without a target are no tasks; a row with both targets is
    an error. In ``norm`` mode ``wait`` rows order the tasks by sequences, in ``opt`` mode
    the listed predecessors do.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    is_wait = parse_bool("wait")
    if mode == "norm":
        t = wait_sequences(wide, ["workflow"], pos, is_wait, compact=False)
        preds = F.array().cast("array<string>")
        order = ["sequence", "previous", "previous_size"]
    else:
        t = wide.filter(~is_wait)
        preds = predecessor_list("predecessors", cube=True)
        order = []
    t = t.withColumn("instance", text("instance")).withColumn("process", text("process")).withColumn("chore", text("chore"))
    real = t.filter((F.col("instance") != "") & ((F.col("process") != "") | (F.col("chore") != "")))
    both = (F.col("process") != "") & (F.col("chore") != "")
    errors = real.filter(both).select("workflow", "task_id", F.concat(
        F.lit("Task '"), F.col("task_id"), F.lit("': both 'process' and 'chore' are set")).alias("error"))
    none = lambda c: F.nullif(F.col(c), F.lit(""))
    defs = real.filter(~both).select(
        "workflow", pos, F.trim("task_id").alias("id"), "instance", none("process").alias("process"),
        none("chore").alias("chore"),
        F.when(F.col("process") != "", parse_params(text("parameters"))).otherwise(empty_map()).alias("parameters"),
        preds.alias("predecessors"), *order, F.nullif(text("stage"), F.lit("")).alias("stage"),
        parse_bool("safe_retry").alias("safe_retry"), text("timeout").try_cast("int").alias("timeout"),
        *[parse_bool(c).alias(c) for c in ("cancel_at_timeout", "require_predecessor_success", "succeed_on_minor_errors")])
    return defs, errors


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Task rows of several stores in one schema, with the key of those that have one."""
    out = conform(frames[0], KEYED_TASKS)
    for f in frames[1:]:
        out = out.unionByName(conform(f, KEYED_TASKS))
    return out
