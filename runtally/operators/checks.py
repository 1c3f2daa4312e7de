"""Structural checks of task definitions, task files and result headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from runtally.functions.scalars import positive_int_id
from runtally.schemas import CHORE_FORBIDDEN, TASKFILE_FAULTS, UPLOAD_COLUMNS
from runtally.session import kept


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def validate_tasks(defs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per broken rule of a task definition."""
    has_process, has_chore = ~_blank("process"), ~_blank("chore")
    only_chore = has_chore & ~has_process
    given = {"parameters": F.coalesce(F.size("parameters"), F.lit(0)) > 0,
             "succeed_on_minor_errors": F.coalesce("succeed_on_minor_errors", F.lit(False)),
             "timeout": F.col("timeout").isNotNull(),
             "cancel_at_timeout": F.coalesce("cancel_at_timeout", F.lit(False))}

    def broken(rule: str, cond: Column, text: Column | str) -> Column:
        message = F.lit(text) if isinstance(text, str) else text
        return F.when(cond, F.struct(F.lit(rule).alias("rule"), message.alias("message")))

    rules = [broken("required", _blank(p), f"Missing required property '{p}'") for p in ("id", "instance")]
    rules += [
        broken("one_target", has_process & has_chore,
               "'process' and 'chore' are mutually exclusive — exactly one must be set"),
        broken("one_target", ~has_process & ~has_chore, "exactly one of 'process' or 'chore' must be set"),
        *[broken("chore_field", only_chore & given[f], f"'{f}' is not allowed on chore tasks ({why})")
          for f, why in CHORE_FORBIDDEN],
        broken("id", F.col("id").isNotNull() & ~positive_int_id("id"),
               F.concat(F.lit("'id' must be a positive integer. Got: "), F.col("id"))),
        broken("timeout", F.coalesce(F.col("timeout") < 0, F.lit(False)),
               "'timeout' must be a non-negative integer"),
    ]
    preds = F.filter(F.transform(F.coalesce("predecessors", F.array().cast("array<string>")), lambda p, i: F.when(
        ~positive_int_id(p), F.struct(F.lit("predecessor").alias("rule"), F.concat(
            F.lit("predecessors["), i.cast("string"), F.lit("] must be a positive integer. Got: "),
            F.coalesce(p, F.lit("null"))).alias("message")))), lambda x: x.isNotNull())
    found = F.concat(F.array_compact(F.array(*rules)), preds)
    return defs.select(*keys, "pos", F.inline(found))


def validate_taskfiles(files: DataFrame, defs: DataFrame, key: str = "file") -> DataFrame:
    """One row per broken file rule.

    ``files(file, version, max_workers, retries)``, ``defs(file, pos, id)``.
    """
    defs = kept(defs.select(key, "pos", "id"))
    n = defs.groupBy(key).agg(F.count("*").alias("_n"))
    f = files.join(n, key, "left")

    def row(cond: Column, text: str) -> Column:
        return F.when(cond, F.lit(text))

    of_file = f.select(key, F.explode(F.array_compact(F.array(
        row(F.col("version").isNull(), TASKFILE_FAULTS["version"]),
        row(F.col("_n").isNull(), TASKFILE_FAULTS["tasks"]),
        row(F.coalesce(F.col("max_workers") < 1, F.lit(False)), TASKFILE_FAULTS["max_workers"]),
        row(F.coalesce(F.col("retries") < 0, F.lit(False)), TASKFILE_FAULTS["retries"]),
    ))).alias("message"))
    ids = defs.filter(F.col("id").isNotNull())
    first = ids.groupBy(key, "id").agg(F.min("pos").alias("_first"), F.count("*").alias("_m")).filter("_m > 1")
    twice = ids.join(first, [key, "id"]).filter(F.col("pos") > F.col("_first")).select(key, F.concat(
        F.lit("Task "), F.col("pos").cast("string"), F.lit(": Duplicate task ID '"), F.col("id"), F.lit("'")).alias("message"))
    return of_file.unionByName(twice)


def header_contract(headers: DataFrame) -> DataFrame:
    """Columns of ``headers(file, columns)`` that are not where the loader expects them."""
    expected = F.array(*[F.lit(c) for c in UPLOAD_COLUMNS])
    norm = lambda c: F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit("")))
    pairs = F.zip_with(expected, F.slice("columns", 1, len(UPLOAD_COLUMNS)),
                       lambda e, a: F.when(norm(e) != norm(a), e))
    wrong = F.array_compact(pairs)
    return headers.select("file", (F.size(wrong) == 0).alias("valid"), F.array_join(wrong, " ").alias("mismatched"))
