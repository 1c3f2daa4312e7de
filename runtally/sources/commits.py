"""History tables changed by workflow: a commit writes the workflows it touches and leaves all other files as they are.

A table is a folder with ``data``, Parquet files by (batch, part), and ``versions``, small Parquet rows that list which (batch, part) a version
holds. A change writes a new batch first and lists it last. A version counts only when all its rows are there, so a job that is
lost at any point leaves the version before. Nothing is overwritten: an older version stays readable. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from runtally.operators.history import _purge_condition, purge
from runtally.operators.joins import complete_run

#: Rows of a version: the parts it holds and one row without part, which an empty version has as well. ``total`` counts them all.
LISTING = "batch string, part string, total long, version long"


def _part() -> Column:
    """Part of a workflow. A null and an empty one differ; as values of a partition column Spark would take both for null."""
    return F.coalesce(F.concat(F.lit("w:"), F.col("workflow")), F.lit("none"))


def _listing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LISTING).parquet(f"{path}/versions")


def versions(spark: SparkSession, path: str) -> DataFrame:
    """version, parts of every whole version."""
    seen = _listing(spark, path).groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("total"))
    return seen.where("n = total").select("version", (F.col("n") - 1).alias("parts"))


def _newest(spark: SparkSession, path: str) -> int:
    return versions(spark, path).agg(F.max("version")).first()[0]


def _parts(spark: SparkSession, path: str, version: int | None) -> DataFrame:
    version = _newest(spark, path) if version is None else version
    return _listing(spark, path).where((F.col("version") == version) & F.col("part").isNotNull()).select("batch", "part")


def _store(rows: DataFrame, path: str) -> str:
    """Write rows as a new batch; large workflows are split over tasks, small ones merged."""
    batch = f"b-{uuid.uuid4().hex}"
    laid = rows.withColumn("batch", F.lit(batch)).withColumn("part", _part()).hint("rebalance", "part")
    laid.sortWithinPartitions("part", "run_id").write.mode("append").partitionBy("batch", "part").parquet(f"{path}/data")
    return batch


def _written(spark: SparkSession, path: str, batch: str) -> DataFrame:
    """The parts of a batch that hold rows; only the folders' names are needed."""
    return _files(spark, path, T.StructType([])).where(F.col("batch") == batch).select("batch", "part").distinct()


def _files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    fields = [*schema.fields, T.StructField("batch", T.StringType()), T.StructField("part", T.StringType())]
    return spark.read.schema(T.StructType(fields)).parquet(f"{path}/data")


def _list(parts: DataFrame, path: str) -> None:
    """The last step of a commit: one row for each part of the version, and the row that is always there."""
    spark = parts.sparkSession
    number = _listing(spark, path).agg(F.max("version")).first()[0] + 1
    total = parts.count() + 1
    always = spark.createDataFrame([(None, None)], "batch string, part string")
    always.unionByName(parts).select("batch", "part", F.lit(total).cast("long").alias("total"), F.lit(number).cast("long").alias("version")) \
        .write.mode("append").parquet(f"{path}/versions")


def create(rows: DataFrame, path: str) -> None:
    """A new table with ``rows`` (with ``workflow`` and ``run_id``) as version 1; version 0 is empty."""
    spark, batch = rows.sparkSession, _store(rows, path)
    spark.createDataFrame([(None, None, 1, 0)], LISTING).write.parquet(f"{path}/versions")
    _list(_written(spark, path, batch), path)


def current(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """Rows of the newest whole version, or of a given one; folders that the version does not list are pruned before they are read."""
    files = _files(spark, path, schema)
    return files.join(_parts(spark, path, version), ["batch", "part"], "left_semi").select(*schema.names)


def append(rows: DataFrame, path: str) -> None:
    """Add rows: a new batch beside the old ones."""
    spark = rows.sparkSession
    old = _parts(spark, path, None)
    _list(old.unionByName(_written(spark, path, _store(rows, path))), path)


def rewrite(spark: SparkSession, path: str, schema: T.StructType, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
    """Replace the rows of the touched workflows (a column ``workflow``, null included) by ``change`` of them.

    Only parts of those workflows are read and written; a workflow without rows afterwards leaves the listing.
    """
    parts = _parts(spark, path, None)
    hit = parts.join(touched.select(_part().alias("part")).distinct(), "part", "left_semi")
    old = _files(spark, path, schema).join(hit, ["batch", "part"], "left_semi").select(*schema.names)
    batch = _store(change(old).select(*schema.names), path)
    _list(parts.join(hit, ["batch", "part"], "left_anti").unionByName(_written(spark, path, batch)), path)


def purge_files(spark: SparkSession, path: str, schema: T.StructType, **which) -> None:
    """``history.purge`` on disk: one workflow, one run or everything before a date goes; without a choice all rows go."""
    rows = current(spark, path, schema)
    hit = _purge_condition(which.get("workflow"), which.get("run_id"), which.get("before"))
    rewrite(spark, path, schema, rows if hit is None else rows.where(hit), lambda old: purge(old, **which))


def complete_runs(spark: SparkSession, path: str, schema: T.StructType, tasks: DataFrame, raised: DataFrame | None = None) -> None:
    """``joins.complete_run`` on disk: closes the runs that ``tasks`` belong to, in the parts of their workflows."""
    ids = tasks.select("run_id").distinct()
    touched = current(spark, path, schema).join(ids, "run_id", "left_semi").select("workflow")

    def change(old: DataFrame) -> DataFrame:
        named = old.join(ids.withColumn("_seen", F.lit(True)), "run_id", "left")
        there = complete_run(named.where("_seen").drop("_seen"), tasks, raised)
        return there.select(*schema.names).unionByName(named.where("_seen IS NULL").select(*schema.names))

    rewrite(spark, path, schema, touched, change)
