"""Registration of queries with their oracle SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from catalog.tables import CTES
from runtally.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TS_SPARK, TS_SQL = "yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder for a table written and read back."""
    return f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"


def plain(df: DataFrame) -> DataFrame:
    """Comparable values: times as text, doubles to six decimals."""
    def one(f: T.StructField):
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(f.name, TS_SPARK).alias(f.name)
        if isinstance(f.dataType, T.DoubleType):
            return (F.round(F.col(f.name).cast("decimal(28,10)"), 6).cast("double") + F.lit(0.0)).alias(f.name)
        return F.col(f.name)

    return df.select(*[one(f) for f in df.schema.fields])


def with_ctes(sql: str) -> str:
    """Prefix the shared CTEs that ``sql`` uses, in dependency order."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in need and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text, re.I):
                visit(body)
                if name not in need:
                    need.append(name)

    visit(sql)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in need)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}{', ' if head else ''}{body[14:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head}{', ' if head else ''}{body[5:]}"
    return f"WITH {head} {body}" if head else body


def query(name: str, sql: str | None = None, dbl: str = "", ts: str = ""):
    """Register ``fn(spark, sf_dir)``; ``dbl`` lists ``column:digits``, ``ts`` time columns."""
    def register(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain(fn(spark, sf))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            parts = []
            for item in filter(None, (d.strip() for d in dbl.split(","))):
                col, _, n = item.partition(":")
                parts.append(f"CAST(round(CAST({col} AS DECIMAL(28,10)), {n or 6}) AS DOUBLE) AS {col}")
            for col in filter(None, (t.strip() for t in ts.split(","))):
                parts.append(f"strftime({col}, '{TS_SQL}') AS {col}")
            full = with_ctes(sql)
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(parts)}) FROM ({full}) _q" if parts else full
        return fn
    return register
