"""Ordered computations that never need one whole group in one task.

A window partitioned by a run or a workflow sends that group to a single task. One
group may hold a third of all rows, so ranks, running sums and order statistics are
built here in two steps: per block of a group, then over the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from runtally.session import cut, kept


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; keeps the left key columns."""
    if not keys:
        raise ValueError("at least one key")
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(r, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def running_sums(points: DataFrame, keys: Sequence[str], at: str, block: Column,
                 sums: dict[str, str]) -> DataFrame:
    """Add inclusive running sums over ``at`` within ``keys``.

    ``points`` holds one row per (keys, at). ``block`` must grow with ``at``; it cuts
    a large group into pieces that are summed apart and then shifted.
    """
    keys = list(keys)
    pts = points.withColumn("_block", block).withColumn("_group", F.struct(*[F.col(k) for k in keys]))
    totals = pts.groupBy("_group", "_block").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums.values()])
    earlier = Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("_group", "_block", *[
        F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_s_{c}") for c in sums.values()])
    inside = (Window.partitionBy("_group", "_block").orderBy(at)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = pts.select("*", *[F.sum(c).over(inside).alias(f"_i_{name}") for name, c in sums.items()])
    return summed.join(shifts, ["_group", "_block"]).select(*points.columns, *[
        (F.col(f"_s_{c}") + F.col(f"_i_{name}")).alias(name) for name, c in sums.items()])


def histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with count ``c`` and rows up to and including them ``upto``.

    Blocks are cut at sampled quantiles of (group, value), so no group and no stretch of near values is one task's alone, however many
    distinct values lie close together. Checkpointed: every statistic of the group is then read from this small table.
    """
    h = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    return cut(scanned(h, keys, [value], sums={"upto": "c"}))


def order_statistics(hist: DataFrame, keys: Sequence[str], value: str,
                     positions: dict[str, Callable[[Column], Column]], moments: bool = False) -> DataFrame:
    """Exact i-th smallest values per group; each position is a 0-based function of n.

    ``moments`` adds min, max, mean and the sample deviation from the same histogram.
    """
    keys = list(keys)
    v, c, n = F.col(value), F.col("c"), F.col("n")
    first, second = [F.sum(c).alias("n")], []
    if moments:
        first += [F.min(v).alias("min"), F.max(v).alias("max"), (F.sum(v * c) / F.sum(c)).alias("mean")]
        second = [F.sum(F.pow(v - F.col("mean"), 2) * c).alias("_dev")]
    totals = hist.groupBy(*keys).agg(*first)
    h = match(hist, totals, keys)
    hits = {name: (pos(n) >= F.col("upto") - c) & (pos(n) < F.col("upto")) for name, pos in positions.items()}
    rows = h if moments else h.filter(reduce(lambda a, b: a | b, hits.values()))
    out = rows.groupBy(*totals.columns).agg(*[F.max(F.when(hit, v)).alias(name) for name, hit in hits.items()], *second)
    if moments:
        out = out.withColumn("std_dev", F.when(n > 1, F.sqrt(F.try_divide("_dev", n - 1)))).drop("_dev")
    return out


# Quartile positions by index; fewer than four values use the ends.
QUARTILES = {
    "q1": lambda n: F.when(n >= 4, F.floor(n / 4)).otherwise(F.lit(0)),
    "q3": lambda n: F.when(n >= 4, F.floor(3 * n / 4)).otherwise(n - 1),
}
MIDDLES = {
    "mid_low": lambda n: F.floor((n - 1) / 2),
    "mid_high": lambda n: F.floor(n / 2),
}


# ---- one scan for row numbers and running sums --------------------------------------

#: Rows up to which a group is numbered in one task.
WHOLE = 100_000
#: Buckets of groups that are counted first; only groups in buckets of more than ``WHOLE`` rows are counted one by one.
BUCKETS = 1 << 16


def scanned(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], number: str | None = None,
            sums: dict[str, str] | None = None, size: str | None = None) -> DataFrame:
    """Number the rows of every group from 1 in ``order``, which should be total, and add inclusive running sums of columns and the group's size.

    Groups of at most ``WHOLE`` rows take one window. Larger ones are range-partitioned on keys and order, numbered and summed within their
    piece of a group, and shifted by the totals of the pieces before; the placed rows are checkpointed, which fixes the ranges.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    sums = dict(sums or {})
    added = _added(number, sums, size)
    hot = _hot(df, list(keys))
    if hot is None:
        return _in_windows(df, [F.col(k) for k in keys], order, number, sums, size).select(*df.columns, *added)
    rows = df.withColumn("_group", _group(keys))
    whole = _in_windows(rows.join(hot, "_group", "left_anti"), [F.col("_group")], order, number, sums, size)
    pieces = _in_pieces(rows.join(hot, "_group", "left_semi"), [F.col(k) for k in keys], order, number, sums, size)
    return whole.select(*df.columns, *added).unionByName(pieces.select(*df.columns, *added))


def _group(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0))


def _hot(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """The groups of more than ``WHOLE`` rows as ``_group``, None without any."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)) if keys else F.lit(0)
    full = [r[0] for r in df.groupBy(bucket.alias("_bucket")).count().where(F.col("count") > WHOLE).select("_bucket").collect()]
    if not full:
        return None
    some = (df if len(full) > 100 else df.where(bucket.isin(full))).groupBy(_group(keys).alias("_group")).count()
    hot = kept(some.where(F.col("count") > WHOLE).select("_group"))
    return None if hot.isEmpty() else hot


def _added(number: str | None, sums: dict[str, str], size: str | None) -> list[str]:
    return [*([number] if number else []), *sums, *([size] if size else [])]


def _in_windows(rows: DataFrame, keys: list[Column], order: list[Column], number: str | None, sums: dict[str, str], size: str | None) -> DataFrame:
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    inside = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = [F.row_number().over(inside).cast("long").alias(number)] if number else []
    here += [F.sum(c).over(inside).alias(name) for name, c in sums.items()]
    return rows.select("*", *here, *([F.count(F.lit(1)).over(group).alias(size)] if size else []))


def _in_pieces(rows: DataFrame, keys: list[Column], order: list[Column], number: str | None, sums: dict[str, str], size: str | None) -> DataFrame:
    placed = cut(rows.repartitionByRange(*keys, *order).withColumn("_piece", F.spark_partition_id()))
    inside = Window.partitionBy("_group", "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = placed.groupBy("_group", "_piece").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()])
    of_group = Window.partitionBy("_group")
    earlier = of_group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_group", "_piece", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_n", *[f"_t_{name}" for name in sums])],
                           F.sum("_n").over(of_group).alias("_all"))
    here = [F.row_number().over(inside).alias("_no")] if number else []
    here += [F.sum(c).over(inside).alias(f"_s_{name}") for name, c in sums.items()]
    out = placed.select("*", *here).join(before, ["_group", "_piece"])
    added = [(F.col("_no") + F.col("_n")).cast("long").alias(number)] if number else []
    added += [(F.col(f"_s_{name}") + F.col(f"_t_{name}")).alias(name) for name in sums]
    return out.select(*rows.columns, *added, *([F.col("_all").alias(size)] if size else []))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str) -> DataFrame:
    """Number the rows of every group from 1 in ``order``, which should be total."""
    return scanned(df, keys, order, number=out)
