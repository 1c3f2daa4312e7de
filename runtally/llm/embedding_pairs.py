"""Near-duplicate vectors by counting collisions of one-dimensional projections."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from runtally.llm.components import components
from runtally.llm.rows import kept, mapped

#: Projections; collisions that ask for a check; half width of a query's window, and width of the slabs of the two leading
#: projections, in standard errors of the difference of a pair just at the threshold. A pair at the threshold collides in one
#: projection with probability 0.9973; at least 12 of 16 with 1 - 1e-9; it stays within neighbouring slabs of both leading
#: projections with 1 - 1.4e-5.
PROJECTIONS, ENOUGH, WINDOW, SLAB = 16, 12, 3.0, 4.5
#: Vectors of a block on average; larger cells are split, and their parts are compared pairwise.
BLOCK = 768

#: Forward half of the neighbouring cells.
NEIGHBOURS = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))


@lru_cache(maxsize=8)
def directions(dim: int) -> np.ndarray:
    """Fixed random directions: a projected difference of length r is normal with standard error r / sqrt(dim)."""
    return np.random.default_rng(dim).standard_normal((dim, PROJECTIONS)) / math.sqrt(dim)


def spread(cosine: float, dim: int) -> float:
    """Standard error of the projected difference of unit vectors at this cosine."""
    return math.sqrt(max(2 - 2 * cosine, 1e-12) / dim)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow or underflow."""
    rows = rows.astype(float)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _every(vectors: DataFrame, key: str, embedding: str, label: str) -> DataFrame:
    return vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[embedding].cast("array<double>").alias("embedding"), vectors[label].cast("string").alias("label"))


def _usable() -> Column:
    """Whether a row can link at all."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))


def classes_of(vectors: DataFrame, key: str, embedding: str, label: str, cosine: float) -> DataFrame:
    """vec_id, node (digest of label and components), label, dim, vector, x, y (slabs) of every vector that can link."""
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        lists = [np.array(v, "<f8") for v in part.column("embedding").to_pylist()]
        x, y, node = [], [], []
        for v, lab in zip(lists, part.column("label").to_pylist()):
            lead = (unit(v[None]) @ directions(len(v))[:, :2])[0] / (SLAB * spread(cosine, len(v)))
            x.append(math.floor(lead[0]))
            y.append(math.floor(lead[1]))
            node.append(xxhash.xxh3_128_digest(f"{lab}:".encode() + v.tobytes()))
        return pa.RecordBatch.from_arrays([
            part.column("vec_id"), pa.array(node, pa.binary()), part.column("label"), pa.array([len(v) for v in lists], pa.int32()),
            pa.array([v.tobytes() for v in lists], pa.binary()), pa.array(x, pa.int32()), pa.array(y, pa.int32())],
            ["vec_id", "node", "label", "dim", "vector", "x", "y"])

    return mapped(_every(vectors, key, embedding, label).where(_usable()), run,
                  "vec_id long, node binary, label string, dim int, vector binary, x int, y int")


def compare(left: pd.DataFrame, right: pd.DataFrame | None, cosine: float) -> pd.DataFrame:
    """node, links, root for the vectors of one or two blocks that link: copies linked to, and the least node connected here.

    Windows around every query on every projection are counted; pairs with enough collisions are checked by their cosine.
    """
    dim = int(left["dim"].iloc[0])
    w = WINDOW * spread(cosine, dim)
    a = unit(np.frombuffer(b"".join(left["vector"]), "<f8").reshape(-1, dim))
    b = a if right is None else unit(np.frombuffer(b"".join(right["vector"]), "<f8").reshape(-1, dim))
    pa_, pb = a @ directions(dim), b @ directions(dim)
    hits = np.zeros((len(a), len(b)), np.int8)
    ranks = np.arange(len(b))
    for m in range(PROJECTIONS):
        order = np.argsort(pb[:, m], kind="stable")
        line = pb[order, m]
        low, high = np.searchsorted(line, pa_[:, m] - w, "left"), np.searchsorted(line, pa_[:, m] + w, "right")
        place = np.empty(len(b), int)
        place[order] = ranks
        hits += (place[None, :] >= low[:, None]) & (place[None, :] < high[:, None])
    i, j = np.nonzero(hits >= ENOUGH)
    if right is None:
        i, j = i[i < j], j[i < j]
    near = np.zeros(len(i), bool)
    for at in range(0, len(i), 65536):
        s = slice(at, at + 65536)
        near[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]]) >= cosine
    i, j = i[near], j[near]
    nodes = np.array([*left["node"], *([] if right is None else right["node"])], object)
    sizes = np.concatenate([left["size"], [] if right is None else right["size"]]).astype(int)
    if right is not None:
        j = j + len(a)
    count = np.bincount(i, sizes[j], len(nodes)) + np.bincount(j, sizes[i], len(nodes))
    order = np.argsort(nodes)
    rank = np.empty(len(nodes), int)
    rank[order] = np.arange(len(nodes))
    root = rank.copy()
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[order[new]]
        if (new == root).all():
            break
        root = new
    some = np.flatnonzero(count)
    return pd.DataFrame({"node": nodes[some], "links": count[some].astype("int64"), "root": nodes[order[root[some]]]})


def near_vectors(vectors: DataFrame, cosine: float = 0.98, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: vectors of one label with a cosine of at least ``cosine`` are linked.

    Equal vectors of a label are one class from the start. Each class lies in a cell of slabs of two projections; cells are
    cut into blocks of bounded size, and blocks of neighbouring cells meet in tasks that return, not pairs, but counts and
    one edge per vector. A vector that is null, empty or zero or holds null or non-finite components, or whose label is null, links
    with nothing, as do vectors of different length; rows with a null key link with nothing and have null component_id
    and kept. Rows that repeat a key count as vectors of their own.
    """
    rows = kept(classes_of(vectors, key, embedding, label, cosine))
    classes = kept(rows.groupBy("node").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("size"), *[
        F.first(c).alias(c) for c in ("label", "dim", "vector", "x", "y")]))
    cells = kept(classes.groupBy("label", "dim", "x", "y").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")))
    part = F.expr("pmod(xxhash64(node), parts)").cast("int")
    placed = kept(classes.join(cells, ["label", "dim", "x", "y"]).withColumn("part", part))
    blocks = cells.select("label", "dim", "x", "y", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"))
    ahead = blocks.select(*blocks.columns, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in NEIGHBOURS])).alias("o")).select(
        "label", "dim", "x", "y", "part", (F.col("x") + F.col("o.i")).alias("x2"), (F.col("y") + F.col("o.j")).alias("y2"))
    other = blocks.select("label", "dim", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("part").alias("part2"))
    pairs = kept(ahead.join(other, ["label", "dim", "x2", "y2"]).where("x <> x2 or y <> y2 or part <= part2").withColumn(
        "pair", F.struct("label", "dim", "x", "y", "part", "x2", "y2", "part2")).withColumn("alone", F.expr("x = x2 and y = y2 and part = part2")))
    place = ["label", "dim", "x", "y", "part"]
    held = ["alone", "node", "size", "dim", "vector"]
    one = placed.join(pairs.select("pair", "alone", *place), place).select("pair", F.lit(0).alias("side"), *held)
    two = placed.join(pairs.where("not alone").select("pair", "alone", "label", "dim", F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("part2").alias("part")),
                      place).select("pair", F.lit(1).alias("side"), *held)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["side"] == 0], group[group["side"] == 1]
        if group["alone"].iloc[0]:
            return compare(left, None, cosine)
        # A hashed part of a cell can be empty.
        return compare(left, right, cosine) if len(left) and len(right) else pd.DataFrame({"node": [], "links": [], "root": []})

    found = kept(one.union(two).groupBy("pair").applyInPandas(meet, "node binary, links long, root binary"))
    links = kept(found.groupBy("node").agg(F.sum("links").alias("links")))
    roots = kept(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    least = kept(roots.join(classes, "node").groupBy("root").agg(F.min("vec_id").alias("least")))
    answer = kept(classes.select("node", F.col("vec_id").alias("first"), "size").join(links, "node", "left").join(
        roots.join(least, "root").select("node", "least"), "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id")))
    linked = rows.select("vec_id", "node").join(answer, "node").select("vec_id", "n_links", "component_id")
    loose = _every(vectors, key, embedding, label).where(~_usable()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(loose).withColumn("kept", F.col("vec_id") == F.col("component_id"))
