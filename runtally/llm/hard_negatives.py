"""Hard negatives by a multiway tree of split points whose stored distance ranges rule out subtrees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from runtally.llm.rows import saved

#: The tree is fitted on this many vectors at most, of the least hashes; every vector is placed in it.
SAMPLE = 4096
#: Split points of a node, and sampled vectors below which a node is not split.
WAYS, LEAST = 16, 64
#: Vectors of a part of a leaf; larger leaves are searched in several parts.
PART = 16_384
#: Leaves a query looks at first, for a bound on the scores it needs.
PROBES = 3
#: Rounding of distances, as a share of them.
SLACK = 1e-9

_LOW, _HIGH = -(1 << 62), 1 << 62


class Tree:
    """Split points and, once ``bounded``, the ranges of their distances to the vectors of every sibling's subtree.

    Node 0 is the root. A node has split points; the vectors nearest to one of them form its subtree, which is a node or a leaf.
    """

    def __init__(self, sample: np.ndarray) -> None:
        self.points: list[np.ndarray] = []
        self.children: list[list[tuple[bool, int]]] = []  # (is a leaf, number)
        self.leaves = 0
        self.root = self._grow(sample.astype(float))

    def _grow(self, rows: np.ndarray) -> tuple[bool, int]:
        picked = spread_out(rows) if len(rows) >= LEAST else []
        if len(picked) < 2:
            self.leaves += 1
            return True, self.leaves - 1
        node = len(self.points)
        self.points.append(rows[picked])
        self.children.append([])
        nearest = distances(rows, rows[picked]).argmin(1)
        self.children[node] = [self._grow(rows[nearest == k]) for k in range(len(picked))]
        return False, node

    def walk(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Every node that rows pass, those rows, and their distances to its split points; a leaf comes as (~leaf, rows, none)."""
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            (leaf, k), at = todo.pop()
            if not len(at):
                continue
            if leaf:
                yield ~k, at, np.zeros((len(at), 0))
                continue
            far = distances(rows[at], self.points[k])
            yield k, at, far
            nearest = far.argmin(1)
            todo += [(child, at[nearest == i]) for i, child in enumerate(self.children[k])]

    def place(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        for k, at, _ in self.walk(rows):
            if k < 0:
                out[at] = ~k
        return out

    def under(self, child: tuple[bool, int]) -> list[int]:
        leaf, k = child
        return [k] if leaf else [x for c in self.children[k] for x in self.under(c)]

    def bounded(self, sizes: np.ndarray, norms: np.ndarray, ranges: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> Tree:
        """Give every child of every node the ranges of its vectors: squared lengths, and distances to all split points of the node.

        sizes and norms (least, greatest) by leaf; ranges by (node, leaf).
        """
        self.sizes, self.norms = sizes, norms
        self.range: list[list[tuple[np.ndarray, np.ndarray] | None]] = []
        for k, children in enumerate(self.children):
            self.range.append([])
            for child in children:
                own = [x for x in self.under(child) if sizes[x]]
                self.range[k].append((np.min([ranges[k, x][0] for x in own], 0), np.max([ranges[k, x][1] for x in own], 0)) if own else None)
        return self

    def _lengths(self, child: tuple[bool, int]) -> tuple[float, float]:
        own = [x for x in self.under(child) if self.sizes[x]]
        return (self.norms[own, 0].min(), self.norms[own, 1].max()) if own else (0.0, 0.0)

    def surviving(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Queries x leaves: whether a leaf may hold a vector whose inner product with the query is within [low, high].

        With the lengths in a subtree the window of products is an annulus of distances from the query. A subtree is out if, for one
        of the split points, no distance in the stored range fits the triangle of query, split point and annulus.
        """
        out = np.zeros((len(queries), self.leaves), bool)
        length = (queries * queries).sum(1)
        todo = [(self.root, np.arange(len(queries)))]
        lengths = {}
        while todo:
            child, at = todo.pop()
            if not len(at):
                continue
            if child not in lengths:
                lengths[child] = self._lengths(child)
            leaf, k = child
            if leaf:
                if self.sizes[k]:
                    inner, outer = annulus(length[at], lengths[child], low[at], high[at])
                    out[at[inner <= outer], k] = True
                continue
            far = distances(queries[at], self.points[k])
            for i, below in enumerate(self.children[k]):
                if self.range[k][i] is None:
                    continue
                if below not in lengths:
                    lengths[below] = self._lengths(below)
                inner, outer = annulus(length[at], lengths[below], low[at], high[at])
                least, most = self.range[k][i]
                nearest = np.maximum(np.maximum(far - outer[:, None], inner[:, None] - far), 0)
                room = SLACK * (1 + far + most)
                fits = (nearest <= most + room) & (far + outer[:, None] >= least - room)
                todo.append((below, at[fits.all(1) & (inner <= outer)]))
        return out

    def nearest(self, queries: np.ndarray, count: int) -> np.ndarray:
        """Queries x ``count`` non-empty leaves: the query's own first, then those of the split points nearest to it."""
        far = np.full((len(queries), self.leaves), np.inf)
        todo = [(self.root, np.zeros(len(queries)))]
        while todo:
            (leaf, k), best = todo.pop()
            if leaf:
                far[:, k] = best if self.sizes[k] else np.inf
                continue
            d = distances(queries, self.points[k])
            todo += [(child, np.maximum(best, d[:, i] - d.min(1))) for i, child in enumerate(self.children[k])]
        return np.argsort(far, 1, kind="stable")[:, :min(count, int((self.sizes > 0).sum()))]


def annulus(length: np.ndarray, norms: tuple[float, float], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances from queries of these squared lengths at which a vector of squared length in ``norms`` has a product in [low, high]."""
    room = SLACK * (1 + length + norms[1])
    inner = np.sqrt(np.maximum(length + norms[0] - 2.0 * high - room, 0))
    reach = length + norms[1] - 2.0 * low + room
    return inner, np.where(reach < 0, -1.0, np.sqrt(np.maximum(reach, 0)))


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Rows x points, from the differences: whole numbers of usual size give exact squares."""
    out = np.empty((len(rows), len(points)))
    for k, p in enumerate(points):
        d = rows - p
        out[:, k] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def spread_out(rows: np.ndarray) -> list[int]:
    """Up to ``WAYS`` places of rows far from each other: the first row, then always the one farthest from those taken."""
    picked, far = [0], distances(rows, rows[:1])[:, 0]
    while len(picked) < WAYS and far.max(initial=0) > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, distances(rows, rows[picked[-1:]])[:, 0])
    return picked


def matrix(cells: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), "<i8").reshape(len(cells), dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: by floats where every partial sum is exact in them."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2.0**53 else a @ b.T


def _usable(vectors: DataFrame, key: str, embedding: str, label: str) -> DataFrame:
    """vec_id, label, dim, v (whole numbers, packed) of the rows that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[label].cast("string").alias("label"), vectors[embedding].cast("array<double>").alias("embedding"))
    rows = rows.where(F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite, F.lit(False)))

    def run(batches):
        for batch in batches:
            cells = [np.array(v, "<i8").tobytes() for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([len(c) // 8 for c in cells], pa.int32()), pa.array(cells, pa.binary())], ["vec_id", "label", "dim", "v"])

    return rows.select("vec_id", "label", F.transform(x, lambda v: F.floor(v * 256)).alias("v")).mapInArrow(run, "vec_id long, label string, dim int, v binary")


def fit(rows: DataFrame) -> dict[int, Tree]:
    """A tree for every length of vectors in a sample of ``SAMPLE`` rows, those of the least hashes of their keys."""
    sample = rows.select("dim", "v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id", "v").limit(SAMPLE).collect()
    dims = sorted({r["dim"] for r in sample})
    return {d: Tree(matrix([bytes(r["v"]) for r in sample if r["dim"] == d], d)) for d in dims}


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Lengths of vectors in a batch, the places that have them, and their vectors."""
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    cells = batch.column("v").to_pylist()
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield int(d), at, matrix([cells[i] for i in at], int(d))


def placed(rows: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """The rows with their leaf; lengths that the sample does not hold have one leaf."""
    def run(batches):
        for batch in batches:
            leaf = np.zeros(batch.num_rows, np.int64)
            for d, at, v in _by_dim(batch):
                if d in trees:
                    leaf[at] = trees[d].place(v.astype(float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    return rows.mapInArrow(run, "vec_id long, label string, dim int, v binary, leaf long")


def measure(rows: DataFrame, trees: dict[int, Tree]) -> dict[int, Tree]:
    """The trees with sizes, lengths and distance ranges of all rows; a length without a tree gets one of a single leaf.

    A task keeps one range for each split point and leaf, so what reaches the driver is bounded by the trees.
    """
    def run(batches):
        seen: dict[tuple[int, int, int, int], list[float]] = {}

        def note(key: tuple[int, int, int, int], n: int, least: float, most: float) -> None:
            old = seen.get(key)
            seen[key] = [n, least, most] if old is None else [old[0] + n, min(old[1], least), max(old[2], most)]

        for batch in batches:
            for d, at, v in _by_dim(batch):
                x = v.astype(float)
                norm = (x * x).sum(1)
                if d not in trees:
                    note((d, 0, -1, 0), len(x), norm.min(), norm.max())
                    continue
                leaf = np.empty(len(x), np.int64)
                passed = []
                for k, own, far in trees[d].walk(x):
                    if k < 0:
                        leaf[own] = ~k
                        note((d, ~k, -1, 0), len(own), norm[own].min(), norm[own].max())
                    else:
                        passed.append((k, own, far))
                for k, own, far in passed:
                    for one in np.unique(leaf[own]):
                        mine = far[leaf[own] == one]
                        for i, (a, b) in enumerate(zip(mine.min(0), mine.max(0))):
                            note((d, int(one), k, i), 0, a, b)
        if seen:
            keys, values = np.array(list(seen), np.int64), np.array(list(seen.values()))
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, i]) for i in range(4)] + [pa.array(values[:, 0].astype(np.int64)), pa.array(values[:, 1]), pa.array(values[:, 2])],
                                             ["dim", "leaf", "node", "point", "n", "least", "most"])

    found = rows.mapInArrow(run, "dim long, leaf long, node long, point long, n long, least double, most double") \
        .groupBy("dim", "leaf", "node", "point").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).collect()
    out = {}
    for d in sorted({r["dim"] for r in found}):
        tree = trees.get(d) or Tree(np.zeros((0, d)))
        sizes, norms, ranges = np.zeros(tree.leaves, np.int64), np.zeros((tree.leaves, 2)), {}
        for r in (r for r in found if r["dim"] == d):
            if r["node"] < 0:
                sizes[r["leaf"]], norms[r["leaf"]] = r["n"], (r["least"], r["most"])
            else:
                ways = len(tree.points[r["node"]])
                low, high = ranges.setdefault((r["node"], r["leaf"]), (np.zeros(ways), np.zeros(ways)))
                low[r["point"]], high[r["point"]] = r["least"], r["most"]
        out[d] = tree.bounded(sizes, norms, ranges)
    return out


def parts_of(tree: Tree, leaf: int) -> int:
    return max(1, -(-int(tree.sizes[leaf]) // PART))


def _parted(rows: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """The rows with the part of their leaf, so that no group of the search is larger than about ``PART`` rows."""
    def run(batches):
        for batch in batches:
            key = zip(*(batch.column(c).to_pylist() for c in ("dim", "leaf", "hash")))
            part = [h % parts_of(trees[d], k) for d, k, h in key]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(part, pa.int64())], [*batch.schema.names[:-1], "part"])

    return rows.withColumn("hash", F.xxhash64("vec_id", "v")).mapInArrow(run, "vec_id long, label string, dim int, v binary, leaf long, part long")


QUERY = "anchor long, label string, dim int, v binary, tag array<long>, low array<long>, high array<long>"


def _routed(queries: DataFrame, trees: dict[int, Tree], probe: bool) -> DataFrame:
    """Queries once for each part of each leaf they must look at, or of the leaves nearest to them."""
    def run(batches):
        for batch in batches:
            rows: list[int] = []
            where: list[tuple[int, int]] = []
            low, high = batch.column("low").to_pylist(), batch.column("high").to_pylist()
            for d, at, v in _by_dim(batch):
                x, tree = v.astype(float), trees[d]
                if probe:
                    hits = zip(np.repeat(np.arange(len(at)), (near := tree.nearest(x, PROBES)).shape[1]).tolist(), near.ravel().tolist())
                else:
                    n = np.array([len(low[i]) for i in at])
                    own = np.repeat(np.arange(len(at)), n)
                    alive = tree.surviving(x[own], np.array([w for i in at for w in low[i]], float), np.array([w for i in at for w in high[i]], float))
                    some = np.zeros((len(at), tree.leaves), bool)
                    np.logical_or.at(some, own, alive)
                    hits = zip(*(h.tolist() for h in np.nonzero(some)))
                for q, leaf in hits:
                    for part in range(parts_of(tree, leaf)):
                        rows.append(int(at[q]))
                        where.append((leaf, part))
            took = batch.take(pa.array(rows, pa.int64()))
            for s in range(0, took.num_rows, 512):
                yield pa.RecordBatch.from_arrays([*took.slice(s, 512).columns, *[pa.array([w[i] for w in where[s:s + 512]], pa.int64()) for i in (0, 1)]], [*took.schema.names, "leaf", "part"])

    return queries.mapInArrow(run, QUERY + ", leaf long, part long")


def best(queries: DataFrame, parted: DataFrame, trees: dict[int, Tree], k: int, same: bool, probe: bool) -> DataFrame:
    """anchor, tag, rank, vec_id, score: per window of a query the first k rows by score, then key, of its label or of others.

    A leaf's part is searched exactly: all its products with all queries that reach it. It returns k rows a window at most.
    """
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[np.ndarray] = []
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            ids, labels = left.column("vec_id").to_numpy(), np.array(left.column("label").to_pylist(), object)
            rows = matrix(left.column("v").to_pylist(), dim)
            for at in range(0, right.num_rows, 256):
                some = right.slice(at, 256)
                score = products(matrix(some.column("v").to_pylist(), dim), rows)
                for q, (anchor, label, tag, low, high) in enumerate(zip(*(some.column(c).to_pylist() for c in ("anchor", "label", "tag", "low", "high")))):
                    usable = ((labels == label) == same) & (ids != anchor)
                    for t, a, b in zip(tag, low, high):
                        hit = np.flatnonzero(usable & (score[q] >= a) & (score[q] <= b))
                        if len(hit) > 4 * k:  # rows equal to the k-th stay, as the smaller key decides
                            own = score[q][hit]
                            hit = hit[own >= np.partition(own, len(own) - k)[len(own) - k]]
                        hit = hit[np.lexsort((ids[hit], -score[q][hit]))[:k]]
                        out.append(np.stack([np.full(len(hit), anchor), np.full(len(hit), t), ids[hit], score[q][hit]]))
        found = np.concatenate(out, 1) if out else np.zeros((4, 0), np.int64)
        return pa.table(dict(zip(("anchor", "tag", "vec_id", "score"), found.astype(np.int64))))

    by = ["dim", "leaf", "part"]
    found = parted.groupBy(*by).cogroup(_routed(queries, trees, probe).groupBy(*by)).applyInArrow(run, "anchor long, tag long, vec_id long, score long")
    order = Window.partitionBy("anchor", "tag").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, parted: DataFrame, trees: dict[int, Tree], k: int, same: bool) -> DataFrame:
    """``best`` over every leaf that can matter: the nearest leaves first raise each window's lower end to the k-th score found there."""
    probed = best(queries, parted, trees, k, same, True).groupBy("anchor", "tag").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    raised = saved(probed.where(F.col("n") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("tag", "kth"))).alias("kth")))
    own = F.zip_with("tag", "low", lambda t, a: F.greatest(a, F.coalesce(F.try_element_at("kth", t), a)))
    closer = queries.join(raised, "anchor", "left").withColumn("kth", F.coalesce("kth", F.create_map().cast("map<bigint,bigint>"))).withColumn("low", own)
    return best(closer.select(*[c.split()[0] for c in QUERY.split(", ")]), parted, trees, k, same, False)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, key: str = "vec_id",
         embedding: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for the rows that ``anchors`` (over vec_id) selects, the first
    ``positives`` other rows of the same label, and for each the first ``negatives`` rows of other labels whose score lies between ``low``
    and ``high`` per cent of the positive's.

    Components become floor(256 * x); a score is the inner product of the whole numbers, which must fit a long; higher scores come
    first, ties by smaller key. Rows with a null key, label, vector or component, or one that is not finite, take no part. Vectors of
    different lengths never meet. A row with the anchor's key is no other row; rows that repeat a key stand for themselves,
    anchors that do are one query if they are equal in all, and are reported from the greatest vector if not. An anchor without positives,
    and a positive without negatives, have no rows. Other columns are not read; an empty table gives an empty result.
    """
    rows = saved(_usable(vectors, key, embedding, label))
    trees = fit(rows)
    placed_rows = saved(placed(rows, trees))
    trees = measure(placed_rows, trees)
    parted = _parted(placed_rows, trees)
    one = F.max(F.struct("v", "label", "dim")).alias("r")
    chosen = saved(placed_rows.where(anchors).groupBy(F.col("vec_id").alias("anchor")).agg(one).select("anchor", "r.label", "r.dim", "r.v"))
    whole = [F.array(F.lit(x).cast("long")).alias(c) for c, x in (("tag", 0), ("low", _LOW), ("high", _HIGH))]
    near = saved(search(chosen.select("anchor", "label", "dim", "v", *whole), parted, trees, positives, True).select(
        "anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").cast("long").alias("tag")))
    # low * p <= 100 * s <= high * p, in whole scores; a negative p leaves none
    p = F.col("positive_score")
    lower, upper = _ceil_div(p * low), _floor_div(p * high)
    windows = near.where(lower <= upper).groupBy("anchor").agg(F.collect_list(F.struct("tag", lower.alias("low"), upper.alias("high"))).alias("w"))
    queries = saved(chosen.join(windows, "anchor").select("anchor", "label", "dim", "v", *[F.col(f"w.{c}").alias(c) for c in ("tag", "low", "high")]))
    found = search(queries, parted, trees, negatives, False)
    return found.join(near, ["anchor", "tag"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _floor_div(x: Column, by: int = 100) -> Column:
    """x / by rounded down, in whole numbers."""
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def _ceil_div(x: Column, by: int = 100) -> Column:
    return -_floor_div(-x, by)
