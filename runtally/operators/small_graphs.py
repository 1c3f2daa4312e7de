"""Many small graphs at once: rounds over the arrays of a batch.

Rows of a graph lie together in one task, as ``graph._parts`` gives them: nodes, edges ``node`` behind ``pred``, and starts. A batch holds
whole graphs, some tens of thousands of rows; its nodes are numbered through, and a round takes one step in all of its graphs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

#: Kinds of rows.
NODE, EDGE, START = 0, 1, 2
#: Rows of a batch, as far as whole graphs allow.
ROWS = 50_000
#: A weight that is null, and a distance that is not known.
NONE, FAR = -(1 << 62), 1 << 62


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Equal numbers for equal values, nulls included, and the values numbered."""
    coded = pc.dictionary_encode(column, null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _numbers(g: pa.StructArray) -> np.ndarray:
    """Rows as the number of their graph, from 0."""
    new = np.zeros(len(g), bool)
    for key in g.flatten():
        code = _codes(key)[0]
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole graphs, many at a time, with the number of each row's graph; what may go on in the next batch waits for it."""
    rest: list[pa.Table] = []
    for batch in batches:
        rest.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in rest) < ROWS:
            continue
        table = pa.concat_tables(rest).combine_chunks()
        number = _numbers(table.column("g").chunk(0))
        end = int(np.searchsorted(number, number[-1]))
        if end:
            yield table.slice(0, end).combine_chunks(), number[:end]
        rest = [table.slice(end)]
    if sum(t.num_rows for t in rest):
        table = pa.concat_tables(rest).combine_chunks()
        yield table, _numbers(table.column("g").chunk(0))


@dataclass
class Graphs:
    """The nodes of some graphs, numbered through, and edges ``s`` behind ``p`` between them."""

    table: pa.Table
    #: The row that stands for a node, its graph, value, weight (``NONE``: null) and whether it is a start.
    row: np.ndarray
    graph: np.ndarray
    code: np.ndarray
    weight: np.ndarray
    start: np.ndarray
    s: np.ndarray
    p: np.ndarray
    values: pa.Array

    @classmethod
    def of(cls, table: pa.Table, number: np.ndarray) -> "Graphs":
        column = lambda name: table.column(name).chunk(0)
        kind, n = column("kind").to_numpy(zero_copy_only=False), len(number)
        code, values = _codes(pa.concat_arrays([column("node"), column("pred")]))
        at, before = number * len(values) + code[:n], number * len(values) + code[n:]
        rows = np.flatnonzero(kind != EDGE)
        ids, first, place = np.unique(at[rows], return_index=True, return_inverse=True)
        weight = np.full(len(ids), NONE)
        np.maximum.at(weight, place, pc.fill_null(column("weight"), NONE).to_numpy(zero_copy_only=False)[rows])
        start = np.zeros(len(ids), bool)
        start[place[kind[rows] == START]] = True
        ends = []
        for end in (at, before):
            own = end[kind == EDGE]
            there = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
            ends.append(np.where(ids[there] == own, there, -1) if len(ids) else np.full(len(own), -1))
        both = (ends[0] >= 0) & (ends[1] >= 0)
        row = rows[first]
        return cls(table, row, number[row], code[row], weight, start, ends[0][both], ends[1][both], values)

    def out(self, nodes: np.ndarray, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
        """A row for each of ``nodes``: its graph, the node and ``columns``."""
        return self.of_rows(self.row[nodes], node=self.table.column("node").chunk(0).take(pa.array(self.row[nodes])), **columns)

    def of_rows(self, rows: np.ndarray, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
        g = self.table.column("g").chunk(0).take(pa.array(rows))
        return pa.RecordBatch.from_arrays([g, *[c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]], ["g", *columns])

    def nullable(self, values: np.ndarray, known: np.ndarray) -> pa.Array:
        return pa.array(values, pa.int64(), mask=~known)

    def weights(self, nodes: np.ndarray) -> pa.Array:
        return self.nullable(self.weight[nodes], self.weight[nodes] != NONE)


def _peeled(n: int, s: np.ndarray, p: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest way to every node, and whether it comes down to a start: it is not on or behind a cycle."""
    level, ahead = np.zeros(n, np.int64), np.bincount(s, minlength=n)
    fresh = ahead == 0
    while len(s):
        go = fresh[p]
        if not go.any():
            break
        a, b = s[go], p[go]
        np.maximum.at(level, a, level[b] + weight[b])
        np.subtract.at(ahead, a, 1)
        fresh = np.zeros(n, bool)
        fresh[a] = ahead[a] == 0
        s, p = s[~go], p[~go]
    return level, ahead == 0


def _levels(x: Graphs) -> pa.RecordBatch:
    level, done = _peeled(len(x.row), x.s, x.p, np.where(x.weight == NONE, 0, x.weight))
    every = np.arange(len(x.row))
    return x.out(every, weight=x.weights(every), level=x.nullable(level, done))


def _counts(x: Graphs) -> pa.RecordBatch:
    done = _peeled(len(x.row), x.s, x.p, np.zeros(len(x.row), np.int64))[1]
    graphs, first, place = np.unique(x.graph, return_index=True, return_inverse=True)
    return x.of_rows(x.row[first], nodes=np.bincount(place, minlength=len(graphs)), held=np.bincount(place[~done], minlength=len(graphs)))


def _stuck(x: Graphs) -> tuple[np.ndarray, np.ndarray]:
    """Whether a node is on or behind a cycle, and whether a cycle is ahead of it as well."""
    none = np.zeros(len(x.row), np.int64)
    held = ~_peeled(len(x.row), x.s, x.p, none)[1]
    inner = held[x.s] & held[x.p]
    return held, held & ~_peeled(len(x.row), x.p[inner], x.s[inner], none)[1]


def _held(x: Graphs) -> pa.RecordBatch:
    held, ahead = _stuck(x)
    nodes = np.flatnonzero(held)
    return x.out(nodes, ahead=ahead[nodes])


def _cycles(x: Graphs) -> pa.RecordBatch:
    """The chosen cycle of every graph with one: see ``graph.cycles``."""
    core = _stuck(x)[1]
    rank = np.empty(len(x.values), np.int64)
    rank[pc.sort_indices(x.values, null_placement="at_end").to_numpy()] = np.arange(len(x.values))
    rank = rank[x.code]
    inner = core[x.s] & core[x.p]
    s, p = x.s[inner], x.p[inner]
    order = np.lexsort((rank[p], s))
    nodes, first = np.unique(s[order], return_index=True)
    to = np.arange(len(x.row))
    to[nodes] = p[order][first]
    # Doubled until all nodes of a graph are passed.
    far = to
    for _ in range(int(np.bincount(x.graph[nodes]).max()).bit_length() if len(nodes) else 0):
        far = far[far]
    on = np.unique(far[nodes])
    # Null, which is no one's least predecessor, is the least node of a cycle.
    blank = x.values.is_null().to_numpy(zero_copy_only=False)[x.code]
    least = np.where(blank[on], -1, rank[on])
    on = on[np.lexsort((least, x.graph[on]))]
    start = on[np.unique(x.graph[on], return_index=True)[1]]
    way, steps, at, begin = [start], [np.zeros(len(start), np.int64)], to[start], start
    while len(at):
        more = at != begin
        at, begin = at[more], begin[more]
        way.append(at)
        steps.append(np.full(len(at), len(steps)))
        at = to[at]
    nodes, back = np.concatenate(way), np.concatenate(steps)
    size = np.bincount(x.graph[nodes], minlength=1)[x.graph[nodes]] if len(nodes) else back
    return x.out(nodes, step=np.where(back == 0, 0, size - back).astype(np.int64))


def _closure(x: Graphs) -> pa.RecordBatch:
    """The nearest start of the nodes reached: see ``graph.skip_closure``."""
    dist = np.where(x.start, 0, FAR)
    use = ~x.start[x.s] & (x.weight[x.s] != NONE)
    s, p = x.s[use], x.p[use]
    fresh = x.start
    while fresh.any():
        go = fresh[p]
        near = dist.copy()
        np.minimum.at(near, s[go], dist[p[go]] + x.weight[s[go]])
        fresh, dist = near < dist, near
    nodes = np.flatnonzero(dist < FAR)
    return x.out(nodes, weight=x.weights(nodes), dist=dist[nodes])


def _run(rows: DataFrame, each: Callable[[Graphs], pa.RecordBatch], columns: list[T.StructField]) -> DataFrame:
    """``each`` of the graphs of a batch; every graph is in one task."""
    keys = [f"g.`{c}`" for c in rows.schema["g"].dataType.names]
    placed = rows.select("g", "node", F.col("pred").cast(rows.schema["node"].dataType).alias("pred"), "weight", "kind")

    def run(batches):
        for table, number in _whole(batches):
            yield each(Graphs.of(table, number))

    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, T.StructType([rows.schema["g"], *columns]))


def _long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def levels(rows: DataFrame) -> DataFrame:
    """(g, node, weight, level) of every node; the level of those on or behind a cycle is null."""
    return _run(rows, _levels, [rows.schema["node"], _long("weight"), _long("level")])


def counts(rows: DataFrame) -> DataFrame:
    """(g, nodes, held) of every graph: its nodes, and how many of them are on or behind a cycle."""
    return _run(rows, _counts, [_long("nodes"), _long("held")])


def held(rows: DataFrame) -> DataFrame:
    """(g, node, ahead) of the nodes on or behind a cycle, and whether a cycle is still ahead of them."""
    return _run(rows, _held, [rows.schema["node"], T.StructField("ahead", T.BooleanType())])


def cycles(rows: DataFrame) -> DataFrame:
    """(g, node, step) of the chosen cycle of every graph with one."""
    return _run(rows, _cycles, [rows.schema["node"], _long("step")])


def closure(rows: DataFrame) -> DataFrame:
    """(g, node, weight, dist) of the nodes that a start reaches; ``dist`` is 0 for a start."""
    return _run(rows, _closure, [rows.schema["node"], _long("weight"), _long("dist")])
