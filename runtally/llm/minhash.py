"""Near-duplicate documents by HyperMinHash: compressed registers, banding, corrected estimates, and checks on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from runtally.llm.components import components
from runtally.llm.rows import kept, mapped, steps, texts

WORDS = 5
#: Registers of a sketch (a power of two), mantissa bits of each, and registers of a band. At a similarity of 0.85 one of the 25
#: bands agrees with probability 1 - 4e-7, at 0.8 with 1 - 5e-5.
REGISTERS, MANTISSA, BAND = 128, 10, 5
#: Standard errors below the threshold at which an estimate still asks for a check.
SLACK = 5.0
#: Sets and shingles of a block that one task holds against another block, and shingles counted at a time.
BLOCK, HASHES, COLUMNS = 128, 500_000, 8192
#: Parts of a group in joins with a row for the group.
PARTS = 32

_EMPTY = 0xFFFF
_MASK = (1 << 64) - 1
_WEIGHTS = np.array([xxhash.xxh3_64_intdigest(b"word", seed=i) | 1 for i in range(WORDS)], np.uint64)
BANDS = REGISTERS // BAND
_BAND_SEEDS = np.array([xxhash.xxh3_64_intdigest(b"band", seed=i) for i in range(BANDS)], np.uint64)
_ORDER = np.random.default_rng(7).random((REGISTERS, REGISTERS))
_MEMO = 300_000
_memo: dict[bytes, bytes] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of the word shingles of each whole text.

    A-Z are lower-cased; words are runs without ASCII white space. With fewer words than a shingle has, all of them are one
    shingle; without words the set is empty.
    """
    words = [t.encode().lower().split() for t in texts]
    new = set().union(*words).difference(_memo)
    if len(_memo) + len(new) > _MEMO:
        _memo.clear()
        new = set().union(*words)
    _memo.update((w, xxhash.xxh3_64_digest(w)) for w in new)
    out = []
    for own in words:
        w = np.frombuffer(b"".join(map(_memo.__getitem__, own)), "<u8")
        n = max(1, len(w) - WORDS + 1) if len(w) else 0
        h = np.zeros(n, np.uint64)
        for j in range(min(WORDS, len(w))):
            h += w[j:j + n] * _WEIGHTS[j]
        out.append(np.unique(_mix(h + np.uint64(min(WORDS, len(w))))))
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a sorted set: for each register the leading zeros and the mantissa of its least hash."""
    out = np.full(REGISTERS, _EMPTY, "<u2")
    bits = REGISTERS.bit_length() - 1
    if len(hashes):
        at = (hashes >> np.uint64(64 - bits)).astype(int)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        rest = hashes[first] << np.uint64(bits)
        zeros = np.minimum(64 - np.frexp(rest.astype(float))[1], 62)
        out[at[first]] = zeros << MANTISSA | ((rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)).astype(int)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A key for each band of a sketch.

    An empty register takes the value of the register that comes first in an order of its own, so that a band of a short text
    stands for as many draws from its shingles as that of a long one, and one shared line does not make texts share a band.
    """
    empty, full = np.flatnonzero(regs == _EMPTY), np.flatnonzero(regs != _EMPTY)
    dense = regs.astype(np.uint64)
    if len(empty):
        dense[empty] = dense[full[_ORDER[np.ix_(empty, full)].argmin(1)]]
    rows = dense[:BANDS * BAND].reshape(BANDS, BAND)
    return _mix((rows * _WEIGHTS[:BAND]).sum(1, dtype=np.uint64) + _BAND_SEEDS).view("<i8")


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that a register of two unrelated sets of n and m shingles agrees: the sum over its values."""
    n, m = n / REGISTERS, m / REGISTERS
    both = n + m
    total = np.zeros(len(n))
    for zeros in range(64 - REGISTERS.bit_length()):
        high = 2.0**-zeros
        total += high / 2 * (np.exp(-both * high / 2) - np.exp(-both * high))
    return np.clip(total * n * m / both * 2.0**-MANTISSA, 0, 1)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corrected Jaccard estimates of pairs of sketches (rows), and the number of registers each rests on."""
    used = ((a != _EMPTY) | (b != _EMPTY)).sum(1)
    same = ((a == b) & (a != _EMPTY)).sum(1)
    chance = collisions(n, m)
    return np.clip((same / np.maximum(used, 1) - chance) / np.maximum(1 - chance, 1e-9), 0, 1), used


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, node (128-bit digest of the shingle set), regs, bands of every row; the last three are null for empty sets."""
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts(part))
        regs = [registers(s) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([
            part.column("key"), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            pa.array([None if r is None else r.tobytes() for r in regs], pa.binary()),
            pa.array([None if r is None else band_keys(r) for r in regs], pa.list_(pa.int64()))], ["key", "n_shingles", "node", "regs", "bands"])

    return mapped(docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text")), run, "key long, n_shingles long, node binary, regs binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """node, hashes of the wanted (key, node), computed again from the texts; a key with several texts gives the node's own."""
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts(part))
        found = [(n, s.view("<i8")) for n, s in zip(part.column("node").to_pylist(), sets) if xxhash.xxh3_128_digest(s.tobytes()) == n]
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.binary()), pa.array([s for _, s in found], pa.list_(pa.int64()))], ["node", "hashes"])

    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text")).join(wanted, "key").select("node", "text")
    return mapped(rows, run, "node binary, hashes array<long>").dropDuplicates(["node"])


def _promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimate is not far below the threshold."""
    def run(batches):
        for part in batches:
            a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("regs_a", "regs_b"))
            n, m = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b"))
            found, used = estimate(a, b, n, m)
            least = percent / 100
            keep = (found >= least - SLACK * np.sqrt(least * (1 - least) / np.maximum(used, 1))) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            yield part.select(["a", "b"]).filter(pa.array(keep))

    side = lambda x: classes.select(F.col("node").alias(x), F.col("regs").alias(f"regs_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "regs_a", "regs_b", "n_a", "n_b").mapInArrow(run, "a binary, b binary")


def _links_of(u_regs: np.ndarray, v_regs: np.ndarray, u_sets: list[np.ndarray], v_sets: list[np.ndarray], open_: np.ndarray, percent: int) -> np.ndarray:
    """Which of the open pairs (rows u, columns v) are links: estimates first, then whole intersections of those left."""
    n, m = (np.array([len(s) for s in sets], float) for sets in (u_sets, v_sets))
    least = percent / 100
    open_ = open_ & (100 * np.minimum.outer(n, m) >= percent * np.maximum.outer(n, m))
    for i in np.flatnonzero(open_.any(1)):
        at = np.flatnonzero(open_[i])
        found, used = estimate(u_regs[i][None, :], v_regs[at], np.full(len(at), n[i]), m[at])
        open_[i, at] = found >= least - SLACK * np.sqrt(least * (1 - least) / np.maximum(used, 1))
    us, vs = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
    common = np.zeros(open_.shape)
    if len(us):
        x, y = (np.concatenate([sets[i] for i in rows]) for sets, rows in ((u_sets, us), (v_sets, vs)))
        x_row, y_row = (np.repeat(rows, [len(sets[i]) for i in rows]) for sets, rows in ((u_sets, us), (v_sets, vs)))
        both = np.intersect1d(x, y)
        sides = []
        for h, row in ((x, x_row), (y, y_row)):
            at = np.searchsorted(both, h)
            hit = both[np.minimum(at, len(both) - 1)] == h if len(both) else np.zeros(len(h), bool)
            order = np.argsort(at[hit], kind="stable")
            sides.append((at[hit][order], row[hit][order]))
        for low in range(0, len(both), COLUMNS):
            dense = []
            for (at, row), size in zip(sides, open_.shape):
                a, b = np.searchsorted(at, (low, low + COLUMNS))
                part = np.zeros((size, COLUMNS), np.float32)
                part[row[a:b], at[a:b] - low] = 1
                dense.append(part)
            common += dense[0] @ dense[1].T
    return open_ & (100 * common >= percent * (n[:, None] + m[None, :] - common))


def _spanning(ends: list[tuple[bytes, bytes]], roots: dict[bytes, bytes]) -> list[tuple[bytes, bytes]]:
    """Those of the links that join what the links before them, and the roots, leave apart."""
    above: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while x in above:
            x = above[x]
        return x

    out = []
    for a, b in ends:
        ra, rb = top(roots[a]), top(roots[b])
        if ra != rb:
            above[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _with_group(members: DataFrame, groups: DataFrame, on: str = "group") -> DataFrame:
    """Members joined with their group's row, every group in ``PARTS`` parts, so that a large one is not one task's alone."""
    part = F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int").alias("part")
    return members.select("*", part).join(groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")), [on, "part"]).drop("part")


def _linked(docs: DataFrame, members: DataFrame, classes: DataFrame, percent: int, key: str, text: str) -> DataFrame:
    """Links (a, b) between members (group, node, root, u, v) of a group, one marked u and one v, that have the components of all such
    links whose roots differ: those of full sets with 100 * intersection >= percent * union.

    The u and the v of a group are dealt to blocks of about ``BLOCK`` sets or ``HASHES`` shingles. A task holds a block of u against
    a block of v and returns the edges that join something, so neither pairs nor copies of a set for each pair are written.
    """
    members = kept(members)
    wanted = members.select("node").distinct().join(classes, "node").select("node", "key")
    sets = kept(_sets(docs, wanted, key, text))
    facts = classes.select("node", "regs", "n_shingles")
    sized = members.join(facts.select("node", "n_shingles"), "node")
    count = lambda side: F.greatest(
        F.ceil(F.count(F.when(F.col(side), 1)) / BLOCK), F.ceil(F.sum(F.when(F.col(side), F.col("n_shingles"))) / HASHES)).cast("int")
    blocks = kept(sized.groupBy("group").agg(count("u").alias("n_u"), count("v").alias("n_v")).where("n_u > 0 and n_v > 0"))
    dealt = _with_group(members, blocks).join(sets, "node").join(facts.select("node", "regs"), "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["node", "root", "regs", "hashes"]
    u = dealt.where("u").select("group", own("n_u").alias("b_u"), every("n_v").alias("b_v"), F.lit(True).alias("u"), *cols)
    v = dealt.where("v").select("group", every("n_u").alias("b_u"), own("n_v").alias("b_v"), F.lit(False).alias("u"), *cols)

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        mark = part.column("u").to_numpy().astype(bool)
        nodes, roots = (np.array(part.column(c).to_pylist(), object) for c in ("node", "root"))
        regs = np.frombuffer(b"".join(part.column("regs").to_pylist()), "<u2").reshape(-1, REGISTERS)
        lists = part.column("hashes").chunk(0) if part.num_rows else None
        sets_ = [lists[i].values.to_numpy().view("<u8") for i in range(part.num_rows)]
        us, vs = np.flatnonzero(mark), np.flatnonzero(~mark)
        found = np.zeros((0, 2), int)
        if len(us) and len(vs):
            open_ = roots[us][:, None] != roots[vs][None, :]
            found = np.argwhere(_links_of(regs[us], regs[vs], [sets_[i] for i in us], [sets_[i] for i in vs], open_, percent))
        ends = _spanning([(nodes[us[i]], nodes[vs[j]]) for i, j in found], dict(zip(nodes, roots)))
        return pa.table({"a": pa.array([a for a, _ in ends], pa.binary()), "b": pa.array([b for _, b in ends], pa.binary())})

    return u.union(v).groupBy("group", "b_u", "b_v").applyInArrow(run, "a binary, b binary")


def links(docs: DataFrame, classes: DataFrame, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Edges (a, b) between classes of equal shingle sets that have the components of all links.

    Classes that share a band meet under the band's leader, the member whose bands are the most shared, as the common original
    of a group of copies is; bands of one leader are one group. First every member is held against the leader. Then the members
    outside the largest component of a group are held, in blocks, against its members in other components. Pairs within one
    component need no check, so a large group of near copies costs in proportion to its size; what remains to be compared is what
    the leader did not join.
    """
    bands = classes.select("node", F.explode("bands").alias("band"))
    shared = kept(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = kept(_with_group(bands, shared, "band"))
    score = kept(members.groupBy("node").agg(F.sum(F.log("n")).alias("score")))
    leaders = members.join(score, "node").groupBy("band").agg(F.max(F.struct("score", "node"))["node"].alias("group"))
    met = kept(_with_group(members, leaders, "band").select("group", "node").distinct())
    near = _promising(met.where("node <> group").select(F.col("group").alias("a"), F.col("node").alias("b")), classes, percent)
    near = kept(near.select(F.col("a").alias("group"), F.col("b").alias("node")))
    first = near.select("group", "node", F.lit(False).alias("u"), F.lit(True).alias("v")).union(
        near.select("group", F.col("group").alias("node"), F.lit(True), F.lit(False)).distinct())
    roots = kept(components(_linked(docs, first.select("group", "node", F.col("node").alias("root"), "u", "v"), classes, percent, key, text)))
    placed = kept(met.join(roots, "node", "left").select("group", "node", F.coalesce("root", "node").alias("root")))
    sizes = placed.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"))
    split = sizes.groupBy("group").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("all")) \
        .where("roots > 1 and all > 2").select("group", "main")
    rest = _with_group(placed, split).select("group", "node", "root", (F.col("root") != F.col("main")).alias("u"), F.lit(True).alias("v"))
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_linked(docs, rest, classes, percent, key, text))


def _classes(rows: DataFrame) -> DataFrame:
    """node, key (the least), regs, bands, n_shingles of the distinct non-empty sets."""
    usable = rows.where("key is not null and node is not null")
    return kept(usable.groupBy("node").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("regs", "bands", "n_shingles")]))


def _components(docs: DataFrame, classes: DataFrame, percent: int, key: str, text: str) -> DataFrame:
    """node, component_id (the least key of its component) of every class."""
    roots = kept(components(links(docs, classes, percent, key, text)))
    least = kept(roots.join(classes, "node").groupBy("root").agg(F.min("key").alias("least")))
    placed = roots.join(least, "root").select("node", "least")
    return kept(classes.select("node", "key").join(placed, "node", "left").select("node", F.coalesce("least", "key").alias("component_id")))


def near_duplicates(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: documents linked at 100 * intersection >= percent * union.

    Equal sets are one class from the start, so copies are never paired. Null or wordless texts have n_shingles 0 and are their
    own component. Rows with a null key take no part: their component_id and kept are null. Rows that repeat a key share the
    class of their text. Other columns are not read; an empty table gives an empty result.
    """
    rows = kept(sketches(docs, key, text))
    answer = _components(docs, _classes(rows), percent, key, text)
    loose = rows.where("node is null or key is null").withColumn("component_id", F.col("key"))
    joined = rows.where("node is not null and key is not null").join(answer, "node")
    return joined.select("key", "n_shingles", "component_id").union(loose.select("key", "n_shingles", "component_id")).select(
        F.col("key").alias("doc_id"), "n_shingles", "component_id", (F.col("key") == F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, all their columns, of which no near duplicate with a smaller key is there.

    Rows with a null key, and rows without words, stay. Of rows that repeat a key all stay or go that share a text: a row goes if
    its own text belongs to a group whose smallest key is another.
    """
    rows = kept(sketches(docs, key, text))
    classes = _classes(rows)
    answer = _components(docs, classes, percent, key, text)
    gone = rows.join(answer, "node").where(F.col("key") != F.col("component_id")).select("key", "node").distinct()
    lost = kept(gone.withColumn("gone", F.lit(True)))
    few = lost.groupBy("key").agg(F.collect_set("node").alias("gone_nodes"))
    joined = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).join(few, F.col("row")[key].cast("long") == few["key"], "left")

    def run(batches):
        for part in steps(batches):
            own = [None if g is None else set(g) for g in part.column("gone_nodes").to_pylist()]
            doubt = [i for i, g in enumerate(own) if g]
            found = shingle_sets([part.column("row").field(at)[i].as_py() or "" for i in doubt])
            keep = [True] * part.num_rows
            for i, s in zip(doubt, found):
                keep[i] = xxhash.xxh3_128_digest(s.tobytes()) not in own[i]
            yield pa.RecordBatch.from_arrays(part.column("row").flatten(), names=names).filter(pa.array(keep, pa.bool_()))

    at, names = docs.columns.index(text), docs.columns
    return joined.select("row", "gone_nodes").mapInArrow(run, docs.schema)
