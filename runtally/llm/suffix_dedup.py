"""Repeated passages between documents: text dealt out by anchors, two-stage suffix sorting, adjacent common prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from runtally.llm.rows import saved

#: Bytes of a repeated string; bytes of an anchor within it; strings of a segment at most (only periodic text reaches it).
LENGTH, ANCHOR, RUN = 50, 16, 64
#: Bytes of text of a block, and of segments sorted together.
BLOCK, SORTED = 8_000_000, 1_000_000
#: Bytes behind the end of a buffer that words may reach into.
PAD = 64

_STEP = 1 << 16
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def buffer(parts: list[bytes]) -> np.ndarray:
    """The parts one after the other, and padding."""
    return np.frombuffer(b"".join([*parts, bytes(PAD)]), np.uint8)


def words(buf: np.ndarray, at: int, n: int, kind: str = "<u8") -> np.ndarray:
    """Eight bytes from each of n places on, as whole numbers."""
    return np.ndarray((n,), kind, buf, at, (1,)).astype("=u8")


def least_anchors(buf: np.ndarray, n: int) -> np.ndarray:
    """For each of the first n places the least hash of the anchors that lie whole within the ``LENGTH`` bytes from there.

    Equal strings have equal values. Anchors of a short period rank behind all others, so that rows of one sign do not gather
    unrelated texts.
    """
    out, span = np.empty(n, np.uint64), LENGTH - ANCHOR + 1
    for at in range(0, n, _STEP):
        size = min(_STEP, n - at)
        wide = min(size + span - 1, len(buf) - at - 16)
        first = words(buf, at, wide)
        h = first * _MULTIPLIERS[0] + words(buf, at + 8, wide) * _MULTIPLIERS[1]
        h ^= h >> np.uint64(32)
        h = h * _MULTIPLIERS[2] >> np.uint64(1)
        dull = first == words(buf, at + 1, wide)
        for period in (2, 3, 4):
            dull |= first == words(buf, at + period, wide)
        h |= dull.astype(np.uint64) << np.uint64(63)
        reach = 1
        while 2 * reach <= span:
            h = np.minimum(h[:-reach], h[reach:])
            reach *= 2
        low = np.minimum(h[:len(h) - (span - reach)], h[span - reach:])[:size]
        out[at:at + len(low)] = low
        out[at + len(low):at + size] = 0  # too near the end for a whole string
    return out


def segments(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer of the texts; place, strings, anchor and text of each segment: a run of strings with one least anchor."""
    buf = buffer(raw)
    sizes = np.array([len(r) for r in raw], np.int64)
    ends = np.cumsum(sizes)
    starts, n = ends - sizes, int(sizes.sum())
    if not n:
        none = np.zeros(0, np.int64)
        return buf, none, none, none.astype(np.uint64), none
    edge = np.zeros(n + 1, np.int32)
    long = sizes >= LENGTH
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - LENGTH + 1, -1)
    whole = np.cumsum(edge[:n]) > 0
    low = least_anchors(buf, n)
    fresh = whole.copy()
    fresh[1:] &= ~whole[:-1] | (low[1:] != low[:-1])
    at = np.flatnonzero(fresh)
    stops = np.flatnonzero(np.r_[fresh, True] | np.r_[~whole, True])
    count = stops[np.searchsorted(stops, at, "right")] - at
    pieces = -(-count // RUN)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    place = np.repeat(at, pieces) + nth * RUN
    return buf, place, np.minimum(np.repeat(count, pieces) - nth * RUN, RUN), low[place], np.searchsorted(ends, place, "right")


def smaller_than_successor(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a place later; the last one is not."""
    differs = np.flatnonzero(t[:-1] != t[1:])
    out = np.zeros(len(t), bool)
    sizes = np.diff(np.r_[-1, differs])
    out[:len(t) - (len(t) - 1 - (differs[-1] if len(differs) else -1))] = np.repeat(t[differs] < t[differs + 1], sizes)
    return out


def sorted_directly(buf: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places by the ``depth`` bytes from them on: words are compared one after the other, only among what is still equal."""
    at = at[np.argsort(_big(buf, at), kind="stable")]
    first = _big(buf, at)
    fresh = np.r_[True, first[1:] != first[:-1]][:len(at)]
    for offset in [*range(8, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        group = np.cumsum(fresh)
        alone = fresh & np.r_[fresh[1:], True]
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        key, own = _big(buf, at[tied] + offset), group[tied]
        order = np.lexsort((key, own))
        at[tied], key = at[tied[order]], key[order]
        fresh[tied[1:]] |= (key[1:] != key[:-1]) & (own[1:] == own[:-1])
    return at


def _big(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, in an order that compares as the bytes do."""
    return np.ndarray((len(buf) - 7,), ">u8", buf, 0, (1,))[at].astype("=u8")


def two_stage(buf: np.ndarray, n: int, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of the first n bytes, sorted by their first ``depth`` bytes at least.

    Only those smaller than their successors are sorted directly. A scan over the buckets of first bytes induces the others: each
    bucket, once whole, hands the suffixes that start a place earlier with a larger byte to the buckets of those bytes in its order;
    those that start with the bucket's own byte follow in rounds.
    """
    t = buf[:n]
    small = smaller_than_successor(t)
    direct = sorted_directly(buf, np.flatnonzero(small), depth)
    bounds = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        waiting[int(t[n - 1])].append(np.array([n - 1]))
    out = []
    for byte in range(256):
        induced = waiting[byte]
        front = np.concatenate(induced) if induced else np.zeros(0, np.int64)
        while len(front):
            before = front[front > 0] - 1
            front = before[t[before] == byte]
            if len(front):
                induced.append(front)
        bucket = np.concatenate([*induced, direct[bounds[byte]:bounds[byte + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[t[before] > byte]
        by = np.argsort(t[before], kind="stable")
        before = before[by]
        heads = t[before]
        cuts = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]][:len(heads)])
        for part in np.split(before, cuts[1:]) if len(cuts) else []:
            waiting[int(t[part[0]])].append(part)
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def common_prefixes(buf: np.ndarray, at: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Leading bytes that each place has in common with the one before it in the list, ``most`` at most; 0 for the first."""
    out = np.zeros(len(at), np.int64)
    open_ = np.arange(1, len(at))
    for offset in range(0, most, 8):
        x, y = _big(buf, at[open_ - 1] + offset), _big(buf, at[open_] + offset)
        differ = x ^ y
        same = differ == 0
        # the place of the highest differing bit, in bytes from the front; halves keep the numbers exact as floats
        high, low = (differ >> np.uint64(32)).astype(float), (differ & np.uint64(0xFFFFFFFF)).astype(float)
        lead = np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1]) // 8
        out[open_] = offset + np.where(same, 8, lead)
        open_ = open_[same]
    return np.minimum(out, most)


def covered(found: list[bytes], owner: np.ndarray) -> list[np.ndarray]:
    """For each segment, given with its document: which of its strings start in a segment of a smaller document as well."""
    distinct: dict[bytes, int] = {}
    which = np.array([distinct.setdefault(s, len(distinct)) for s in found], np.int64)
    first = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(first, which, owner)
    sizes = np.array([len(s) for s in distinct], np.int64)
    starts = np.cumsum(sizes) - sizes
    buf, n = buffer(list(distinct)), int(sizes.sum())
    of = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.arange(n) - starts[of] <= (sizes - LENGTH)[of]
    order = two_stage(buf, n)
    order = order[whole[order]]
    fresh = np.flatnonzero(common_prefixes(buf, order) < LENGTH)
    least = np.minimum.reduceat(first[of[order]], fresh) if len(fresh) else np.zeros(0, np.int64)
    at = np.empty(n, np.int64)
    at[order] = np.repeat(least, np.diff(np.r_[fresh, len(order)]))
    return [at[starts[k]:starts[k] + sizes[k] - LENGTH + 1] < d for k, d in zip(which.tolist(), owner.tolist())]


def stretches(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and size in bytes of what runs of covered strings cover."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        yield a, b - a + LENGTH - 1


def _block_rows(table: pa.Table, copies: pa.Table) -> tuple[list[int | None], list[bytes], list[int], set[int]]:
    """Rows of a block by key and text, so that every pass numbers them alike: keys, texts, the places of those that are compared, and
    the places of copies of a text that a smaller key has."""
    ids, raw = table.column("doc_id").to_pylist(), table.column("raw").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, raw[i]))
    ids, raw = [ids[i] for i in order], [raw[i] for i in order]
    known = {(i, d) for i, d in zip(copies.column("doc_id").to_pylist(), copies.column("digest").to_pylist()) if d is not None}
    doubtful = {i for i, _ in known}
    same = {k for k, i in enumerate(ids) if i in doubtful and (i, hashlib.sha256(raw[k]).hexdigest()) in known}
    return ids, raw, [k for k, i in enumerate(ids) if i is not None and k not in same], same


def _anchors(table: pa.Table, copies: pa.Table) -> pa.Table:
    """anchor, block, several (whether two documents of the block hold it) for the anchors of a block."""
    ids, raw, own, _ = _block_rows(table, copies)
    _, _, _, anchor, doc = segments([raw[k] for k in own])
    owner = np.array([ids[k] for k in own], np.int64)[doc]
    order = np.argsort(anchor, kind="stable")  # documents stay in their order
    anchor, owner = anchor[order], owner[order]
    fresh = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]][:len(anchor)])
    last = np.r_[fresh[1:], len(anchor)][:len(fresh)] - 1
    block = table.column("block")[0].as_py() if table.num_rows else 0
    return pa.table({"anchor": anchor[fresh].view(np.int64), "block": np.full(len(fresh), block, np.int64), "several": owner[fresh] != owner[last]})


FOUND = pa.schema([("anchor", pa.int64()), ("segment", pa.binary()), ("doc_id", pa.int64()), ("block", pa.int64()), ("row", pa.int32()), ("at", pa.int64()), ("size", pa.int64())])


def _shared_segments(table: pa.Table, shared: pa.Table) -> pa.Table:
    """Segments of a block whose anchor is shared: the first document's with its text, of the others what they cover.

    A segment that a smaller document of the same block holds as well is covered whole, so it need not be compared any more.
    """
    ids, raw, own, _ = _block_rows(table, shared)
    wanted = np.sort(shared.column("anchor").drop_null().to_numpy().view(np.uint64))
    if not own or not len(wanted):
        return FOUND.empty_table()
    block = table.column("block")[0].as_py()
    buf, place, strings, anchor, doc = segments([raw[k] for k in own])
    hit = np.minimum(np.searchsorted(wanted, anchor), len(wanted) - 1)
    keep = np.flatnonzero(wanted[hit] == anchor)
    starts = np.cumsum([0, *(len(raw[k]) for k in own)])
    text = buf.tobytes()
    first: dict[bytes, int] = {}
    rows: list[tuple] = []
    done: list[list[int]] = []
    keys = anchor.view(np.int64)
    for p, s, a, d in zip(place[keep].tolist(), strings[keep].tolist(), keys[keep].tolist(), doc[keep].tolist()):
        segment, key = text[p:p + s + LENGTH - 1], ids[own[d]]
        if first.setdefault(segment, key) == key:
            rows.append((a, segment, key, block, own[d], p - int(starts[d]), len(segment)))
        elif done and done[-1][0] == d and done[-1][2] >= p:
            done[-1][2] = p + len(segment)
        else:
            done.append([d, p, p + len(segment)])
    rows += [((block * 1_000_003 + k) % 2_147_483_647, None, ids[own[d]], block, own[d], p - int(starts[d]), e - p) for k, (d, p, e) in enumerate(done)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FOUND)], schema=FOUND) if rows else FOUND.empty_table()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered stretches (block, row, at, size): segments arrive by anchor and are sorted together in whole anchors."""
    names = ["block", "row", "at", "size"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        masks = covered([r[1] for r in held], np.array([r[2] for r in held], np.int64))
        out = [(r[3], r[4], r[5] + a, n) for r, mask in zip(held, masks) if mask.any() for a, n in stretches(mask)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], names)

    for batch in batches:
        plain = batch.filter(batch.column("segment").is_null())
        if plain.num_rows:
            yield plain.select(names)
        rows = batch.filter(batch.column("segment").is_valid())
        for r in zip(*(rows.column(f.name).to_pylist() for f in FOUND)):
            if size >= SORTED and r[0] != held[-1][0]:
                yield flush()
                held, size = [], 0
            held.append(r)
            size += r[6]
    if held:
        yield flush()


def union_of(at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches."""
    order = np.argsort(at, kind="stable")
    at, end = at[order], np.maximum.accumulate((at + size)[order])
    fresh = np.flatnonzero(np.r_[True, at[1:] > end[:-1]][:len(at)])
    return at[fresh], end[np.r_[fresh[1:], len(at)] - 1] if len(fresh) else end


def _cut(table: pa.Table, cover: pa.Table) -> Iterator[tuple[int | None, bytes, list[tuple[int, int]], bytes]]:
    """doc_id, text, removed spans and remaining bytes of every row of a block."""
    ids, raw, _, same = _block_rows(table, cover)
    cover = cover.filter(cover.column("row").is_valid())
    row, at, size = (cover.column(c).to_numpy().astype(np.int64) for c in ("row", "at", "size"))
    order = np.argsort(row, kind="stable")
    row, at, size = row[order], at[order], size[order]
    bounds = np.searchsorted(row, np.arange(len(ids) + 1))
    for k, (i, text) in enumerate(zip(ids, raw)):
        if k in same and len(text) >= LENGTH:
            yield i, text, [(0, len(text))], b""
            continue
        own = slice(bounds[k], bounds[k + 1])
        a, b = (x.tolist() for x in union_of(at[own], size[own]))
        yield i, text, list(zip(a, b)), b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)])) if a else text


def _removals(docs: DataFrame, key: str, text: str, answer, schema: str) -> DataFrame:
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(docs[text]) + 64)).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // BLOCK))
    rows = docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).cast("binary").alias("raw")) \
        .select(F.pmod(F.xxhash64("doc_id", "raw"), F.lit(n)).alias("block"), "doc_id", "raw")
    blocks = rows.groupBy("block")
    copies = saved(_copies(rows))
    noted = lambda df: df.unionByName(copies, allowMissingColumns=True).groupBy("block")
    anchors = blocks.cogroup(copies.groupBy("block")).applyInArrow(_anchors, "anchor long, block long, several boolean")
    same = Window.partitionBy("anchor")
    shared = anchors.select("block", "anchor", ((F.count(F.lit(1)).over(same) > 1) | F.max("several").over(same)).alias("shared")).where("shared").select("block", "anchor")
    found = blocks.cogroup(noted(shared)).applyInArrow(_shared_segments, "anchor long, segment binary, doc_id long, block long, row int, at long, size long")
    cover = found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compared, "block long, row int, at long, size long")
    return blocks.cogroup(noted(cover)).applyInArrow(answer, schema)


def _copies(rows: DataFrame) -> DataFrame:
    """block, doc_id, digest of rows whose whole text a row with a smaller key has: they need no comparison."""
    keys = rows.where("doc_id IS NOT NULL").select("block", "doc_id", F.sha2("raw", 256).alias("digest"))
    least = keys.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    return keys.join(least.drop("most"), "digest").where("doc_id > least").select("block", "doc_id", "digest").distinct()


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row: bytes covered by a string of ``LENGTH`` bytes that also starts in a
    document with a smaller key go.

    Texts are UTF-8 bytes and judged as they came; null texts are empty. Rows with a null key are left whole and cover nothing.
    Rows that repeat a key are one document's: none covers another of them, equal or not. Texts shorter than a string stay.
    Other columns are not read; an empty table gives an empty result.

    Documents are dealt into blocks of bounded size. Copies of a whole text are known by its digest and compared no more. Every string goes by the least of the anchors in it, so equal strings meet; only
    segments whose anchor two documents share are sent on, once for each block that holds them.
    """
    def answer(table: pa.Table, cover: pa.Table) -> pa.Table:
        rows = [(i, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for i, t, spans, kept in _cut(table, cover)]
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _removals(docs, key, text, answer, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remainders(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans (start and end in bytes of what goes) and kept (the remaining bytes) of every row, by the rules of ``report``."""
    def answer(table: pa.Table, cover: pa.Table) -> pa.Table:
        rows = [(i, [{"start": a, "end": b} for a, b in spans], kept) for i, _, spans, kept in _cut(table, cover)]
        kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, kinds)], ["doc_id", "spans", "kept"])

    return _removals(docs, key, text, answer, "doc_id long, spans array<struct<start: long, end: long>>, kept binary")
