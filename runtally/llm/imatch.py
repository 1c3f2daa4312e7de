"""Document fingerprints by I-Match over randomised lexicons.

Terms are kept whose document frequency lies in a band. The sorted distinct terms of a document that are in the lexicon give the
classic signature. Besides, many random lexicons are drawn, in nested sizes of which a document uses the three that leave it two
terms to a quarter of one; the sorted terms left by each are hashed. Two documents agree on a lexicon of rate p with probability (1 - p)^d if d
terms are in just one of them, so the share of agreements estimates their Jaccard similarity.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from runtally.llm.rows import steps, texts

#: The band: least and greatest share of documents that hold a term, and least number of them. At most (mean distinct terms of a document) / LEAST_SHARE
#: terms can be in it, whatever the corpus holds.
LEAST_SHARE, MOST_SHARE, LEAST_DOCS = 0.001, 0.2, 2
#: Random lexicons, and slots of the first count, which sorts out rare terms.
LEXICONS, SLOTS = 48, 1 << 17
#: Nested sizes of a lexicon that are hashed: numbers of terms up to a factor of 4 apart have one in common.
LEVELS = 3

_WORD = re.compile(r"\w+")
_FACTORS = [np.uint64(xxhash.xxh3_64_intdigest(b"lexicon", seed=i) | 1) for i in range(LEXICONS)]
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def term_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of the lower-case words of whole texts.

    No word is remembered: its hash takes less time than a look-up among very many words.
    """
    sets = []
    for t in texts:
        own = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, set(_WORD.findall(t.lower())))), ">u8").astype("<u8")
        own.sort()
        sets.append(own if (own[1:] != own[:-1]).all() else np.unique(own))
    return sets


def lexicon(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Sorted hashes of the terms whose document frequency, counted over all documents, is in the band.

    First the documents of all terms of a slot are counted, a table of fixed size; only terms of slots that reach the lower end can be
    in the band, and only those are counted one by one.
    """
    rows = docs.select(docs[text].alias("text"))

    def slots(batches):
        total = np.zeros(SLOTS, np.int64)
        for part in steps(batches):
            for own in term_sets(texts(part)):
                total += np.bincount((own % np.uint64(SLOTS)).astype(int), minlength=SLOTS) if len(own) > SLOTS // 8 else 0
                if len(own) <= SLOTS // 8:
                    np.add.at(total, (own % np.uint64(SLOTS)).astype(int), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["slot", "n"])

    least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * rows.count()))
    most = max(MOST_SHARE * rows.count(), LEAST_DOCS)
    wide = np.zeros(SLOTS, bool)
    wide[[r["slot"] for r in rows.mapInArrow(slots, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("slot").collect()]] = True
    shared = docs.sparkSession.sparkContext.broadcast(wide)

    def terms(batches):
        for part in steps(batches, 4096):
            own = np.concatenate([np.zeros(0, np.uint64), *term_sets(texts(part))])
            found, n = np.unique(own[shared.value[(own % np.uint64(SLOTS)).astype(int)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view("<i8")), pa.array(n, pa.int64())], ["term", "n"])

    counted = rows.mapInArrow(terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = counted.where((F.col("n") >= least) & (F.col("n") <= most)).select("term").toArrow()
    return np.sort(band.column("term").to_numpy().astype("<i8").view("<u8"))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass(frozen=True)
class Fingerprint:
    """Number of terms, signature of all of them, first level, and a hash for each of LEVELS levels and each lexicon.

    ``kind`` is b if the terms are those of the band, and a if a text has none of those and all its terms are taken.
    """

    kind: str
    n: int
    signature: str
    level: int
    hashes: np.ndarray

    def __str__(self) -> str:
        return f"{self.kind}:{self.n}:{self.signature}:{self.level}:{self.hashes.astype('>u2').tobytes().hex()}"

    def likeness(self, other: "Fingerprint") -> float:
        """Estimated Jaccard similarity of the terms, 1 for equal signatures.

        Sizes that share no level are more than a factor of 4 apart: 0 stands for a similarity below 1/4. Terms of the band say
        nothing of all terms, so both have to be of one kind (see ``likenesses``).
        """
        if self.kind != other.kind:
            raise ValueError("one fingerprint is of the band, the other of all terms")
        if self.signature == other.signature:
            return 1.0
        low = max(self.level, other.level)
        shared = range(low, min(low + 2, min(self.level, other.level) + LEVELS))
        if not shared:
            return 0.0
        apart = []
        for level in shared:
            same = float((self.hashes[level - self.level] == other.hashes[level - other.level]).mean())
            apart.append(math.log(max(same, 0.5 / LEXICONS)) / math.log(1 - 2.0 ** -(level + 1)))
        both = self.n + other.n
        d = max(sum(apart) / len(apart), abs(self.n - other.n))
        return min(max((both - d) / (both + d), 0.0), 1.0)


def fingerprints(texts: list[str], band: np.ndarray) -> list[Fingerprint]:
    """Fingerprints of whole texts."""
    sets, kinds = [], []
    for own in term_sets(texts):
        at = np.searchsorted(band, own)
        inside = own[band[np.minimum(at, len(band) - 1)] == own] if len(band) else own[:0]
        sets.append(inside if len(inside) else own)
        kinds.append("b" if len(inside) else "a")
    sizes = np.array([len(s) for s in sets], int)
    levels = np.array([max(0, int(math.log2(max(n, 1))) - 1) for n in sizes], int)
    flat, doc = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), sizes)
    out = np.zeros((len(sets), LEVELS, LEXICONS), np.uint64)
    # A term, its hash being random, is in a lexicon of rate p if the product with the factor of the lexicon is below p of all numbers.
    bound = (np.uint64(1) << (63 - levels).astype(np.uint64))[doc]
    for k, factor in enumerate(_FACTORS):
        h = flat * factor
        inside = np.flatnonzero(h < bound)
        h, d, below = h[inside], doc[inside], bound[inside]
        mixed = _mix(h)
        for deep in range(LEVELS):
            if deep:
                below = below >> np.uint64(1)
                on = np.flatnonzero(h < below)
                h, d, below, mixed = h[on], d[on], below[on], mixed[on]
            if len(d):
                first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                rank = np.arange(len(d)) - np.repeat(first, np.diff(first, append=len(d)))
                out[d[first], deep, k] = np.add.reduceat(mixed * _POWERS[rank % len(_POWERS)], first)
    return [Fingerprint(kind, len(s), hashlib.blake2b(s.tobytes(), digest_size=8).hexdigest(), int(level), h >> np.uint64(48))
            for kind, s, level, h in zip(kinds, sets, levels, out)]


def likenesses(pairs: list[tuple[tuple[str, Fingerprint], tuple[str, Fingerprint]]]) -> list[float]:
    """Likeness of each two texts by their fingerprints, and by all their terms where only one of them has terms in the band."""
    apart = [i for i, ((_, a), (_, b)) in enumerate(pairs) if a.kind != b.kind]
    whole = dict(zip(apart, fingerprints([next(t for t, p in pairs[i] if p.kind == "b") for i in apart], np.zeros(0, np.uint64))))
    return [next(p for _, p in pair if p.kind == "a").likeness(whole[i]) if i in whole else pair[0][1].likeness(pair[1][1])
            for i, pair in enumerate(pairs)]


def in_order(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``text``, ``ahead``, one range of keys to a partition, sorted by key and text; null keys come first.

    Each partition ends with the first row of the next range, marked ``ahead``; the last range is followed by the first. Texts
    move once. Bounds and firsts are one small row per partition.
    """
    least = -(1 << 63)
    rows = docs.select(F.coalesce(docs[key].cast("long"), F.lit(least)).alias("order"), docs[key].cast("long").alias("key"), docs[text].alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [(i + 1) / parts for i in range(parts - 1)]
    bounds = sorted(set(rows.agg(F.percentile_approx("order", cuts, 10000).alias("q")).first()["q"] or [])) if cuts else []
    place = F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b < F.col("order"))) if bounds else F.lit(0)
    rows = rows.withColumn("part", place)
    firsts = sorted((r["part"], r["first"]) for r in rows.groupBy("part").agg(F.min("order").alias("first")).collect())
    before = [(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))]
    ahead = docs.sparkSession.createDataFrame(before, "order long, part int")
    extra = rows.drop("part").join(F.broadcast(ahead), "order").select("order", "key", "text", "part", F.lit(True).alias("ahead"))
    every = rows.withColumn("ahead", F.lit(False)).unionByName(extra)
    return every.repartitionById(parts, F.col("part")).sortWithinPartitions("ahead", "order", "text").select("key", "text", "ahead")


def edited(text: str, after: str) -> str:
    """The text with its last quarter replaced by as much of the start of the next one."""
    q = len(text) // 4
    return text[:len(text) - q] + after[:q]


def compare_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The next document is the one after it by doc_id, then text (null ids first); after the last comes the first; a lone one
    follows itself. A null text counts as empty. Repeated rows are documents of their own. Other columns are not read; an
    empty table gives an empty result.
    """
    band = docs.sparkSession.sparkContext.broadcast(lexicon(docs))

    def run(batches):
        held = None
        for part in steps(batches):
            keys, own = part.column("key").to_pylist(), texts(part)
            prints = fingerprints(own, band.value)
            row = list(zip(keys, own, prints, part.column("ahead").to_pylist()))
            if held:
                row.insert(0, held)
            held = row[-1]
            yield result(row)

    def result(row):
        pairs = [(a, b) for a, b in zip(row, row[1:]) if not a[3]]
        changed = [edited(a[1], b[1]) for a, b in pairs]
        prints = fingerprints(changed, band.value)
        return pa.RecordBatch.from_arrays([
            pa.array([a[0] for a, _ in pairs], pa.int64()), pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([str(a[2]) for a, _ in pairs], pa.string()), pa.array([str(p) for p in prints], pa.string()),
            pa.array(likenesses([(a[1:3], x) for (a, _), x in zip(pairs, zip(changed, prints))]), pa.float64()),
            pa.array(likenesses([(a[1:3], b[1:3]) for a, b in pairs]), pa.float64())],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
