"""Packing token sequences by a grouping genetic algorithm on islands.

Pieces are dealt at random into shards of about SHARD pieces. Every shard is packed on several islands; an island holds a few
packings and breeds them: whole well-filled bins of one parent are put into the other, bins that now hold a piece twice are
dissolved, and the pieces displaced go where they fit best. After each epoch the best packing of an island moves to the next.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from runtally.llm import tokens
from runtally.llm.piece_bpe import byte_chars
from runtally.llm.rows import kept, mapped, steps, texts

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 2048
#: The id that closes every document.
END = 0
#: Pieces of a shard on average; islands of a shard; epochs, and generations of each; packings of an island.
SHARD, ISLANDS, EPOCHS, GENERATIONS, PEOPLE = 4096, 2, 2, 8, 4
#: Free share of a well-filled bin, and the share of the well-filled bins that one crossing injects.
WELL_FILLED, INJECTED = 0.01, 0.5

#: Words that the merges encode in one go.
JOINED = 128

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


#: Runs of letters and digits with the space before them; a line end before such a run; all between. The split pattern of byte-level BPE
#: parts a text at all of these places. A run behind anything but a plain sign (an apostrophe may begin a contraction) stays with that.
_PIECE = re.compile(r" ?[^\W_]+|\n(?=[^\W_])|(?:[^\w \n]|_|[ \n](?![^\W_]))+(?:(?<![!-&(-/:-@\[-`{-~])[^\W_]+)?")

#: A letter or digit and the sign behind it, between which the split pattern always parts; spaces that no non-space follows.
_SIGN = r"([\pL\pN])([.,;:!?])"
_ODD = re.compile(r" (?!\S)")
#: Marks a part without a space before it; stands for a space within a part. A text with either is not cut.
MARK, SPACE = "\x00", "\x01"


class JsonBpe:
    """Ids of whole texts by a tokenizer file, as unsigned 32-bit numbers (little-endian, as the machines Spark runs on)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = Tokenizer(self.tokenizer.model)
        chars = byte_chars()
        self.to_chars = dict(enumerate(chars))
        to_bytes = {c: b for b, c in enumerate(chars)}
        names = {i: bytes(map(to_bytes.get, t)) for t, i in self.tokenizer.get_vocab(False).items() if to_bytes.keys() >= set(t)}
        self.starts = np.zeros(max(names) + 1, bool)
        self.starts[[i for i, t in names.items() if t[:1] == b" "]] = True
        # Words can be joined unless a token has a space behind a letter, or behind what may be the end of one.
        within = [t.decode(errors="replace").lstrip(" ") for t in names.values() if b" " in t.lstrip(b" ")]
        self.joined = 1 if any(x.isalpha() or x == "\ufffd" for t in within for x, after in zip(t, t[1:]) if after == " ") else JOINED
        #: Ids of pieces, and of parts of a text.
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """A space and letters are one pre-token, which the merges alone encode; all else goes through the whole tokenizer.

        Many such words are encoded as one string, as no merge joins a letter with a space; each begins at the token with its space.
        """
        words = [x for x in new if x[0] == " " and x[1:].isalpha()]
        rest = list(set(new).difference(words))
        self.memo.update(zip(rest, self._encode(rest)))
        self.memo.update(zip(words, self._words(words)))

    def _words(self, words: list[str]) -> list[bytes]:
        joined = ["".join(words[at:at + self.joined]).encode().decode("latin-1").translate(self.to_chars) for at in range(0, len(words), self.joined)]
        ids = array("I", [i for x in self.merges.encode_batch_fast(joined, add_special_tokens=False) for i in x.ids]).tobytes()
        first = (4 * np.flatnonzero(self.starts[np.frombuffer(ids, "<u4")])).tolist()
        return list(map(ids.__getitem__, map(slice, first, [*first[1:], len(ids)])))

    def _learn_parts(self, new: list[str]) -> list[str]:
        """Words are encoded as they are, other parts by their pieces; the pieces that the memo did not hold are returned."""
        words = [x for x in new if x.isalpha()]
        self.words.update(zip(words, self._words([" " + x for x in words]), strict=True))
        cut = {x: _PIECE.findall((x[1:] if x[:1] == MARK else " " + x).replace(SPACE, " ")) for x in new if not x.isalpha()}
        pieces = list(set().union(*cut.values()).difference(self.memo))
        known = {x: self.words[x[1:]] for x in pieces if x[0] == " " and x[1:] in self.words}
        self.memo.update(known)
        self._learn([x for x in pieces if x not in known])
        ids = self.memo.__getitem__
        self.words.update((x, b"".join(map(ids, c))) for x, c in cut.items())
        return pieces

    def _texts(self, texts: list[str]) -> list[bytes]:
        """Texts are cut at spaces and before signs that end a word, and every different part of a batch is looked up once.

        A part without a space before it, and the first of a text, begins with ``MARK``; ``SPACE`` stands for a space that is no cut.
        """
        plain = [MARK + (_ODD.sub(SPACE, t) if _ODD.search(t) else t) for t in texts]
        cuts = pc.split_pattern(pc.replace_substring_regex(pa.array(plain, pa.large_string()), _SIGN, rf"\1 {MARK}\2"), " ")
        parts = cuts.flatten().dictionary_encode()
        different = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.words.get, different))
        open_ = [i for i, f in enumerate(found) if f is None]
        new = [different[i] for i in open_]
        pieces = self._learn_parts(new)
        for i, x in zip(open_, new):
            found[i] = self.words[x]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = parts.indices.to_numpy()
        ends = np.cumsum(lengths[at])
        shift = (np.cumsum(lengths) - lengths)[at] - ends + lengths[at]
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(shift, lengths[at]) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.r_[0, ends][cuts.offsets.to_numpy()].tolist()
        if len(self.memo) > tokens.MEMO:
            self.memo.clear()
        if len(self.words) > tokens.MEMO:  # what the latest texts hold is what the next ones hold most
            self.words = dict(zip(different, found)) if len(different) <= tokens.MEMO // 2 else {}
        for memo, added in ((self.memo, pieces), (self.words, new)):
            for x in added:
                if len(x) > tokens.LONG:
                    memo.pop(x, None)
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """A text that holds the name of a special token is encoded in one go, as such a name may span pieces; so is one with a mark."""
        whole = [any(s in t for s in (*self.special, MARK, SPACE)) for t in texts]
        if any(whole):
            found = iter(self._texts([t for t, w in zip(texts, whole) if not w]))
            return [self._encode([t])[0] if w else next(found) for t, w in zip(texts, whole)]
        return self._texts(texts)


@lru_cache(maxsize=2)
def codec(path: str) -> JsonBpe:
    return JsonBpe(path)


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of n ids: full ones after a first one that takes the rest."""
    first = n % capacity
    return [first] * (first > 0) + [capacity] * (n // capacity)


def tokenise(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every whole text with its closing id; ``row`` is a number of the piece that no other piece has."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        count = TaskContext.get().partitionId() << 33
        for part in steps(batches):
            out: list[list] = [[] for _ in range(6)]
            for key, ids in zip(part.column("doc_id").to_pylist(), codec(path).encode(texts(part))):
                ids, at = ids + end, 0
                for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    for column, value in zip(out, (key, k, at, n, zlib.crc32(ids[4 * at:4 * (at + n)]), count)):
                        column.append(value)
                    at, count = at + n, count + 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


class Open:
    """Bins by free space, for the tightest bin that still takes a piece."""

    def __init__(self, capacity: int):
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def put(self, free: int, b: int) -> None:
        self.by_free[free].append(b)
        self.mask |= 1 << free

    def take(self, size: int) -> tuple[int, int] | None:
        """The tightest bin with room for ``size`` and its free space; it is taken out."""
        wide = self.mask >> size
        if not wide:
            return None
        free = size + (wide & -wide).bit_length() - 1
        b = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask &= ~(1 << free)
        return b, free


def best_fit(sizes: list[int], order: list[int], bins: np.ndarray, frees: list[int], capacity: int) -> None:
    """Place the pieces of ``order`` into the tightest bins; ``frees`` grows by the bins opened."""
    places = Open(capacity)
    for b, free in enumerate(frees):
        if free > 0:
            places.put(free, b)
    for i in order:
        size = sizes[i]
        if (found := places.take(size)) is None:
            found = (len(frees), capacity)
            frees.append(capacity)
        b, free = found
        bins[i], frees[b] = b, free - size
        if free > size:
            places.put(free - size, b)


def cross(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, capacity: int, drop: int = 3) -> np.ndarray:
    """A child of two packings: well-filled bins of ``b`` put whole into ``a``, the displaced pieces best-fitted.

    The ``drop`` emptiest bins left of ``a`` are dissolved as well, so that their pieces can fill gaps.
    """
    fill_a, fill_b = (np.bincount(x, sizes) for x in (a, b))
    good = np.flatnonzero(fill_b >= (1 - WELL_FILLED) * capacity)
    chosen = np.zeros(len(fill_b), bool)
    chosen[good[rng.random(len(good)) < INJECTED]] = True
    injected = chosen[b]
    gone = np.zeros(len(fill_a), bool)
    gone[a[injected]] = True
    left = np.flatnonzero(~gone)
    gone[left[np.argsort(fill_a[left], kind="stable")[:drop]]] = True
    stay = ~gone[a] & ~injected
    child = np.full(len(a), -1)
    names, child[stay] = np.unique(a[stay], return_inverse=True)
    extra, at = np.unique(b[injected], return_inverse=True)
    child[injected] = at + len(names)
    frees = (capacity - np.concatenate([fill_a[names], fill_b[extra]])).astype(int).tolist()
    out = np.flatnonzero(child < 0)
    noise = sizes[out] * (1 + 0.05 * rng.standard_normal(len(out)))
    best_fit(sizes.tolist(), out[np.argsort(-noise, kind="stable")].tolist(), child, frees, capacity)
    return child


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Number of bins, then how unevenly they are filled: fewer and more uneven is better."""
    fill = np.bincount(bins, sizes) / capacity
    return len(fill), -float((fill**2).sum())


def evolve(people: list[np.ndarray], sizes: np.ndarray, seed: tuple[int, ...], capacity: int = CAPACITY) -> list[np.ndarray]:
    """One epoch of an island, the best packing first; new packings make up the number."""
    rng = np.random.default_rng(seed)
    plain = sizes.tolist()
    while len(people) < PEOPLE:
        order = np.argsort(-(sizes * (1 + 0.1 * len(people) * rng.standard_normal(len(sizes)))), kind="stable")
        bins, frees = np.full(len(sizes), -1), []
        best_fit(plain, order.tolist(), bins, frees, capacity)
        people.append(bins)
    rank = lambda x: fitness(x, sizes, capacity)
    people = sorted(people, key=rank)[:PEOPLE]
    least = -(-int(sizes.sum()) // capacity)
    for _ in range(GENERATIONS):
        if rank(people[0])[0] <= least:
            break
        i, j = rng.choice(len(people), 2, replace=False)
        people = sorted([*people, cross(people[i], people[j], sizes, rng, capacity), cross(people[j], people[i], sizes, rng, capacity)], key=rank)[:PEOPLE]
    return people


def _epoch(state: DataFrame, epoch: int, capacity: int) -> DataFrame:
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        out, counts = [], []
        for shard, island, lengths, people in zip(*(part.column(c).to_pylist() for c in ("shard", "island", "lengths", "people"))):
            found = evolve([np.array(p) for p in people or []], np.array(lengths), (shard, island, epoch), capacity)
            out.append([p.tolist() for p in found])
            counts.append(int(found[0].max()) + 1)
        return pa.RecordBatch.from_arrays([part.column("shard"), part.column("island"), part.column("lengths"), pa.array(out, pa.list_(pa.list_(pa.int32()))),
                                           pa.array(counts, pa.int32())], ["shard", "island", "lengths", "people", "n_bins"])

    return mapped(state.select("shard", "island", "lengths", "people"), run,
                  "shard long, island int, lengths array<int>, people array<array<int>>, n_bins int")


def assign(pieces: DataFrame, capacity: int = CAPACITY, shard_size: int = SHARD) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32, row) with sequence_id and offset.

    Full pieces fill a sequence each. ``row`` must be unique; it deals the others evenly whatever the documents are. A shard
    is a bounded group: about ``shard_size`` small rows. An empty table gives an empty result.
    """
    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")})
    rest = pieces.where(F.col("length") < capacity)
    shards = max(1, round(rest.count() / shard_size))
    groups = kept(rest.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).groupBy("shard").agg(
        F.sort_array(F.collect_list(F.struct("row", "doc_id", "piece", "start", "length", "ids_crc32"))).alias("items")))
    state = groups.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
                          F.transform("items", lambda x: x["length"].cast("int")).alias("lengths"),
                          F.lit(None).cast("array<array<int>>").alias("people"))
    for epoch in range(EPOCHS):
        state = kept(_epoch(state.repartition(shards * ISLANDS, "shard", "island"), epoch, capacity))
        elite = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.slice("people", 1, 1).alias("guests"))
        if epoch + 1 < EPOCHS:
            state = state.join(elite, ["shard", "island"]).withColumn("people", F.concat("guests", "people"))
    best = state.groupBy("shard").agg(F.min_by(F.struct("lengths", F.col("people")[0].alias("bins")), F.struct("n_bins", "island")).alias("x"))

    def place(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for lengths, bins in zip(part.column("lengths").to_pylist(), part.column("bins").to_pylist()):
            at: dict[int, int] = {}
            row = []
            for n, b in zip(lengths, bins):
                row.append(at.get(b, 0))
                at[b] = row[-1] + n
            out.append(row)
        return pa.RecordBatch.from_arrays([part.column("shard"), part.column("bins"), pa.array(out, pa.list_(pa.int64()))], ["shard", "bins", "offsets"])

    placed = mapped(best.select("shard", "x.lengths", "x.bins"), place, "shard long, bins array<int>, offsets array<long>")
    rows = groups.join(placed, "shard").select("shard", F.explode(F.arrays_zip("items", "bins", "offsets")).alias("z")).select(
        "z.items.*", (F.col("shard") * (1 << 24) + F.col("z.bins")).alias("sequence_id"), F.col("z.offsets").alias("offset"))
    return rows.select(*full.columns).unionByName(full)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, shard_size: int = SHARD) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every whole text.

    A null or empty text is the closing id alone. A null doc_id stays null; repeated rows are packed each. Other columns are
    not read.
    """
    return assign(kept(tokenise(docs, vocabulary, capacity)), capacity, shard_size).drop("row")
