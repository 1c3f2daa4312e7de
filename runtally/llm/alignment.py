"""Tokens of two tokenizers aligned by interval coalescing, with corpus-wide counts of linked ids."""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window, functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from runtally.llm.rows import saved, steps, texts

#: Vocabulary files of the two tokenizers.
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Chunks longer than this are aligned each time; others are remembered, this many at most in a Python worker. It starts anew as
#: well when long chunks have left this many characters behind.
LONG, MEMO, HELD = 64, 400_000, 32_000_000
#: The sign that the piece tokenizer has for a space; its own bytes do not come back.
BLANK = "\u2581"
#: Bytes of text whose documents share one block; a longer text is a block alone.
BLOCK = 12_000_000

_DOUBLE = re.compile(r"\s\s")


def _byte_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable bytes stand for themselves, others follow 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Chunks:
    """Aligned chunks of text by number: counts (tokens of a and b, groups, links), whether they align, groups as text, linked id pairs."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.held = 0
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.good = np.zeros(0, bool)
        self.offsets = np.zeros(1, np.int64)
        self.pairs, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, groups: list[str], counts: np.ndarray, good: np.ndarray, kinds: np.ndarray, pairs: np.ndarray, links: np.ndarray) -> None:
        """More chunks; ``kinds`` is the number of distinct pairs of each."""
        self.groups += groups
        self.counts, self.good = np.concatenate([self.counts, counts]), np.concatenate([self.good, good])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(kinds)])
        self.pairs, self.links = np.concatenate([self.pairs, pairs]), np.concatenate([self.links, links])


class Aligner:
    """Both tokenizers, and the chunks of text they have met.

    A text is cut where a white-space character follows another one. Neither tokenizer has a token across such a cut, so both end a
    token there, and a chunk can be encoded and aligned alone; sentencepiece has pieces that hold a carriage return behind a
    letter or sign, which is therefore no cut.
    """

    def __init__(self, byte_path: str, piece_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        symbols = _byte_symbols()
        vocabulary = json.load(open(byte_path, encoding="utf-8"))["model"]["vocab"]
        names = {i: bytes(symbols[c] for c in t) for t, i in vocabulary.items() if all(c in symbols for c in t)}
        self.a_bytes = [names.get(i, b"") for i in range(max(names) + 1)]
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(open(piece_path, "rb").read())
        proto.normalizer_spec.add_dummy_prefix = False  # the chunks bring their spaces
        self.b = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        pieces = range(self.b.get_piece_size())
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
        usual = [self.b_bytes[i].decode() for i in pieces if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        glue = sorted({c for p in usual for c in re.findall(r"\S(\s)", p)})
        held = "".join(map(re.escape, glue))
        self.chunk = re.compile(rf"\s*\S+(?:[{held}]\s*\S*)*|\s+" if glue else r"\s*\S+|\s+")
        self.splits = not set(glue) & {" ", "\n"}
        self.odd = re.compile(rf"\s\s|[{held}]") if glue else _DOUBLE
        self.a_len, self.b_len = (np.array([len(x) for x in v]) for v in (self.a_bytes, self.b_bytes))
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.glue = set(glue)
        self.chunks = Chunks()

    def cut(self, text: str) -> list[str]:
        """Names of the chunks of space + text; a name that does not start with white space stands for the chunk with a space before it."""
        if self.splits and not self.odd.search(" " + text):
            return text.replace("\n", " \n").split(" ")
        return [c[1:] if c[0] == " " and len(c) > 1 and not c[1].isspace() else c for c in self.chunk.findall(" " + text)]

    def encode(self, spelled: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both tokenizers for chunks, one after the other; chunks that end in white space stand alone."""
        parts, size = [[]], 0
        for s in spelled:
            if size > 20_000 or (parts[-1] and (parts[-1][-1][-1].isspace() or s[0] in self.glue)):
                parts.append([])
                size = 0
            parts[-1].append(s)
            size += len(s)
        texts = ["".join(p) for p in parts]
        out = []
        for ids in ([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode(texts, num_threads=1)):
            out.append(np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids))))
        return out[0], out[1]

    def learn(self, names: list[str]) -> None:
        """Encode chunks with both tokenizers and coalesce their byte ranges."""
        own = self.chunks
        spelled = [n if n[:1].isspace() else " " + n for n in names]
        good = np.array([BLANK not in s for s in spelled], bool)  # the only sign whose piece has other bytes
        chosen = [s for s, g in zip(spelled, good.tolist()) if g]
        raw = [s.encode() for s in chosen]
        a, b = self.encode(chosen) if chosen else (np.zeros(0, np.int64),) * 2
        whole = b"".join(raw)
        if b"".join([self.a_bytes[i] for i in a.tolist()]) != whole or b"".join([self.b_bytes[i] for i in b.tolist()]) != whole:
            raise ValueError("the vocabularies do not cover all bytes")
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        groups, counts, kinds, pairs, links = self.coalesce(a, b, sizes)
        every, n = np.zeros((len(names), 4), np.int64), np.zeros(len(names), np.int64)
        every[good], n[good] = counts, kinds
        listed = iter(groups)
        own.number.update(zip(names, range(len(own.groups), len(own.groups) + len(names))))
        own.add([next(listed) if g else "" for g in good.tolist()], every, good, n, pairs, links)

    def coalesce(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For chunks of these byte sizes, whose ids stand one after the other: groups as text, counts, number of distinct pairs; and
        all pairs (a * 2^32 + b) with the number of links of each.

        The tokens of both sides are sorted by start. Where a start reaches the running maximum of the ends before it, a group ends.
        """
        bounds = np.cumsum(sizes)
        ends = [np.cumsum(length[ids]) for ids, length in ((a, self.a_len), (b, self.b_len))]
        start, end = (np.concatenate(x) for x in zip(*((e - length[ids], e) for e, ids, length in zip(ends, (a, b), (self.a_len, self.b_len)))))
        ids, side = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((side, start))
        reach = np.maximum.accumulate(end[order])
        breaks = np.r_[True, start[order][1:] >= reach[:-1]][:len(order)]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(breaks) - 1
        of = np.searchsorted(bounds, start[order][breaks], "right")
        n_groups, g_a, g_b = len(of), group[:len(a)], group[len(a):]
        # groups as text: the ids of a, then those of b, in order
        listed = np.lexsort((side, group))
        before, after = listed[:-1], listed[1:]
        same = group[before] == group[after]
        sign = np.where(same, np.where(side[before] == side[after], 0, 1), np.where(of[group[before]] == of[group[after]], 2, 3))
        text = "".join(chain.from_iterable(zip([self.names[i] for i in ids[listed].tolist()], [",|;\n"[k] for k in sign.tolist()] + [""])))
        # within a group every id of one side is linked to every id of the other, as often as both occur
        (k_a, t_a), (k_b, t_b) = (np.unique(g << 32 | i, return_counts=True) for g, i in ((g_a, a), (g_b, b)))
        first_b = np.searchsorted(k_b >> 32, np.arange(n_groups + 1))
        left, right = gathered_runs(first_b, k_a >> 32)
        pair, times, at = (k_a[left] & 0xFFFFFFFF) << 32 | k_b[right] & 0xFFFFFFFF, t_a[left] * t_b[right], of[k_a[left] >> 32]
        by = np.lexsort((pair, at))
        pair, times, at = pair[by], times[by], at[by]
        new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (at[1:] != at[:-1])][:len(pair)])
        links = np.add.reduceat(times, new) if len(new) else times
        n = len(sizes)
        in_chunk = lambda g: np.bincount(of[g], minlength=n)
        counts = np.stack([in_chunk(g_a), in_chunk(g_b), np.bincount(of, minlength=n), np.bincount(at[new], links, n).astype(np.int64)], 1)
        return text.split("\n") if n else [], counts, np.bincount(at[new], minlength=n), pair[new], links

    def documents(self, batch: list[str]) -> tuple[list[np.ndarray], Chunks]:
        """The chunk numbers of every text, and what they stand for; none for texts that are empty or whose bytes do not come back."""
        if len(self.chunks.number) > MEMO or self.chunks.held > HELD:
            self.chunks = Chunks()
        own = self.chunks
        cuts = [self.cut(t) if t else [] for t in batch]
        number = own.number
        new = list(set(chain.from_iterable(cuts)).difference(number))
        if new:
            self.learn(new)
        at = np.fromiter(map(number.__getitem__, chain.from_iterable(cuts)), np.int64, sum(map(len, cuts)))
        stops = list(accumulate(map(len, cuts), initial=0))
        out = [at[a:b] for a, b in zip(stops, stops[1:])]
        if not own.good[at].all():
            out = [x if own.good[x].all() else x[:0] for x in out]
        for n in new:
            if len(n) > LONG:
                own.held += len(own.groups[number.pop(n)])
        return out, own


@lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def gathered_runs(offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the runs ``at`` of arrays cut by ``offsets``, one after the other: which run each place belongs to, and the place."""
    n = offsets[at + 1] - offsets[at]
    run = np.repeat(np.arange(len(at)), n)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + offsets[at][run]


def linked_pairs(numbers: list[np.ndarray], chunks: Chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document (its place), pair and number of links, by document and pair, of texts given by their chunks."""
    doc = np.repeat(np.arange(len(numbers)), [len(x) for x in numbers])
    at = np.concatenate([*numbers, np.zeros(0, np.int64)])
    used = np.flatnonzero(np.bincount(at, minlength=1))
    place = np.zeros(len(chunks.groups) + 1, np.int64)
    place[used] = np.arange(len(used))
    seen = np.sort(doc * max(1, len(used)) + place[at])
    new = np.flatnonzero(np.r_[True, seen[1:] != seen[:-1]][:len(seen)])
    times = np.diff(np.r_[new, len(seen)])
    doc, at = np.divmod(seen[new], max(1, len(used)))
    run, where = gathered_runs(chunks.offsets, used[at])
    kinds, code = np.unique(chunks.pairs[where], return_inverse=True)
    key = doc[run] * max(1, len(kinds)) + code
    order = np.argsort(key)
    key, links = key[order], (chunks.links[where] * times[run])[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
    doc, code = np.divmod(key[new], max(1, len(kinds)))
    return doc, kinds[code], np.add.reduceat(links, new) if len(new) else links


#: A block: counts of its documents, the distinct pairs of all of them with the number of documents that hold each, and per document
#: the places of its pairs in that list with the number of links.
BLOCKS = ("block long, doc_id array<long>, counts array<int>, groups_sha256 array<string>, pair array<long>, documents array<int>, "
          "held array<int>, place binary, links binary")


def blocks(docs: DataFrame, paths: tuple[str, str], key: str, text: str) -> DataFrame:
    """Aligned documents in blocks of about ``BLOCK`` bytes of text."""
    def packed(number: int, parts: list[tuple]) -> pa.RecordBatch:
        ids, counts, digests, held, pair, links = ([x for p in parts for x in p[i]] if i < 4 else np.concatenate([p[i] for p in parts]) for i in range(6))
        kinds, place, documents = np.unique(pair, return_inverse=True, return_counts=True)
        values = [number, ids, np.array(counts, np.int32).ravel(), digests, kinds, documents.astype(np.int32), np.array(held, np.int32), place.astype("<u4").tobytes(), links.astype("<u4").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

    def run(batches):
        from pyspark import TaskContext

        own, parts, size, number = aligner(*paths), [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in steps([batch]):
                words = texts(part)
                numbers, chunks = own.documents(words)
                counts = [chunks.counts[n].sum(0) for n in numbers]
                digests = [hashlib.sha256(";".join([chunks.groups[k] for k in n.tolist()]).encode()).hexdigest() if len(n) else "" for n in numbers]
                doc, pair, links = linked_pairs(numbers, chunks)
                parts.append((part.column("key").to_pylist(), counts, digests, np.bincount(doc, minlength=len(words)).tolist(), pair, links))
                size += sum(map(len, words))
                if size >= BLOCK:
                    yield packed(number, parts)
                    parts, size, number = [], 0, number + 1
        if parts:
            yield packed(number, parts)

    names = [c.split()[0] for c in BLOCKS.split(", ")]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text")).mapInArrow(run, BLOCKS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (a * 2^32 + b), count (documents that hold the pair linked), best (whether no pair of the same a has more)."""
    each = aligned.select(F.inline(F.arrays_zip("pair", "documents")))
    counted = each.groupBy("pair").agg(F.sum("documents").alias("count"))
    top = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counted.select("pair", "count", (F.col("count") == top).alias("best"))


def report(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    Tokens are those of space + text by the byte-level tokenizer and of text by the piece tokenizer. Null and empty texts, and those
    whose token bytes are not the text's, have no tokens: zeros and an empty digest. A row with a null key is reported like any other and
    counts as a document; rows that repeat a key or a text count once each. The counts of id pairs are those of the whole table;
    blocks ask for the counts of their own pairs only. Other columns are not read; an empty table gives an empty result.
    """
    paths = (byte_path or public_tokenizers.path(BYTE_BPE), piece_path or public_tokenizers.path(PIECE_BPE))
    aligned = saved(blocks(docs, paths, key, text))
    wanted = aligned.select("block", F.explode("pair").alias("pair"))
    known = wanted.join(pair_counts(aligned), "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pair", "count", "best"))).alias("known"))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r] for n in ("doc_id", "counts", "groups_sha256", "held", "place", "links", "count", "best")}
                held = row["held"].values.to_numpy().astype(np.int64)
                count, best = (row[c].values.to_numpy(zero_copy_only=False).astype(np.int64) if row[c].is_valid else np.zeros(0, np.int64) for c in ("count", "best"))
                place, links = (np.frombuffer(row[c].as_py(), "<u4").astype(np.int64) for c in ("place", "links"))
                doc = np.repeat(np.arange(len(held)), held)
                n = row["counts"].values.to_numpy().astype(np.int64).reshape(-1, 4)
                best_links, total = (np.zeros(len(held), np.int64) for _ in range(2))
                np.add.at(best_links, doc, best[place] * links)
                np.add.at(total, doc, count[place] * links)
                yield pa.RecordBatch.from_arrays([row["doc_id"].values, *[pa.array(n[:, i]) for i in range(4)], pa.array(best_links), pa.array(total), row["groups_sha256"].values],
                                                 ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    both = aligned.drop("pair", "documents").join(known, "block", "left").select("*", F.col("known.count").alias("count"), F.col("known.best").alias("best")).drop("known")
    return both.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and groups, an array of (a, b): the ids of both tokenizers that cover the same bytes, in order; empty without tokens."""
    paths = (byte_path or public_tokenizers.path(BYTE_BPE), piece_path or public_tokenizers.path(PIECE_BPE))

    def run(batches):
        own = aligner(*paths)
        for part in steps(batches):
            numbers, chunks = own.documents(texts(part))
            out = [[dict(zip("ab", ([int(i) for i in side.split(",")] for side in g.split("|")))) for k in n.tolist() for g in chunks.groups[k].split(";")] for n in numbers]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(out, kind)], ["doc_id", "groups"])

    ids = pa.list_(pa.int32())
    kind = pa.list_(pa.struct([("a", ids), ("b", ids)]))
    return docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text")).mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")
