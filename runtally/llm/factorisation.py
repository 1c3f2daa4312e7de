"""Quality of documents by a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from runtally.llm.rows import mapped, remainder, texts

#: Word buckets; factors; bound of the learning sample in labelled rows, which the driver fits on.
BUCKETS, FACTORS, SAMPLE = 1 << 16, 8, 6000
EPOCHS, BATCH, RATE, DECAY, SEED = 8, 32, 0.05, 1e-5, 11

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_UPPER, _DIGIT, _SIGN = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"\d"), re.compile(r"[^\w\s]")
_MEMO = 300_000
_memo: dict[str, bytes] = {}

#: Structure and metadata, in this order, after the word buckets.
STRUCTURE = ("one", "upper", "digits", "signs", "spaces", "token_length", "long_tokens", "distinct_tokens", "top_token", "lines", "line_length",
             "repeated_lines", "ends_in_sign", "size", "declared_size")
WIDTH = BUCKETS + len(STRUCTURE)


def structure(text: str, tokens: list[str], counts: np.ndarray, declared: int | None) -> list[float]:
    """Values near 0 to 2 of the structure statistics and the metadata of a text; a declared size that is null counts as the size."""
    n, k = max(len(text), 1), max(len(tokens), 1)
    lines = text.split("\n")
    share = lambda pattern: len(pattern.findall(text)) / n
    size = np.log1p(len(text)) / 8
    return [1.0, share(_UPPER) * 4, share(_DIGIT) * 4, share(_SIGN) * 4, sum(map(text.count, " \n\t")) / n * 4, len(text) / k / 6,
            sum(len(t) > 12 for t in tokens) / k * 4, len(counts) / k, float(counts.max()) / k if len(counts) else 0.0,
            len(lines) / k * 8, min(np.log1p(n / len(lines)) / 6, 2.0), 1 - len(set(lines)) / len(lines),
            sum(x[-1:] in ".!?" for x in lines) / len(lines), size, size if declared is None else np.log1p(max(declared, 0)) / 8]


def features(texts: list[str], declared: list[int | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Feature numbers and values of whole texts: damped counts of hashed words and signs, scaled to length 1, and the structure."""
    words = [_TOKEN.findall(t) for t in texts]
    new = set().union(*words).difference(_memo)
    if len(_memo) + len(new) > _MEMO:
        _memo.clear()
        new = set().union(*words)
    _memo.update((w, (xxhash.xxh3_64_intdigest(w.lower()) % BUCKETS).to_bytes(4, "little")) for w in new)
    ids, values = [], []
    tail = np.arange(BUCKETS, WIDTH)
    for text, own, size in zip(texts, words, declared):
        found, counts = np.unique(np.frombuffer(b"".join(map(_memo.__getitem__, own)), "<u4"), return_counts=True)
        x = np.log1p(counts)
        ids.append(np.concatenate([found.astype(int), tail]))
        values.append(np.concatenate([x / max(np.sqrt((x * x).sum()), 1e-9), structure(text, own, counts, size)]))
    return ids, values


@dataclass
class Machine:
    """Weights of a fitted machine."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, ids: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
        """bias + w x + half the sum over the factors of (sum of v x) squared minus the sum of (v x) squared: linear in the features."""
        if not ids:
            return np.zeros(0)
        starts = np.r_[0, np.cumsum([len(i) for i in ids])[:-1]]
        flat, x = np.concatenate(ids), np.concatenate(values)
        vx = self.factors[flat] * x[:, None]
        first, second = np.add.reduceat(vx, starts), np.add.reduceat(vx * vx, starts)
        return self.bias + np.add.reduceat(self.linear[flat] * x, starts) + 0.5 * (first * first - second).sum(1)

    def scores(self, ids: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(ids, values), -30, 30)))


def fit(ids: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Stochastic gradient steps with a rate for each weight; both labels weigh the same. Without both labels the score is constant."""
    rng = np.random.default_rng(SEED)
    share = labels.mean() if len(labels) else 0.5
    machine = Machine(0.0, np.zeros(WIDTH), rng.normal(0, 0.05, (WIDTH, FACTORS)))
    if not len(labels) or not 0 < share < 1:
        machine.factors[:] = 0
        machine.bias = 8.0 * (2 * share - 1)
        return machine
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    seen_w, seen_v, seen_b = np.full(WIDTH, 1e-3), np.full((WIDTH, FACTORS), 1e-3), 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            some, x = [ids[r] for r in rows], [values[r] for r in rows]
            slope = (machine.scores(some, x) - labels[rows]) * weight[rows] / len(rows)
            lengths = [len(i) for i in some]
            starts = np.r_[0, np.cumsum(lengths)[:-1]]
            flat, x = np.concatenate(some), np.concatenate(x)
            pull = np.repeat(slope, lengths) * x
            v = machine.factors[flat]
            inner = np.repeat(np.add.reduceat(v * x[:, None], starts), lengths, axis=0)
            names, place = np.unique(flat, return_inverse=True)
            g_w, g_v = np.bincount(place, pull), np.zeros((len(names), FACTORS))
            np.add.at(g_v, place, pull[:, None] * (inner - v * x[:, None]))
            g_w += DECAY * machine.linear[names]
            g_v += DECAY * machine.factors[names]
            seen_w[names] += g_w**2
            seen_v[names] += g_v**2
            machine.linear[names] -= RATE * g_w / np.sqrt(seen_w[names])
            machine.factors[names] -= RATE * g_v / np.sqrt(seen_v[names])
            seen_b += slope.sum() ** 2
            machine.bias -= RATE * slope.sum() / np.sqrt(seen_b)
    return machine


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine fitted on at most ``sample`` labelled rows (doc_id, label), those whose hashed doc_id is least.

    Features are made where the documents lie; the driver gets those of the sample only. Null labels and ids are left out; an
    id with several labels counts with each.
    """
    few = labels.where("doc_id is not null and label in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample).collect()
    if not few:
        return fit([], [], np.zeros(0))
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r["doc_id"], int(r["label"])) for r in few], "doc_id long, label int")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, values = features(texts(part), part.column("n_chars").to_pylist())
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(ids, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64()))],
                                          ["doc_id", "label", "ids", "x"])

    found = mapped(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text", "n_chars"), run,
                   "doc_id long, label int, ids array<long>, x array<double>").limit(sample).toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    split = lambda name: [np.array(x.values) for x in found.column(name)]
    return fit(split("ids"), split("x"), found.column("label").to_numpy().astype(float))


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``key`` and score of every row by its whole text and its declared size."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, values = features(texts(part), part.column("n_chars").to_pylist())
        return pa.RecordBatch.from_arrays([part.column("key"), pa.array(shared.value.scores(ids, values))], [key, "score"])

    return mapped(docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"), docs[n_chars].cast("long").alias("n_chars")), run,
                  f"`{key}` long, score double")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of the fold ``out`` are not learned from.

    A null text counts as empty and is scored. A null doc_id belongs to no fold. Repeated rows give repeated results; other
    columns are not read. Without labels of both kinds the score is the same for all. An empty table gives an empty result.
    """
    fold = remainder(F.col("doc_id"), folds)
    learnable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where((fold != out) & (fold >= 0))
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("n_chars").cast("long").alias("n_chars"))
    scored = score(few, learn(few, learnable))
    return scored.select("doc_id", (fold == out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
