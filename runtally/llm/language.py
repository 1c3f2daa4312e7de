"""Language by compression: a text belongs to the language whose raw-content dictionary makes it smallest."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from runtally.llm.rows import mapped, remainder, steps, texts

#: Bound of the learning sample for each language: distinct texts, and SAMPLE * SHARE characters of their lines, a like number of
#: each text. The driver reads those, and before them an expected number of twice SAMPLE hashes.
SAMPLE, SHARE = 300, 700
#: Compression level, shortest match, and bytes that are encoded together. Long texts are encoded in blocks, all of them.
LEVEL, MIN_MATCH, BLOCK = 6, 3, 4096
#: A text of at least ENOUGH bytes is rejected if the best dictionary saves less than MARGIN of the second best size.
ENOUGH, MARGIN = 64, 0.004
UNKNOWN = "und"

_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case words between single spaces; digits and signs go."""
    return _NO_LETTERS.sub(" ", text.lower()).strip().encode()


@dataclass(frozen=True)
class Languages:
    """Dictionaries by language, the language with most learning documents first."""

    names: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def some_lines(text: str, most: int, seed: int) -> str:
    """Distinct lines from anywhere in a whole text, with their line ends at most ``most`` characters; lines are dealt by hash.

    Lines longer than SHARE are cut into several first.
    """
    own = list(dict.fromkeys(x[i:i + SHARE] for x in text.split("\n") for i in range(0, max(len(x), 1), SHARE)))
    kept = []
    for i in sorted(range(len(own)), key=lambda i: xxhash.xxh3_64_intdigest(own[i], seed=seed)):
        if most <= 0:
            break
        kept.append((i, own[i][:most]))
        most -= len(own[i]) + 1
    return "\n".join(x for _, x in sorted(kept))


def learn(docs: DataFrame, use: Column, lang: str = "lang", text: str = "text") -> Languages:
    """Dictionaries from the rows for which ``use`` holds and whose language and text are not null.

    Counts cover all those rows. Distinct texts are counted and drawn by their hash, so equal texts count once whatever their
    number; lines come from the whole of a drawn text, and those that several languages share are left out of all of them.
    """
    rows = docs.where(use).select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text <> ''")
    rows = rows.withColumn("h", F.xxhash64("text"))
    distinct = rows.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["lang"]: (r["n"], r["d"]) for r in distinct.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).collect()}
    counts = sorted(((name, n) for name, (n, _) in sizes.items()), key=lambda x: (-x[1], x[0]))
    if not counts:
        return Languages((), ())
    share = F.create_map(*[F.lit(x) for name, (_, d) in sizes.items() for x in (name, min(1.0, 2 * SAMPLE / d))])
    drawn: dict[str, list[int]] = {name: [] for name, _ in counts}
    for r in distinct.where((F.col("h") / F.lit(2.0**64) + 0.5) <= share[F.col("lang")]).select("lang", "h").collect():
        drawn[r["lang"]].append(r["h"])
    chosen = [(name, h, SAMPLE * SHARE // min(len(own), SAMPLE)) for name, own in drawn.items() for h in sorted(own)[:SAMPLE]]

    def cut(batches):
        seen = set()
        for part in steps(batches):
            out = []
            for name, h, most, t in zip(*(part.column(c).to_pylist() for c in ("lang", "h", "most", "text"))):
                if (name, h) not in seen:
                    seen.add((name, h))
                    out.append((name, h, some_lines(t, most, h % 2**64)))
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["lang", "h", "lines"])

    few = rows.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "lang string, h long, most int")), ["lang", "h"]).select("lang", "h", "most", "text")
    found: dict[str, list[tuple[int, str]]] = {name: [] for name, _ in counts}
    for r in few.mapInArrow(cut, "lang string, h long, lines string").dropDuplicates(["lang", "h"]).collect():
        found[r["lang"]].append((r["h"], r["lines"]))
    lines = {name: list(dict.fromkeys(letters(x) for _, t in sorted(found[name]) for x in t.split("\n"))) for name, _ in counts}
    seen: dict[bytes, int] = {}
    for own in lines.values():
        for x in own:
            seen[x] = seen.get(x, 0) + 1
    names = [name for name, _ in counts]
    return Languages(tuple(names), tuple(b"\n".join(x for x in lines[name] if seen[x] == 1) for name in names))


@lru_cache(maxsize=4)
def _compressors(model: Languages) -> list[zstandard.ZstdCompressor]:
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_checksum=False, write_content_size=False, write_dict_id=False)
    out = []
    for raw in model.dictionaries:
        own = zstandard.ZstdCompressionDict(raw.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(compression_params=how)
        out.append(zstandard.ZstdCompressor(dict_data=own, compression_params=how))
    return out


def guess(text: str, model: Languages) -> tuple[str, float, bool]:
    """Language, relative margin over the second best, and whether the text is rejected.

    A text without letters is unknown with margin 0 and rejected, as is any text where nothing was learned. With equal sizes
    the language with more learning documents wins. With one language the margin is 1.
    """
    if not any(map(str.isalpha, text)) or not model.names:
        return UNKNOWN, 0.0, True
    raw = letters(text)
    blocks = [raw[i:i + BLOCK] for i in range(0, len(raw), BLOCK)] or [b""]
    sizes = [sum(len(c.compress(b)) for b in blocks) for c in _compressors(model)]
    if len(sizes) == 1:
        return model.names[0], 1.0, False
    best = int(np.argmin(sizes))
    second = min(s for i, s in enumerate(sizes) if i != best)
    margin = 1.0 - sizes[best] / second
    return model.names[best], margin, len(raw) >= ENOUGH and margin < MARGIN


def predict(docs: DataFrame, model: Languages, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, lang_pred, score, rejected for every row by its whole text; null text is unknown, other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most SAMPLE * SHARE characters a language

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [guess(t, shared.value) for t in texts(batch)]
        lang, score, rejected = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                                          [key, "lang_pred", "score", "rejected"])

    return mapped(docs.select(docs[key].alias("key"), docs[text].alias("text")), run,
                  f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Languages, text: str = "text") -> DataFrame:
    """The rows, with all their columns as they are, whose language is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        for batch in steps(batches):
            keep = [not guess(t or "", shared.value)[2] for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, folds: int = 4, out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document; the fold ``out`` is not learned from.

    Null or letterless text gives ``und`` and score 0; a null doc_id belongs to no fold and is not learned from; repeated rows
    give repeated results; an empty table gives an empty result.
    """
    fold = remainder(F.col("doc_id"), folds)
    model = learn(docs.select("doc_id", "lang", "text"), (fold != out) & (fold >= 0))
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select(
        "doc_id", (fold == out).alias("held_out"), "lang_pred", "score", "rejected")
