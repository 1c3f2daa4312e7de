"""Secrets in whole texts: fixed forms, and runs of letters and digits that a battery of randomness tests finds random.

For each run the smallest encoding that holds its characters is inferred. A chi-squared statistic measures how evenly the
alphabet is used, a runs test and the serial correlation how the characters follow each other. A run is reported if it is far
more even than ordinary text of its length (text as the whole corpus uses these characters) and the three tests do not speak
against randomness. How small the probability under ordinary text must be is set, for each encoding and class of lengths, by the
false-discovery procedure of Benjamini and Hochberg over all runs of the corpus.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runtally.llm.rows import steps, texts

#: The given forms in the order that sorts ties, and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
ASSIGNED = 12

#: Words one of which every assignment holds, in lower case.
CLUES = ("passw", "secret", "token", "api")

#: Encodings from the smallest alphabet to the largest.
ENCODINGS = {
    "decimal": string.digits,
    "hex_lower": string.digits + "abcdef",
    "hex_upper": string.digits + "ABCDEF",
    "letters_lower": string.ascii_lowercase,
    "letters_upper": string.ascii_uppercase,
    "base32": string.ascii_uppercase + "234567",
    "base36_lower": string.digits + string.ascii_lowercase,
    "base36_upper": string.digits + string.ascii_uppercase,
    "letters": string.ascii_letters,
    "base62": string.digits + string.ascii_letters,
    "base64": string.digits + string.ascii_letters + "+/",
    "base64url": string.digits + string.ascii_letters + "-_",
}
#: Shortest run that is tested; share of false discoveries; level of the three tests; steps of -log10 p, and their number.
LEAST, FALSE, LEVEL, BINS, MOST = 20, 0.01, 0.001, 10, 3000

RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % LEAST)
#: Parts of a run between signs that only one of the two base64 alphabets has, and between signs of either.
PARTS = tuple(re.compile("[A-Za-z0-9%s]{%d,}" % (signs, LEAST)) for signs in ("+/", "_-", ""))
MASK = "[secret]"

_INDEX = {}
for _name, _alphabet in ENCODINGS.items():
    _INDEX[_name] = np.full(128, -1)
    _INDEX[_name][np.frombuffer(_alphabet.encode(), np.uint8)] = np.arange(len(_alphabet))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed forms, leftmost and not overlapping within a kind, in order."""
    found = []
    low = text.lower()
    if any(c in low for c in CLUES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def encoding_of(run: str) -> tuple[str, np.ndarray] | None:
    """The smallest encoding that holds a run, and its characters as numbers of the alphabet."""
    raw = np.frombuffer(run.encode(), np.uint8)
    for name in ENCODINGS:
        x = _INDEX[name][raw]
        if x.min() >= 0:
            return name, x
    return None


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def gamma_z(x: float, mean: float, variance: float) -> float:
    """The normal deviate of x under a gamma distribution (cube-root approximation)."""
    nu = 2 * mean * mean / variance
    return ((max(x, 0.0) / mean) ** (1 / 3) - (1 - 2 / (9 * nu))) / math.sqrt(2 / (9 * nu))


def battery(x: np.ndarray, k: int) -> tuple[float, float, float, float]:
    """Chi-squared statistic against an even use of k characters, and the probabilities of the three tests under randomness."""
    n = len(x)
    chi = float((np.bincount(x, minlength=k) ** 2).sum()) * k / n - n
    uneven = normal_tail(gamma_z(chi, k - 1, 2 * (k - 1)))
    up = x >= k / 2
    a, b = int(up.sum()), int(n - up.sum())
    if a and b:
        mean = 1 + 2 * a * b / n
        variance = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        runs = 2 * normal_tail(abs(1 + int((up[1:] != up[:-1]).sum()) - mean) / math.sqrt(variance))
    else:
        runs = 2.0 ** (1 - n)
    centred = x - x.mean()
    square = float((centred**2).sum())
    serial = 2 * normal_tail(abs(float((centred[1:] * centred[:-1]).sum()) / square + 1 / n) * math.sqrt(n)) if square else 0.0
    return chi, uneven, runs, serial


@dataclass(frozen=True)
class Ordinary:
    """How often ordinary text uses each ASCII character."""

    counts: tuple[int, ...]

    def probability(self, name: str, chi: float, n: int) -> float:
        """Probability that ordinary text of n characters of an encoding is as even as this statistic or more."""
        own = np.array([self.counts[ord(c)] for c in ENCODINGS[name]], float) + 1.0
        q, k = own / own.sum(), len(own)
        mean = float((q * (1 - q)).sum()) * k + n * float((q * q).sum()) * k - n
        variance = 4 * n * (float((q**3).sum()) * k * k - float((q * q).sum() * k) ** 2) + 2 * float((q * q).sum()) * k * k
        return normal_tail(-gamma_z(chi, max(mean, 1e-6), max(variance, 1e-6)))


def length_class(n: int) -> int:
    """Two classes for each doubling of the length."""
    return int(2 * math.log2(n))


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of every run, and of its parts between signs, as a secret may follow a path or a name."""
    found = []
    for m in RUN.finditer(text):
        found.append(m.span())
        if not m[0].isalnum():
            found += sorted({p.span() for form in PARTS for p in form.finditer(text, *m.span())} - {m.span()})
    return found


def tested(text: str, ordinary: Ordinary) -> list[tuple[int, int, str, int, int]]:
    """(start, end, encoding, class, step of -log10 p) of the runs and parts of runs that an encoding holds; the step is 0
    where one of the three tests speaks against randomness."""
    found = []
    for start, end in candidates(text):
        if (inferred := encoding_of(text[start:end])) is None:
            continue
        name, x = inferred
        chi, *three = battery(x, len(ENCODINGS[name]))
        p = ordinary.probability(name, chi, len(x)) if min(three) >= LEVEL / 3 else 1.0
        found.append((start, end, name, length_class(len(x)), min(MOST, int(-math.log10(max(p, 1e-300)) * BINS))))
    return found


@dataclass(frozen=True)
class Scan:
    """What the corpus says: ordinary characters, and the least step of -log10 p for each encoding and class of lengths."""

    ordinary: Ordinary
    least: dict[tuple[str, int], int]

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, str, int]]]:
        """Spans of the fixed forms, and (start, kind, end) of random runs that lie in none of those.

        Of a run and its parts only those are given that lie in no other one found random; two parts may overlap.
        """
        base = base_spans(text)
        ahead, reach, more = sorted((a, b) for a, _, b in base), -1, []
        ahead.reverse()
        hits = [(a, b, name) for a, b, name, size, step in tested(text, self.ordinary) if step >= self.least.get((name, size), MOST + 1)]
        for start, end, name in sorted(hits, key=lambda x: (x[0], -x[1])):
            while ahead and ahead[-1][0] <= start:
                reach = max(reach, ahead.pop()[1])
            if end > reach and not (more and end <= more[-1][2]):
                more.append((start, f"random_{name}", end))
        return base, more


def learn(docs: DataFrame, text: str = "text") -> Scan:
    """Character counts and false-discovery levels over all whole texts; both are tables of bounded size."""
    rows = docs.select(docs[text].alias("text"))

    def characters(batches):
        total = np.zeros(128, np.int64)
        for part in steps(batches):
            total += np.bincount(np.frombuffer("".join(texts(part)).encode(), np.uint8), minlength=256)[:128]
        yield pa.RecordBatch.from_arrays([pa.array(range(128), pa.int32()), pa.array(total)], ["code", "n"])

    counts = {r["code"]: r["n"] for r in rows.mapInArrow(characters, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()}
    ordinary = Ordinary(tuple(counts.get(i, 0) for i in range(128)))

    def histogram(batches):
        seen: dict[tuple[str, int, int], int] = {}
        for part in steps(batches):
            for t in texts(part):
                for _, _, *key in tested(t, ordinary):
                    seen[tuple(key)] = seen.get(tuple(key), 0) + 1
        columns = list(zip(*seen)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()),
                                          pa.array(seen.values(), pa.int64())], ["encoding", "size", "step", "n"])

    bins = rows.mapInArrow(histogram, "encoding string, size int, step int, n long").groupBy("encoding", "size", "step").agg(F.sum("n").alias("n")).collect()
    by: dict[tuple[str, int], dict[int, int]] = {}
    for r in bins:
        by.setdefault((r["encoding"], r["size"]), {})[r["step"]] = r["n"]
    least = {}
    for key, own in by.items():
        total, above = sum(own.values()), 0
        for step in sorted(own, reverse=True):
            above += own[step]
            if 10.0 ** (-step / BINS) <= FALSE * above / total:
                least[key] = step
    return Scan(ordinary, least)


def joined(spans: list[tuple[int, int | str, int]]) -> str:
    return ",".join(f"{k if isinstance(k, str) else KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", learned: Scan | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every whole text.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. A null or empty text has none; repeated
    rows give repeated results; a null key stays null; other columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learned or learn(docs, text))

    def run(batches):
        for part in steps(batches):
            out = []
            for t in texts(part):
                base, more = shared.value.spans(t)
                every = sorted([(a, k, "", b) for a, k, b in base] + [(a, len(KINDS), k, b) for a, k, b in more])
                out.append((*(sum(k == i for _, k, _ in base) for i in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(),
                            joined([(a, name or k, b) for a, k, name, b in every]), len(more)))
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                             [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text")).mapInArrow(
        run, f"`{key}` long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact_text(text: str, learned: Scan) -> str:
    """The text with every span, overlapping ones joined, replaced by a mask."""
    base, more = learned.spans(text)
    out, at = [], 0
    for start, _, end in sorted((a, str(k), b) for a, k, b in [*base, *more]):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", learned: Scan | None = None) -> DataFrame:
    """All rows and columns with secrets masked; ``n_chars``, if there, is counted anew where a text changes."""
    shared = docs.sparkSession.sparkContext.broadcast(learned or learn(docs, text))
    at, schema = docs.columns.index(text), docs.schema
    count = docs.columns.index(n_chars) if n_chars in docs.columns else None

    def run(batches):
        for part in steps(batches):
            before = part.column(at).to_pylist()
            after = [None if t is None else redact_text(t, shared.value) for t in before]
            columns = list(part.columns)
            columns[at] = pa.array(after, part.schema.field(at).type)
            if count is not None:
                old = part.column(count).to_pylist()
                columns[count] = pa.array([n if a == b else len(a) for n, a, b in zip(old, after, before)], part.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, schema)
