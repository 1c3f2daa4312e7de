"""Aligned tokens against both libraries and a plain walk over byte offsets."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from runtally.llm import alignment
from tests.llm.cases import awkward, empty, prose

PATHS = (public_tokenizers.path(alignment.BYTE_BPE), public_tokenizers.path(alignment.PIECE_BPE))
OWN = alignment.Aligner(*PATHS)
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
VOCABULARY = {i: t for t, i in json.load(open(PATHS[0], encoding="utf-8"))["model"]["vocab"].items()}
SYMBOLS = alignment._byte_symbols()
SIGNS = " \n\t\r's.,;:)({}éñ中文abcABC12½=🎉́ \x1c\x85▁<>|"


def b_bytes(i: int) -> bytes:
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def walk(text: str | None):
    """Groups of a text, by walking both token lists from one common end to the next."""
    if not text:
        return []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    wa, wb = [bytes(SYMBOLS[c] for c in VOCABULARY[i]) for i in a], [b_bytes(i) for i in b]
    if b"".join(wa) != (" " + text).encode() or b"".join(wb) != (" " + text).encode():
        return []
    ends_a, ends_b = ([*accumulate(map(len, w))] for w in (wa, wb))
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = i, j
        while i < len(a) and ends_a[i] <= end:
            i += 1
        while j < len(b) and ends_b[j] <= end:
            j += 1
        groups.append((a[x:i], b[y:j]))
    return groups


def brute(rows):
    """The report of (doc_id, text) rows."""
    all_groups, counts = [walk(t) for _, t in rows], Counter()
    for g in all_groups:
        counts.update({(x, y) for a, b in g for x in a for y in b})
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for (d, _), g in zip(rows, all_groups):
        links = Counter()
        for a, b in g:
            ca, cb = Counter(a), Counter(b)
            for x, n in ca.items():
                for y, m in cb.items():
                    links[x, y] += n * m
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(links.values()), sum(n for (x, y), n in links.items() if counts[x, y] == top[x]),
                    sum(n * counts[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(SIGNS, max_size=30), st.text(" \r\n;)a", max_size=12)), max_size=5))
def test_groups_equal_a_walk_over_whole_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    numbers, chunks = OWN.documents(texts)
    for t, n in zip(texts, numbers):
        listed = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in walk(t))
        assert ";".join(chunks.groups[k] for k in n.tolist()) == listed


def test_report_equals_brute_force(spark):
    rng = random.Random(3)
    plain = [(i, prose(rng.randrange(40), rng.randrange(1, 90))) for i in range(120)]
    odd = [(200, "x" * 3000), (201, "a▁b"), (202, "<|endoftext|> </s> <0x41>"), (203, " lead"), (204, "trail "), (205, "a\r\nb;\r c"), (206, "\n\n"), (207, "中文，没有空格。" * 40),
           (None, "null key here"), (5, "same key again"), (208, None), (209, "")]
    rows = plain + odd
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in alignment.report(df).collect()), key=str) == brute(rows)


def test_awkward_rows_and_clashing_columns(spark):
    df = awkward(spark, "key pair block n_a count")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in alignment.report(df).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert alignment.report(empty(spark)).count() == 0


def test_align_gives_the_groups(spark):
    df = awkward(spark, "groups")
    got = sorted(((r["doc_id"], [(g["a"], g["b"]) for g in r["groups"]]) for r in alignment.align(df).collect()), key=str)
    assert got == sorted(((r["doc_id"], [(list(a), list(b)) for a, b in walk(r["text"])]) for r in df.collect()), key=str)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "MEMO", 50)
    own = alignment.Aligner(*PATHS)
    for at in range(0, 200, 8):
        texts = [f"w{i} word{i}, " + "y" * 100 for i in range(at, at + 8)]
        numbers, chunks = own.documents(texts)
        assert [";".join(chunks.groups[k] for k in n.tolist()) for n in numbers] == [
            ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in walk(t)) for t in texts]
        assert len(chunks.number) <= 50 + 3 * 8
