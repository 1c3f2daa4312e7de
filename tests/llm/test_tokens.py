"""Tokenizers against their libraries; packing against its rules."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from runtally.llm import packing, piece_bpe, tokens
from tests.llm.cases import awkward, empty

CODEC = piece_bpe.PieceBpe(public_tokenizers.path(piece_bpe.VOCABULARY))
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})
JSON = packing.JsonBpe(public_tokenizers.path(packing.VOCABULARY))
SIGNS = " \n\t's're.,;:!? 　\x1c\x85éñ中abcABC12½ªǅ-_=🎉́\r\x00"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(SIGNS, max_size=30)), max_size=5))
def test_ids_equal_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [x.tolist() for x in CODEC.encode(texts)] == [TIKTOKEN.encode_ordinary(t) for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in JSON.encode(texts)] == [x.ids for x in JSON.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_special_names_are_read_as_the_library_does():
    texts = ["a<|endoftext|>b c", " <|endoftext|> x", "plain words"]
    assert [np.frombuffer(x, "<u4").tolist() for x in JSON.encode(texts)] == [JSON.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 50)
    texts = [f"w{i} word{i}, " + "y" * 100 for i in range(400)]
    for at in range(0, 400, 8):
        assert [x.tolist() for x in CODEC.encode(texts[at:at + 8])] == [TIKTOKEN.encode_ordinary(t) for t in texts[at:at + 8]]
        assert len(CODEC.memo) <= 50 and not any(len(x) > tokens.LONG for x in CODEC.memo)


def test_words_are_learned_once_whatever_signs_and_line_ends_are_around():
    own, words = packing.JsonBpe(public_tokenizers.path(packing.VOCABULARY)), [f"w{chr(97 + i % 26)}x{'yz'[i // 26]}" for i in range(40)]
    texts = [f"x {a}{sign}{b} it's ({a}) {b}!?" for a in words for b in words for sign in (".\n", ", ", "-", "\n\n", " \n ", "'", "\t")]
    for at in range(0, len(texts), 256):
        part = texts[at:at + 256]
        assert own.encode(part) == own._encode(part)
    assert len(own.memo) < 300


@pytest.mark.parametrize("token, apart", [("aĠ", True), ("©Ġ", True), ("ĠÂłĠ", False)])
def test_words_are_not_joined_if_a_merge_could_join_them(tmp_path, token, apart):
    vocabulary, merges = {c: i for i, c in enumerate(piece_bpe.byte_chars())}, []
    for end in range(2, len(token) + 1):
        vocabulary[token[:end]] = len(vocabulary)
        merges.append((token[:end - 1], token[end - 1]))
    tokenizer = Tokenizer(models.BPE(vocabulary, merges))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tokenizer.save(str(tmp_path / "t.json"))
    own = packing.JsonBpe(str(tmp_path / "t.json"))
    texts = ["x a b a é a b é c", " \xa0 \xa0 a à b"]
    assert (own.joined == 1) == apart
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_json_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 50)
    own = packing.JsonBpe(public_tokenizers.path(packing.VOCABULARY))
    texts = [f"w word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwx'[i // 100]}, " + "y" * 100 for i in range(400)]
    for at in range(0, 400, 8):
        assert own.encode(texts[at:at + 8]) == own._encode(texts[at:at + 8])
        assert len(own.memo) <= 50 and not any(len(x) > tokens.LONG for x in own.memo)


def test_parts_are_learned_once_and_the_latest_stay(monkeypatch):
    own, learned = packing.JsonBpe(public_tokenizers.path(packing.VOCABULARY)), []
    learn = own._learn_parts
    monkeypatch.setattr(own, "_learn_parts", lambda new: learned.extend(new) or learn(new))
    texts = ["the cat, the dog", "the dog.the cat  x \n y", "a\x00 b.", "\x01 c", "", " the"]
    for _ in range(2):
        assert own.encode(texts) == own._encode(texts)
    assert len(learned) == len(set(learned))
    monkeypatch.setattr(tokens, "MEMO", 50)
    for i in range(60):
        part = [f"the cat, n{'abcdefgh'[i % 8]}{'klmnopqr'[i // 8]}x"]
        assert own.encode(part) == own._encode(part)
        assert len(own.words) <= 50
    assert learned.count("the") == 1


def test_digests(spark):
    df = awkward(spark, "ids key n_tokens")
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in piece_bpe.digests(df).collect()), key=str)
    want = []
    for r in df.collect():
        ids = TIKTOKEN.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert piece_bpe.digests(empty(spark)).count() == 0


def test_round_trip(spark):
    df = awkward(spark).where("doc_id is not null")
    back = piece_bpe.decode_documents(piece_bpe.encode_documents(df))
    assert sorted((r["doc_id"], bytes(r["bytes"]).decode()) for r in back.collect()) == sorted((r["doc_id"], r["text"] or "") for r in df.collect())


def check_packing(df, docs, capacity, tokenizer):
    rows = df.collect()
    assert all(r["length"] <= capacity for r in rows)
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    want = {}
    for key, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END]
        first, at = len(ids) % capacity or capacity, 0
        cuts = [min(first, len(ids))] + [capacity] * ((len(ids) - first) // capacity)
        for k, n in enumerate(cuts):
            want.setdefault(key, []).append((k, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes())))
            at += n
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    return len(by_sequence), -(-sum(r["length"] for r in rows) // capacity)


def test_pack(spark):
    df = awkward(spark, "shard row bins")
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    n, least = check_packing(packing.pack(df, capacity=64), [(r["doc_id"], r["text"]) for r in df.collect()], 64, tokenizer)
    assert n <= least + 2
    assert packing.pack(empty(spark)).count() == 0


def test_islands_beat_plain_best_fit():
    rng = random.Random(5)
    sizes = np.array([rng.randint(300, 900) for _ in range(400)])
    bins, frees = np.full(len(sizes), -1), []
    packing.best_fit(sizes.tolist(), np.argsort(-sizes, kind="stable").tolist(), bins, frees, 2048)
    people = packing.evolve([], sizes, (1, 2, 3))
    again = packing.evolve([], sizes, (1, 2, 3))
    assert [p.tolist() for p in people] == [p.tolist() for p in again]
    for p in people:
        assert np.bincount(p, sizes).max() <= 2048 and set(p) == set(range(p.max() + 1))
    assert people[0].max() + 1 <= len(frees)
    child = packing.cross(people[0], people[1], sizes, np.random.default_rng(1), 2048)
    assert np.bincount(child, sizes).max() <= 2048 and (child >= 0).all()
