"""Byte-level BPE through a sentencepiece model written straight from the vocabulary.

The model is serialised, not trained: every token of a rank file becomes a piece whose bytes are mapped one to one to
characters, its score is the negative rank, and normalisation is the identity. Pre-tokens are encoded one by one; ids are
decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from runtally.llm.rows import mapped, texts
from runtally.llm.tokens import Memo

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: Field numbers and types of the sentencepiece model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 4, 40, 41, 42, 43
BPE = 2
NAME, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 1, 3, 4, 5


def byte_chars() -> list[str]:
    """A printable character for each byte: itself if printable Latin-1, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model in which the id of a piece is its rank; the unknown piece comes last."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    chars = byte_chars()

    def piece(name: str, score: float, kind: int) -> bytes:
        score_field = _varint(SCORE << 3 | 5) + struct.pack("<f", score)
        return _block(PIECES, _block(PIECE, name.encode()) + score_field + _number(KIND, kind))

    body = [piece("".join(chars[b] for b in token), -float(rank), NORMAL) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    body.append(piece("<unk>", 0.0, UNKNOWN))
    trainer = [(MODEL_TYPE, BPE), (VOCAB_SIZE, len(body)), (UNK_ID, len(ranks)), (BOS_ID, -1), (EOS_ID, -1), (PAD_ID, -1)]
    body.append(_block(TRAINER, b"".join(_number(*x) for x in trainer)))
    body.append(_block(NORMALIZER, _block(NAME, b"identity") + b"".join(_number(x, 0) for x in (DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES))))
    return b"".join(body)


class PieceBpe:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.pattern = regex.compile(pattern)
        chars = byte_chars()
        self.to_chars = dict(enumerate(chars))
        back = {c: b for b, c in enumerate(chars)}
        self.token_bytes = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(self.ranks))]
        self.one_token = {t: struct.pack("<I", i) for t, i in self.ranks.items()}
        self.token_names = [str(i) for i in range(len(self.ranks))]
        self.memo = Memo(self._pieces)

    def _pieces(self, parts: list[str]) -> list[bytes]:
        """Ids of pieces as little-endian 32-bit numbers; a pre-token that is a token itself is not cut further."""
        tokens = [[t.encode() for t in self.pattern.findall(x)] for x in parts]
        new = list(set().union(*tokens).difference(self.ranks)) if tokens else []
        ids = self.model.encode([t.decode("latin-1").translate(self.to_chars) for t in new], num_threads=1) if new else []
        known = {t: np.array(x, "<u4").tobytes() for t, x in zip(new, ids)}
        one = self.one_token
        return [b"".join([known[t] if t in known else one[t] for t in x]) for x in tokens]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.memo.texts(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> PieceBpe:
    """The codec of a worker, built once."""
    return PieceBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` array<int> of every whole text (null: no ids, as for an empty text); other columns are left out."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        ids = [x.astype("i4") for x in c.encode(texts(batch))]
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return mapped(docs.select(docs[key].alias("key"), docs[text].alias("text")), encode,
                  f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str | None = None, key: str = "doc_id") -> DataFrame:
    """``key``, ``bytes`` of every array of ids; null ids give null."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        out = [None if ids is None else c.decode(ids) for ids in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], [key, "bytes"])

    return mapped(encoded.select(encoded[key].alias("key"), "ids"), decode,
                  f"`{key}` {encoded.schema[key].dataType.simpleString()}, bytes binary")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, one row per input row.

    Each text is encoded and its ids are decoded in one pass without a shuffle. A null or empty text has no ids; repeated rows
    give repeated results; a null doc_id stays null; other columns are not read.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        n, ids_sha, decoded_sha = [], [], []
        for found in c.encode(texts(batch)):
            ids = found.tolist()
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(c.token_names.__getitem__, ids)).encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                                           pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), digest,
                  "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
