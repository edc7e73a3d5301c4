"""Byte-level BPE encoding and decoding through a sentencepiece model that is built from the ranks.

A rank file lists byte strings in the order of their merges. Each becomes a piece: its bytes mapped to one
printable character each, scored by its negative rank, so that the merge sentencepiece prefers is the one of the
lowest rank. The model proto is serialised here, with identity normalisation and no dummy prefix; the
unknown piece comes last, so a piece's id is its rank. Texts are split into pre-tokens by the pattern, each distinct
pre-token is encoded once a worker and kept; ids are decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Pre-tokens that a worker keeps, beyond which it starts anew, and the characters of the longest that it keeps beyond a text.
KEEP, LONG = 300_000, 64


def byte_chars() -> str:
    """One printable character for each byte: itself where Latin-1 prints it, else from U+0100 on, in byte order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in own else chr(next(spare)) for b in range(256))


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _field(number: int, kind: int, value) -> bytes:
    """A field of a protocol buffer: kind 0 a varint, 2 bytes, 5 a float."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    head = varint(number << 3 | kind)
    return head + (varint(value) if kind == 0 else struct.pack("<f", value) if kind == 5 else varint(len(value)) + value)


def serialise(texts: list[str]) -> bytes:
    """A sentencepiece ModelProto of type BPE; piece i is texts[i], scored -i; the unknown piece has the next id."""
    piece = lambda text, score, kind: _field(1, 2, _field(1, 2, text.encode()) + _field(2, 5, score) + _field(3, 0, kind))
    pieces = b"".join(piece(t, -float(i), 1) for i, t in enumerate(texts)) + piece("<unk>", 0.0, 2)
    trainer = _field(3, 0, 2) + _field(4, 0, len(texts) + 1) + _field(40, 0, len(texts))  # BPE, vocabulary size, id of <unk>
    normaliser = _field(1, 2, b"identity") + _field(3, 0, 0) + _field(4, 0, 0) + _field(5, 0, 0)  # no prefix, no trimming, no escapes
    return pieces + _field(2, 2, trainer) + _field(3, 2, normaliser)


class Codec:
    """Encodes and decodes by the ranks of one file."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        chars = byte_chars()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(["".join(chars[b] for b in t) for t in self.tokens]))
        self.find = regex.compile(pattern).findall
        self.table = dict(enumerate(byte_chars()))
        self.kept: dict[str, bytes] = {}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Every match of the pattern is encoded separately."""
        if len(self.kept) > KEEP:
            self.kept.clear()
        kept, out = self.kept, []
        for text in texts:
            found = self.find(text)
            if new := [t for t in dict.fromkeys(found) if t not in kept]:
                mapped = [t.encode("utf-8").decode("latin-1").translate(self.table) for t in new]
                for t, ids in zip(new, self.model.encode(mapped, num_threads=1)):
                    kept[t] = struct.pack(f"<{len(ids)}I", *ids)
            out.append(b"".join([kept[t] for t in found]))
            for t in new:
                if len(t) > LONG:
                    del kept[t]
        return out

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process and file."""
    return Codec(path, pattern)


def _mapped(df: DataFrame, id_col: str, text_col: str, path: str | None, pattern: str, schema: str, row: Callable) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern)
        for batch in batches:
            yield row(own, batch)

    return shared.exact(df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), run, schema, "doc_id")


def encode(df: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and ids array<int>, whole texts of any length, without special tokens. Null counts as empty, which has no ids.

    Of pairs of equal rank the left one merges first, as in the library. Rows that repeat are encoded each; columns besides the two are not looked at; an empty table gives an empty one.
    """
    shared.fresh(df, id_col, text_col)

    def row(own: Codec, batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": batch["doc_id"], "ids": [np.frombuffer(x, dtype="<u4").astype("int32") for x in own.encode_all(batch["_text"].tolist())]})

    return _mapped(df, id_col, text_col, path, pattern, "doc_id long, ids array<int>", row)


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of (doc_id, ids): doc_id and the decoded bytes. Null ids give null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
        for batch in batches:
            done = [None if x is None else own.decode(np.asarray(x, dtype="<u4").tobytes()) for x in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "bytes": done})

    return shared.exact(df.select("doc_id", "ids"), run, "doc_id long, bytes binary", "doc_id")


def digests(df: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, digest of the ids, digest of what they decode to; one pass, no array leaves the worker.

    Nulls, repeated rows, long texts, empty tables and further columns as for ``encode``.
    """
    shared.fresh(df, id_col, text_col)

    def row(own: Codec, batch: pd.DataFrame) -> pd.DataFrame:
        ids = own.encode_all(batch["_text"].tolist())
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [sha(x) for x in ids], "decoded_sha256": [sha(own.decode(x)) for x in ids]})

    return _mapped(df, id_col, text_col, path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
