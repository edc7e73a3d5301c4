"""Packing by concatenate and cut.

First pass: every text is encoded once and its ids go, two bytes each where they fit, to a table on shared files, with
the number of tokens. Offsets: documents are ordered by (block, doc_id), a block being a hash range of ids; totals per
block give each block's start by a prefix sum over few rows, and a running sum inside a block gives each
document's start in the one long stream. Second pass: the stream is cut every ``window`` tokens; a document
that crosses a cut becomes several pieces, so each sequence but the last is full.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .bpe_codec import byte_chars, serialise

WINDOW, END_ID = 4096, 2
#: Chunks of text that a worker keeps before it starts anew, and the characters of the longest that it keeps beyond a batch.
KEEP, LONG = 500_000, 64
#: Blocks of documents for the prefix sums, by shuffle partition; a block's rows (id and count only) are summed by one task.
BLOCKS = 4


class WordEncoder:
    """Ids by a tokenizers file that lower-cases, drops white space and encodes each word alone, its end marked.

    Its normaliser (composition, lower case by character) is applied here and texts are cut at white space. The ids of
    a chunk do not depend on its neighbours, so each distinct one is encoded once a worker; a batch of texts is
    cut, coded by chunk and laid out again as arrays. New words go through a sentencepiece model made from the
    vocabulary, in which a word's last character has a form of its own. It merges by rank like the library, as every
    token of such a vocabulary is what its own characters merge to. Special strings inside a text are taken out first,
    as the library does.
    """

    #: Fixed value: the splitter of the vocabulary file.
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: What ends a word's last piece in the file, and by how much the last character is moved in the model.
    END, FAR = "</w>", 0x400

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        names = {i: t for t, i in spec["model"]["vocab"].items() if t not in self.special}
        last = lambda t: t[: -len(self.END) - 1] + chr(ord(t[-len(self.END) - 1]) + self.FAR)
        pieces = [names.get(i, f"\ue000{i}") for i in range(max(names) + 1)]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise([last(t) if t.endswith(self.END) else t for t in pieces]))
        self.table = dict(enumerate(byte_chars()))
        self.find = regex.compile(self.WORDS).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # these four count as white space when cutting, and as signs in the library
        self.odd = regex.compile("[\x1c-\x1f]").search
        self.chunks: dict[str, bytes] = {"": b""}
        self.passing: list[str] = []

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word."""
        mapped = [w.encode("utf-8").decode("latin-1").translate(self.table) for w in words]
        done = self.model.encode([m[:-1] + chr(ord(m[-1]) + self.FAR) for m in mapped], num_threads=1)
        return [array("I", ids).tobytes() for ids in done]

    def _learn(self, new: list[str]) -> None:
        known = self.chunks
        self.passing += [c for c in new if len(c) > LONG]
        parts = {c: (c,) if c.isalpha() else (c[:-1], c[-1]) if c[-1] in ".," and c[:-1].isalpha() else self.find(c) for c in new}
        words = list({w for p in parts.values() for w in p}.difference(known))
        self.passing += [w for w in words if len(w) > LONG]
        known.update(zip(words, self._words(words)))
        known.update((c, b"".join([known[w] for w in p])) for c, p in parts.items() if len(p) != 1 or p[0] != c)

    def _plain(self, text: str) -> str:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.chunks) > KEEP:
            self.chunks = {"": b""}
        plain = [i for i, t in enumerate(texts) if "<|" not in t and not self.odd(t)]
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(plain, self._many([self._plain(texts[i]) for i in plain])):
            out[i] = ids
        for i in set(range(len(texts))).difference(plain):
            pieces = self.cut.split(texts[i]) if self.cut else [texts[i]]
            out[i] = b"".join(array("I", [self.special[p]]).tobytes() if k % 2 else self._one(self._plain(p)) for k, p in enumerate(pieces))
        for c in self.passing:
            self.chunks.pop(c, None)
        self.passing.clear()
        return out

    def _one(self, text: str) -> bytes:
        found = self.find(text)
        self._learn(list(set(found).difference(self.chunks)))
        return b"".join([self.chunks[w] for w in found])

    def _many(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        cut = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        coded = cut.values.dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if new := set(names).difference(self.chunks):
            self._learn(list(new))
        stored = [self.chunks[c] for c in names]
        pool = np.frombuffer(b"".join(stored), dtype="<u4")
        size = np.fromiter(map(len, stored), dtype=np.int64, count=len(stored)) // 4
        begin, length = (np.cumsum(size) - size)[codes], size[codes]
        after = np.cumsum(length)
        ids = pool[np.repeat(begin - (after - length), length) + np.arange(after[-1] if len(after) else 0)]
        edges = np.concatenate([[0], after])[cut.offsets.to_numpy()]
        return [ids[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encoded(df: DataFrame, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (binary, little-endian, two bytes an id if all fit), doc_tokens; the end id is the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared.sole(encoder)
        own = encoder(path or public_tokenizers.path("word_bpe_49k.json"))
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts = batch["_text"].tolist()
            ids = [np.frombuffer(x + end, dtype="<u4") for i in range(0, len(texts), 1024) for x in own.encode_all(texts[i : i + 1024])]
            small = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else b"\x00\x00" + x.tobytes() + b"\x00" for x in ids]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": small, "doc_tokens": [len(x) for x in ids]})

    return shared.exact(df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), run, "doc_id long, ids binary, doc_tokens long", "doc_id")


def unpacked(ids: bytes, n: int) -> np.ndarray:
    """The ids of one document as written by ``encoded``."""
    return np.frombuffer(ids, dtype="<u2") if len(ids) == 2 * n else np.frombuffer(ids[2:-1], dtype="<u4")


def offsets(spark: SparkSession, sizes: DataFrame) -> DataFrame:
    """(doc_id, doc_tokens) with ``begin``, the tokens before the row in the stream: two prefix sums.

    The stream's order is (block, doc_id, doc_tokens). Rows that repeat doc_id and size are told apart by ``copy``,
    numbered from 1.
    """
    blocks = BLOCKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocked = sizes.select("doc_id", "doc_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("_block"))
    inside = Window.partitionBy("_block").orderBy("doc_id", "doc_tokens").rowsBetween(Window.unboundedPreceding, -1)
    copy = Window.partitionBy("_block", "doc_id").orderBy("doc_tokens")
    totals = blocked.groupBy("_block").agg(F.sum("doc_tokens").alias("_total"))
    # a few rows a partition, whatever the input: one task, and small enough to send to all
    starts = totals.select("_block", F.coalesce(F.sum("_total").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    placed = blocked.withColumn("_in", F.coalesce(F.sum("doc_tokens").over(inside), F.lit(0))).withColumn("copy", F.row_number().over(copy))
    return placed.join(F.broadcast(starts), "_block").select("doc_id", "copy", (F.col("_start") + F.col("_in")).alias("begin"))


def pack(spark: SparkSession, df: DataFrame, window: int = WINDOW, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the packed sequences: doc_id, start, length, ids (array<int>), doc_tokens, sequence_id, offset.

    Null texts count as empty and hold the end id alone; texts of any length are packed whole. Documents lie in the stream by a hash of
    their ids, then by id and size; of rows that tie in all three any may come first. Rows that repeat an id are packed each, those
    without one beside each other. Columns besides the two are not looked at. An empty table gives no piece.
    """
    return _cut(spark, df, window, path, end_id, id_col, text_col, digest=False)


def _cut(spark, df, window, path, end_id, id_col, text_col, digest: bool) -> DataFrame:
    shared.fresh(df, id_col, text_col)
    held = shared.table(spark, encoded(df, path, end_id, id_col, text_col), "token-ids")
    sizes = held.select("doc_id", "doc_tokens")
    where = offsets(spark, sizes).select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), "begin")
    if sizes.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = held.join(where, F.col("doc_id").eqNullSafe(F.col("_id")))
    else:
        numbered = held.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_tokens", "ids")))
        rows = numbered.join(where, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")))
    rows = rows.select("doc_id", "ids", "doc_tokens", "begin")
    content = "ids_crc32 long" if digest else "ids array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for doc, ids, n, begin in batch[["doc_id", "ids", "doc_tokens", "begin"]].itertuples(index=False, name=None):
                values = unpacked(ids, n).astype("<u4")
                at = 0
                while at < n:
                    offset = (begin + at) % window
                    length = min(n - at, window - offset)
                    piece = values[at : at + length]
                    out.append((doc, at, length, zlib.crc32(piece.tobytes()) if digest else piece.astype("int32"), n, (begin + at) // window, offset))
                    at += length
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "_content", "doc_tokens", "sequence_id", "offset"]).rename(columns={"_content": content.split()[0]})

    return shared.exact(rows, run, f"doc_id long, start long, length long, {content}, doc_tokens long, sequence_id long, offset long", "doc_id")


def pieces(spark: SparkSession, df: DataFrame, window: int = WINDOW, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``pack``, with ids_crc32 in place of the ids."""
    return _cut(spark, df, window, path, end_id, id_col, text_col, digest=True)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pieces(spark, docs)
