"""Token counts at every prefix of a text, by dynamic programming over its pre-tokens.

Inside a pre-token, the encoding of a prefix ends in exactly one token: the one whose own encoding and that of the
prefix before it fit together. So with last[i] and count[i] for the prefix of i bytes,

    last[i] = the token t that ends at i with last[i - len(t)] = nothing, or (last[i - len(t)], t) a stable pair
    count[i] = count[i - len(t)] + 1

A pair of tokens is stable when the merges leave it as it is; that is decided by walking back the merges of
both. The counts at all prefixes of each distinct pre-token are kept a worker; those of a text are the sums of its
pre-tokens' last counts, plus the counts inside each. A cut can change the split before it in three places only, which
``prefixes`` puts right: at the end of a white-space run, inside a contraction, inside a special string. So what is stored is exact at
every prefix, and the count of any truncation or the longest prefix within a budget is a look-up.

Whole tables are counted by chunks, the stretches between single spaces: the pattern never joins across a space before
a sign, so a chunk with the space before it counts alike in every text, and so does a text cut inside it. A
batch is cut into chunks and coded as arrays; a budget's answer is looked up in the one chunk in which the count passes it.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .bpe_codec import byte_chars

#: Pre-tokens, chunks and pairs that a worker keeps.
KEEP, KEEP_CHUNKS, KEEP_PAIRS = 300_000, 400_000, 1_000_000
#: Contractions of which a shorter prefix splits otherwise than they do.
SPLIT_LATE = ("'re", "'ve", "'ll")
#: Texts that are cut and coded at a time.
BLOCK = 2048


class PrefixCounter:
    """Counts by one tokenizers file of byte-level BPE without normaliser."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_chars())}
        raw = lambda piece: bytes(back[c] for c in piece)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.ids = {raw(piece): i for piece, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for at, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = at
            self.made.setdefault(whole, (left, right, at))
        # every end of a token -> its id, -1 if it is none itself
        self.tails = {t[-k:]: -1 for t in self.ids for k in range(1, len(t) + 1)} | self.ids
        special = sorted((x["content"] for x in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(pattern)
        self.blank = regex.compile(r"\s").match
        self.kept = shared.Kept(self.of, KEEP)
        self.chunks = shared.Kept(lambda chunk: sum([self.kept[w][-1] for w in self.pattern.findall(chunk)]), KEEP_CHUNKS)
        self.pairs: dict[tuple[int, int], bool] = {}

    def stable(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b, each a full encoding of its own, leaves the two apart.

        The last merge on the border that would come before both sides are whole decides; so the sides are taken
        apart, the later merge first, and each pair that then meets at the border is looked up.
        """
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        never = len(self.rank)
        left, right, until_left, until_right = a, b, never, never
        answer = True
        while True:
            met = self.rank.get((left, right), never)
            # it happens if its rank comes before the merges that use up either side; on a tie of ranks the left place goes first
            if met < until_right and met < until_left or met == until_right and met < until_left:
                answer = False
                break
            made_left, made_right = self.made.get(left), self.made.get(right)
            if made_left is None and made_right is None:
                break
            if made_right is None or made_left is not None and made_left[2] >= made_right[2]:
                left, until_left = made_left[1], made_left[2]
            else:
                right, until_right = made_right[0], made_right[2]
        if len(self.pairs) > KEEP_PAIRS:
            self.pairs.clear()
        self.pairs[a, b] = answer
        return answer

    def byte_counts(self, data: bytes, count: list[int], last: list[int]) -> None:
        """Add to count and last, which hold those of some prefix, the entries of the longer prefixes up to data itself."""
        pairs, tail = self.pairs, self.tails.get
        for i in range(len(count), len(data) + 1):
            j, ends = i - 1, []
            while j >= 0 and (token := tail(data[j:i])) is not None:
                if token >= 0:
                    ends.append((j, token))
                j -= 1
            while ends:  # the longest first
                j, token = ends.pop()
                if j == 0 or (fits := pairs.get((last[j], token))) or fits is None and self.stable(last[j], token):
                    last.append(token)
                    count.append(count[j] + 1)
                    break

    def learn(self, pieces: Iterable[str]) -> None:
        """Keep the counts of these pre-tokens. In order of their bytes, neighbours begin alike, and what they share is worked out once."""
        before, count, last = b"", [0], [-1]
        for data, piece in sorted((p.encode("utf-8"), p) for p in self.kept.lacking(pieces)):
            same, most = 0, min(len(data), len(before))
            while same < most and data[same] == before[same]:
                same += 1
            del count[same + 1 :], last[same + 1 :]
            self.byte_counts(data, count, last)
            self.kept.put(piece, self._held(piece, data, count))
            before = data

    def _held(self, piece: str, data: bytes, count: list[int]) -> bytes | array:
        found = [count[e] for e in accumulate(len(c.encode("utf-8")) for c in piece)] if len(data) != len(piece) else count[1:]
        return bytes(found) if max(found) < 256 else array("I", found)

    def of(self, piece: str) -> bytes | array:
        """Counts at the prefixes of 1, 2, ... code points of one pre-token; a byte each, if all fit."""
        data, count = piece.encode("utf-8"), [0]
        self.byte_counts(data, count, [-1])
        return self._held(piece, data, count)

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Ordinary stretches and special strings (True), in order."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        yield text[at:], False

    def _plain(self, part: str) -> list[int]:
        """Exact counts at the prefixes of a stretch without special strings."""
        out: list[int] = []
        kept, total, run = self.kept, 0, ""
        for piece in self.pattern.findall(part):
            counts = kept[piece]
            out += [total + c for c in counts] if total else counts
            if run and (end := self.blank(piece)):  # a cut behind the first sign leaves one run of white space
                out[-len(piece)] = total - kept[run][-1] + kept[run + end.group()][-1]
            elif piece in SPLIT_LATE:
                out[-2] = total + kept["'"][-1] + kept[piece[1]][-1]
            total += counts[-1]
            run = piece if piece.isspace() and self.blank(piece[-1]) else ""
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """The stored counts: entry i is the exact count at the prefix of i + 1 code points; the last is that of the text."""
        out, total, base, before = [np.zeros(0, dtype=np.int64)], 0, 0, ""
        for part, special in self.parts(text):
            if special:
                # a cut inside leaves ordinary text, split together with what stands before it from the last border on
                border = before.rfind(" ", 0, -1)
                border = border if border > 0 and not before[border + 1].isspace() else 0
                known = int(out[-1][border - 1]) if border else base
                inside = self._plain(before[border:] + part[:-1])[len(before) - border :]
                out.append(np.array([*(known + c for c in inside), total + 1], dtype=np.int64))
                total, before = total + 1, ""
                base = total
            elif part:
                out.append(np.array(self._plain(part), dtype=np.int64) + total)
                base, before, total = total, part, int(out[-1][-1])
        return np.concatenate(out)

    def count_at(self, text: str, n: int, stored: np.ndarray | None = None) -> int:
        """Exact count of the first n code points of text: read off what is stored, if it is given."""
        stored = self.prefixes(text) if stored is None else stored
        n = min(n, len(stored))
        return int(stored[n - 1]) if n > 0 else 0

    def longest_within(self, text: str, budget: int, stored: np.ndarray | None = None) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens: read off what is stored, if it is given."""
        stored = self.prefixes(text) if stored is None else stored
        fits = np.flatnonzero(stored <= budget)
        return int(fits[-1]) + 1 if len(fits) else 0

    def answers(self, texts: list[str], budget: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each text its count, and the code points of its longest prefix within the budget."""
        n, fits = np.zeros(len(texts), dtype=np.int64), np.array([len(t) for t in texts], dtype=np.int64)
        for i in range(0, len(texts), BLOCK):
            self._block(texts[i : i + BLOCK], budget, n[i : i + BLOCK], fits[i : i + BLOCK])
        return n, fits

    def _block(self, texts: list[str], budget: int, n: np.ndarray, fits: np.ndarray) -> None:
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = cut.values.dictionary_encode()
        names, codes, edges = coded.dictionary.to_pylist(), coded.indices.to_numpy(), cut.offsets.to_numpy()
        first = edges[:-1]
        spaced = [" " + c for c in names]
        split = {c: self.pattern.findall(c) for c in self.chunks.lacking(spaced)}
        self.learn(p for found in split.values() for p in found)
        made = {c: sum([self.kept[p][-1] for p in found]) for c, found in split.items()}
        for c, count in made.items():
            self.chunks.put(c, count)
        sizes = np.array([made[c] if c in made else self.chunks[c] for c in spaced], dtype=np.int64)[codes]
        sizes[first] = [self.chunks[names[c]] for c in codes[first].tolist()]  # a text's first chunk has no space before it
        lengths = pc.utf8_length(coded.dictionary).to_numpy().astype(np.int64)[codes] + 1
        lengths[first] -= 1
        after, places = np.cumsum(sizes), np.cumsum(lengths)
        # white space that goes on over the space between two chunks: such texts are counted as a whole, as are those with special strings
        blank_end = np.array([not c or c[-1].isspace() for c in names], dtype=bool)[codes]
        blank_end[first] &= lengths[first] > 0
        odd = np.array([not c or c[0].isspace() for c in names], dtype=bool)[codes]
        odd[1:] &= blank_end[:-1]
        odd[first] = False
        strange = np.add.reduceat(odd, first)
        for i, (text, a, b) in enumerate(zip(texts, first.tolist(), edges[1:].tolist())):
            if strange[i] or self.special and self.special.search(text):
                stored = self.prefixes(text)
                n[i], fits[i] = stored[-1], self.longest_within(text, budget, stored)
                continue
            base, start = int(after[a] - sizes[a]), int(places[a] - lengths[a])
            n[i] = after[b - 1] - base
            if n[i] > budget:
                k = a + int(np.searchsorted(after[a:b], base + budget, side="right"))  # the chunk in which the count passes the budget
                place, known = int(places[k] - lengths[k]) - start, int(after[k] - sizes[k]) - base
                inside = np.array(self._plain(text[place : place + int(lengths[k]) + 1]))  # with the space behind it, which may join a run of white space
                if place and self.blank(text[place - 1]):
                    run = (self.pattern.findall(names[codes[k - 1]]) or [" "])[-1]
                    inside[0] = self.kept[run + " "][-1] - self.kept[run][-1]
                fits[i] = place + self.longest_within("", budget - known, inside)


@lru_cache(maxsize=4)
def counter(path: str, pattern: str) -> PrefixCounter:
    return PrefixCounter(path, pattern)


def _run(df: DataFrame, id_col: str, text_col: str, path: str | None, pattern: str, schema: str, row) -> DataFrame:
    shared.fresh(df, id_col, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(path or public_tokenizers.path("byte_bpe_50k.json"), pattern)
        for batch in batches:
            yield row(own, batch)

    return shared.exact(df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), run, schema, "doc_id")


def prefix_counts(df: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and counts array<int>, the tokens at each prefix of whole code points of texts of any length.

    Null counts as empty and has no prefixes. Rows that repeat are answered each; columns besides the two are not
    looked at; an empty table gives an empty one. Special strings in texts count as the library counts them, one each.
    """
    row = lambda own, b: pd.DataFrame({"doc_id": b["doc_id"], "counts": [own.prefixes(t) for t in b["_text"]]})
    return _run(df, id_col, text_col, path, pattern, "doc_id long, counts array<int>", row)


def token_counts(df: DataFrame, limit: int = 512, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), limit_chars (code points of the longest prefix with at most limit tokens).

    Null counts as empty. Texts of any length are counted whole, rows that repeat each; columns besides the two are not looked
    at; an empty table gives an empty one.
    """

    def row(own: PrefixCounter, batch: pd.DataFrame) -> pd.DataFrame:
        texts = batch["_text"].tolist()
        n, fits = own.answers(texts, limit)
        return pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [len(t.encode("utf-8")) for t in texts], "n_tokens": n, "over_limit": n > limit, "limit_chars": fits})

    return _run(df, id_col, text_col, path, pattern, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long", row)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
