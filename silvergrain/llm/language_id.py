"""Language identification by unigrams over the pieces of a public vocabulary, all segmentations summed.

Each language has a probability for each piece. A word's probability is the sum, over every way to cut it into
pieces, of the product of their probabilities; the forward algorithm gives it in one pass over the word's end
positions. Pieces never cross words, so a text's log-probability is the sum of its words'. Training runs
expectation-maximisation over the same lattices (forward-backward), one task a language, on a bounded sample of
labelled rows. The posterior over languages, with equal priors, gives the prediction and its score.

Lattices of ordinary words are summed together as arrays of probabilities; a word of more than ``LONG_WORD`` characters, whose
probability doubles can't hold, is summed by itself in logarithms, so no word is cut.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: The training sample holds at most so many documents a language, those of the smallest hashes of their ids.
DOCS_PER_LANG = 600
#: Rounds of expectation-maximisation; the share of probability given to all pieces alike; that of a character outside the vocabulary.
ROUNDS, FLOOR, UNKNOWN = 3, 0.02, 1e-7
#: Characters up to which a word's probability is within the range of doubles.
LONG_WORD = 40
#: Words a worker keeps, words in one lattice, texts scored at a time.
KEEP, LATTICE, BLOCK = 500_000, 4096, 2048
#: From this many times the sample's rows on, rows are thinned by their hash before the sample is taken.
THINNED = 2
START = "▁"
WORDS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, int], int]:
    """Piece -> id, with -1 for beginnings of pieces that are none themselves, and the number of pieces; control and byte pieces are left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = {model.id_to_piece(i): i for i in range(n) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    return dict.fromkeys((p[:k] for p in pieces for k in range(1, len(p))), -1) | pieces, n


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters, each with the start mark before it."""
    return [START + w for w in ((text.lower(),) if text.isalpha() else WORDS.findall(text.lower()))]


class LongWord:
    """The edges (begin, piece) by end of one word; sums in logarithms, so of any length."""

    def __init__(self, word: str, vocab: tuple[dict[str, int], int]):
        ids, unknown = vocab
        n = len(word)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            single = ids.get(word[i], -1)
            self.ends[i + 1].append((i, single if single >= 0 else unknown))
            for j in range(i + 2, n + 1):
                if (piece := ids.get(word[i:j])) is None:
                    break
                if piece >= 0:
                    self.ends[j].append((i, piece))

    def forward(self, ln_p: np.ndarray) -> np.ndarray:
        """ln alpha[position, language]."""
        alpha = np.zeros((len(self.ends), ln_p.shape[1]))
        for end, edges in enumerate(self.ends[1:], 1):
            alpha[end] = np.logaddexp.reduce([alpha[begin] + ln_p[piece] for begin, piece in edges])
        return alpha

    def expected(self, ln_p: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces of one language."""
        alpha, out = self.forward(ln_p)[:, 0], np.zeros(len(ln_p))
        beta = np.full(len(alpha), -np.inf)
        beta[-1] = 0
        for end in range(len(self.ends) - 1, 0, -1):
            for begin, piece in self.ends[end]:
                through = ln_p[piece, 0] + beta[end]
                out[piece] += np.exp(alpha[begin] + through - alpha[-1])
                beta[begin] = np.logaddexp(beta[begin], through)
        return out


class Lattice:
    """All pieces in all of the words, as edges (word, begin, end, piece), grouped by end and ordered by word."""

    def __init__(self, words: list[str], vocab: tuple[dict[str, int], int]):
        ids, unknown = vocab
        get, edges = ids.get, []
        for w, word in enumerate(words):
            n = len(word)
            for i in range(n):
                # an edge is one number, in the order of end, word, begin, piece
                at = w << 32 | i << 24
                single = get(word[i], -1)
                edges.append(i + 1 << 48 | at | (single if single >= 0 else unknown))
                for j in range(i + 2, n + 1):
                    if (piece := get(word[i:j])) is None:
                        break
                    if piece >= 0:
                        edges.append(j << 48 | at | piece)
        self.lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        code = np.sort(np.array(edges, dtype=np.int64))
        table = np.stack([code >> 48, code >> 32 & 0xFFFF, code >> 24 & 0xFF, code & 0xFFFFFF], axis=1)
        self.steps = []
        for end in range(1, int(self.lengths.max(initial=0)) + 1):
            lo, hi = np.searchsorted(table[:, 0], (end, end + 1))
            word, begin, piece = table[lo:hi, 1], table[lo:hi, 2], table[lo:hi, 3]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if hi > lo else np.zeros(0, dtype=np.int64)
            self.steps.append((end, word, begin, piece, first))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[word, position, language]: the probability of the word up to the position. p: pieces by languages."""
        alpha = np.zeros((len(self.lengths), len(self.steps) + 1, p.shape[1]))
        alpha[:, 0] = 1
        for end, word, begin, piece, first in self.steps:
            if len(word):
                alpha[word[first], end] = np.add.reduceat(alpha[word, begin] * p[piece], first, axis=0)
        return alpha

    def log_probability(self, p: np.ndarray) -> np.ndarray:
        return np.log(self.forward(p)[np.arange(len(self.lengths)), self.lengths])

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces of one language, words weighted."""
        alpha = self.forward(p)[:, :, 0]
        rows = np.arange(len(self.lengths))
        beta = np.zeros_like(alpha)
        beta[rows, self.lengths] = 1
        total, q, out = alpha[rows, self.lengths], p[:, 0], np.zeros(len(p))
        for end, word, begin, piece, _ in reversed(self.steps):
            if len(word):
                through = q[piece] * beta[word, end]
                out += np.bincount(piece, weights=weight[word] * alpha[word, begin] * through / total[word], minlength=len(p))
                np.add.at(beta, (word, begin), through)
        return out


def fit_pieces(counts: Counter, path: str) -> np.ndarray:
    """Piece probabilities of one language; the last entry is that of a character outside the vocabulary."""
    vocab = vocabulary(path)
    n = vocab[1]
    words = [w for w in counts if len(w) <= LONG_WORD]
    weight = np.array([counts[w] for w in words], dtype=float)
    long = [(LongWord(w, vocab), n) for w, n in counts.items() if len(w) > LONG_WORD]
    parts = [(Lattice(words[i : i + LATTICE], vocab), weight[i : i + LATTICE]) for i in range(0, len(words), LATTICE)]
    p = np.full((n + 1, 1), 1.0 / n)
    p[n] = UNKNOWN
    for _ in range(ROUNDS):
        found = sum((part.expected(p, w) for part, w in parts), np.zeros(n + 1))
        found = sum((times * part.expected(np.log(p)) for part, times in long), found)[:n]
        p[:n, 0] = (1 - FLOOR) * found / max(found.sum(), 1e-9) + FLOOR / n
    return p[:, 0]


def fit(spark: SparkSession, docs: DataFrame, learn: Column, path: str | None = None, docs_per_lang: int = DOCS_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages and their piece probabilities (pieces by languages), from rows where ``learn`` holds.

    The sample takes the docs_per_lang rows a language with the smallest hashes of their ids; each language is one group of that
    bounded size. Rows of languages that have many more are thinned by the hash where they are read, so few meet in a task.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ids = rows.select(F.col(lang_col).alias("_lang"), F.col(id_col).alias("_id"), F.xxhash64(id_col).alias("_hash"))
    # a row a language, of which there are few
    sizes = F.broadcast(ids.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n")))
    below = (F.lit(THINNED * docs_per_lang) / F.col("_n") - 0.5) * F.lit(2.0**64)
    thin = ids.join(sizes, "_lang").where((F.col("_n") <= THINNED * docs_per_lang) | (F.col("_hash") < below)).select("_lang", "_id", "_hash")
    order = Window.partitionBy("_lang").orderBy("_hash", "_id")
    # docs_per_lang rows a language: sent to all, so no text is shuffled to be chosen
    chosen = F.broadcast(thin.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= docs_per_lang).select("_id").distinct())
    sample = rows.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(chosen, "_id", "left_semi")
    file = path

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        counts = Counter(w for t in part["text"] for w in words_of(t))
        return pd.DataFrame({"lang": [key[0]], "p": [fit_pieces(counts, file or public_tokenizers.path("piece_bpe_32k.model"))]})

    # one row a language, each a vector as long as the vocabulary
    found = sorted(sample.groupBy("lang").applyInPandas(one, "lang string, p array<double>").collect(), key=lambda r: r["lang"])
    return [r["lang"] for r in found], np.array([r["p"] for r in found]).T


class Scorer:
    """Scores texts; keeps the log-probabilities of words it has seen, long ones apart."""

    def __init__(self, langs: list[str], p: np.ndarray, path: str):
        self.langs, self.p, self.vocab = langs, p, vocabulary(path)
        self.ln_p = np.log(p)
        self.forget()

    def forget(self) -> None:
        # row 0 is that of words that are not kept
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.langs)))

    def learn(self, words: list[str]) -> None:
        for i in range(0, len(words), LATTICE):
            part = words[i : i + LATTICE]
            at = len(self.rows) + 1
            while at + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at : at + len(part)] = Lattice(part, self.vocab).log_probability(self.p)
            self.rows.update(zip(part, range(at, at + len(part))))

    def log_probabilities(self, texts: list[str]) -> np.ndarray:
        """Of each text, by language. Its chunks between white space are coded, and each distinct one is summed once."""
        if len(self.rows) > KEEP:
            self.forget()
        cut = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        coded = cut.values.dictionary_encode()
        found = list(map(words_of, coded.dictionary.to_pylist()))
        words, rows = [w for ws in found for w in ws], self.rows
        self.learn([w for w in {w for w in words if w not in rows} if len(w) <= LONG_WORD])
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        first = np.cumsum(size) - size
        each = np.zeros((len(found), len(self.langs)))
        if words:
            each[size > 0] = np.add.reduceat(self.table[[rows.get(w, 0) for w in words]], first[size > 0])
        for k, w in enumerate(words):
            if len(w) > LONG_WORD:
                each[np.searchsorted(first, k, side="right") - 1] += LongWord(w, self.vocab).forward(self.ln_p)[-1]
        total = np.zeros((len(texts), len(self.langs)))
        edges = cut.offsets.to_numpy()
        if len(full := np.flatnonzero(edges[1:] > edges[:-1])):
            total[full] = np.add.reduceat(each[coded.indices.to_numpy()], edges[full])
        return total

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(texts)
        some = [i for i, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        for k in range(0, len(some), BLOCK):
            part = some[k : k + BLOCK]
            for i, total in zip(part, self.log_probabilities([texts[i] for i in part])):
                best = int(total.argmax())
                out[i] = self.langs[best], float(1 / np.exp(total - total[best]).sum())
        return out


def predict(spark: SparkSession, docs: DataFrame, langs: list[str], p: np.ndarray, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """Per row: doc_id, what ``carry`` names, lang_pred and score (posterior of the prediction, 0 to 1).

    Null texts and texts without a letter give ``und`` with score 0, as does everything if no language was learned. Ties
    of scores go to the language first in order. Texts and words of any length are summed whole. Rows that repeat are scored
    each; an empty table gives an empty one.
    """
    shared.fresh(docs, id_col, text_col)
    model = spark.sparkContext.broadcast((langs, p))  # as large as the vocabulary times the languages
    file = path

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Scorer(*model.value, file or public_tokenizers.path("piece_bpe_32k.model"))
        for batch in batches:
            done = own.score([t if isinstance(t, str) else None for t in batch.pop("_text")])
            batch["lang_pred"], batch["score"] = [d[0] for d in done], [d[1] for d in done]
            yield batch

    rows = docs.select(F.col(id_col).alias("doc_id"), *carry, F.col(text_col).alias("_text"))
    kept = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "_text")
    whole = [n for n, t in rows.dtypes if t in ("bigint", "int", "smallint", "tinyint")]
    return shared.exact(rows, run, f"{kept}, lang_pred string, score double", *whole)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    langs, p = fit(spark, docs, ~held)
    return predict(spark, docs, langs, p, carry=(held.alias("held_out"),))
