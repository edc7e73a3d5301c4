"""Toxic passages by maximum-scoring segments over token log-odds.

Token scores: the log-odds that a token stands in a toxic document, with Dirichlet priors in a chain: all tokens ->
tokens with the same first 3, 4, 5 letters -> the word. Each level's posterior is the next one's prior, so a rare or
new word inherits what its stem shows, and a common one speaks for itself. A drift is taken off, which makes the expected
score of clean text negative.

Passages: the linear-time algorithm of Ruzzo and Tompa lists all maximal scoring segments of a text. Under clean text, the
largest segment score of n tokens follows an extreme-value law, P(S >= x) = 1 - exp(-K n exp(-lambda x)); lambda solves
sum p(s) exp(lambda s) = 1 over scores of clean tokens and K is fitted to the maxima of clean texts. A
passage is significant if its E-value is below ``SIGNIFICANT``. A document's evidence is its best passage's -ln E
and that of all significant ones together, calibrated by logistic regression on rows that the token scores did not see.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import shared

#: At most about so many labelled documents are fitted on, chosen by a hash of their ids.
SAMPLE = 24_000
#: Strength of each prior in tokens, lengths of the stems, rarest token kept, what is taken off each score, largest E-value.
PRIOR, STEMS, RAREST, DRIFT, SIGNIFICANT = 6.0, (3, 4, 5), 3, 0.4, 0.01
#: A score is taken at the bound of its share's interval that lies nearer to none, so many standard deviations wide; few occurrences weigh little.
CAUTION = 1.64
#: Calibrated probability from which on queries predict 1.
DECISION = 0.7
KEEP = 400_000
WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    return WORDS.findall(text.lower()) if text else []


class TokenScores(dict):
    """Word -> score. Words that were not learned fall back on the longest stem that was."""

    def __init__(self, learned: dict[str, float], stems: dict[str, float], other: float):
        super().__init__(learned)
        self.stems, self.other, self.learned = stems, other, learned

    def __missing__(self, word: str) -> float:
        if len(self) > KEEP + len(self.learned):
            self.clear()
            self.update(self.learned)
        found = next((self.stems[word[:k]] for k in reversed(STEMS) if len(word) >= k and word[:k] in self.stems), self.other)
        self[word] = found
        return found


def scores_of(words: list[str], tokens: TokenScores) -> np.ndarray:
    """Score of each word; one that only repeats the word before it is no evidence of its own."""
    found = list(map(tokens.__getitem__, words))
    return np.array([-DRIFT if i and w == words[i - 1] else s for i, (w, s) in enumerate(zip(words, found))], dtype=float)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) in linear time; end is exclusive."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float, int]] = []  # begin, end, sum before, sum after, nearest earlier one with a smaller sum before
    for i in at.tolist():
        begin, end, before, after = i, i + 1, sums[i], sums[i + 1]
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= before:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= after:
                stack.append((begin, end, before, after, k))
                break
            begin, before = stack[k][0], stack[k][2]  # joins with that one and all between
            del stack[k:]
    return [(b, e, float(y - x)) for b, e, x, y, _ in stack]


def law(values: np.ndarray, times: np.ndarray) -> float:
    """lambda of the extreme-value law: the positive root of the mean of exp(lambda s) = 1, over scores and how often each stands."""
    p = times / times.sum()
    if values.max(initial=0) <= 0:  # no clean token scores above 0: as if one in ten million did
        values, p = np.append(values, 6.0), np.append(p * (1 - 1e-7), 1e-7)
    lo, hi = 1e-6, 50.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (p * np.exp(np.minimum(mid * values, 700))).sum() > 1 else (mid, hi)
    return lo


class Model:
    """Token scores, the extreme-value law and the calibration."""

    def __init__(self, learned: dict[str, float], stems: dict[str, float], other: float):
        self.parts = (learned, stems, other)
        self.lam, self.k, self.line = 1.0, 0.1, (-4.0, 0.5, 0.0)
        self.tokens = TokenScores(*self.parts)

    def __getstate__(self):
        return self.parts, self.lam, self.k, self.line

    def __setstate__(self, state):
        self.parts, self.lam, self.k, self.line = state
        self.tokens = TokenScores(*self.parts)

    def passages(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """Significant passages: first word, word after the last, score, E-value."""
        words = words_of(text)
        scores = scores_of(words, self.tokens)
        scale = self.k * max(len(words), 1)
        return [(b, e, s, v) for b, e, s in maximal_segments(scores) if (v := scale * math.exp(-self.lam * s)) <= SIGNIFICANT]

    def evidence(self, text: str | None) -> tuple[float, float, int]:
        """-ln E of the best passage (0 if none is significant), ln(1 + the sum of all), their number."""
        found = [-math.log(max(v, 1e-300)) for *_, v in self.passages(text)]
        return max(found, default=0.0), math.log1p(sum(found)), len(found)

    def score(self, best: float, total: float) -> float:
        """Probability by the calibration."""
        a, b, c = self.line
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * best + c * total))))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression of y on two features, by Newton's method."""
    z = np.c_[np.ones(len(x)), x]
    w, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def wilson(t: float, c: float) -> tuple[float, float]:
    """Bounds of Wilson's interval for the share t / (t + c), CAUTION standard deviations to either side."""
    n, z = t + c, CAUTION * CAUTION
    middle, half = t + z / 2, CAUTION * math.sqrt(t * c / n + z / 4)
    return (middle - half) / (n + z), (middle + half) / (n + z)


def token_scores(counts: pd.DataFrame) -> Model:
    """From columns level (stem length, 0 the word), token, toxic, clean: posterior log-odds, level by level.

    The prior of a token comes from the other tokens of its stems, its own counts taken out, so that no occurrence is
    evidence twice. A score is the log-odds at the bound nearer to 0 of Wilson's interval, which stays finite where a token has
    only toxic or only clean occurrences, and never crosses 0 by that.
    """
    by = {k: dict(zip(g["token"], zip(g["toxic"].astype(float), g["clean"].astype(float)))) for k, g in counts.groupby("level")}
    toxic_all, clean_all = (float(counts.loc[counts["level"] == min(STEMS), c].sum()) for c in ("toxic", "clean"))
    base = (toxic_all + 1) / (toxic_all + clean_all + 2)
    root = math.log(base / (1 - base))

    def scored(token: str, level: int, toxic: float, clean: float) -> float:
        prior = base
        for k in STEMS:
            if (not level or k < level) and len(token) >= k and (found := by.get(k, {}).get(token[:k])):
                t, c = found[0] - toxic, found[1] - clean
                prior = (t + PRIOR * prior) / (t + c + PRIOR)
        t, c = toxic + PRIOR * prior, clean + PRIOR * (1 - prior)
        low, high = (math.log(p / (1 - p)) - root for p in wilson(t, c))
        return max(low, 0.0) + min(high, 0.0) - DRIFT

    stems = {token: scored(token, k, *n) for k in STEMS for token, n in by.get(k, {}).items()}
    backed = TokenScores({}, stems, -DRIFT)
    words = {token: scored(token, 0, *n) for token, n in by.get(0, {}).items()}
    return Model({w: s for w, s in words.items() if abs(s - backed[w]) > 0.25}, stems, -DRIFT)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Token counts of labelled texts, combined before they are shuffled; a text counts a token once."""
    for batch in batches:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch["_text"], batch["_toxic"]):
            found[int(toxic)].update(set(words_of(text)))
        for toxic, counter in found.items():
            if counter:
                yield pd.DataFrame({"token": list(counter), "_toxic": toxic, "n": list(counter.values())})


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most about ``sample`` labelled rows (``learn`` is a condition on labels).

    Without labels of both kinds the model scores everything 0. Labels that are null or repeat are dropped or merged
    (toxic if any says so).
    """
    wanted = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
    wanted = wanted.where(learn) if learn is not None else wanted
    wanted = wanted.groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("_toxic"))
    n = wanted.count()
    share = min(1.0, sample / max(n, 1))
    bucket = F.pmod(F.xxhash64("_id", F.lit("toxicity")), F.lit(1_000_000))
    chosen = wanted.where(bucket < int(share * 1_000_000))
    # its size is bounded by ``sample``, so it goes to all; texts stay where they are read
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").where("_text IS NOT NULL")
    second = F.pmod(F.xxhash64("_id", F.lit("calibration")), F.lit(4)) == 0
    per_word = rows.where(~second).select("_text", "_toxic").mapInPandas(_counted, "token string, _toxic int, n long")
    words = per_word.groupBy("token").agg(F.sum(F.when(F.col("_toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("_toxic") == 0, F.col("n")).otherwise(0)).alias("clean"))
    levels = words.withColumn("level", F.explode(F.array(*map(F.lit, (0, *STEMS))))).where((F.col("level") == 0) | (F.length("token") >= F.col("level")))
    tokens = levels.groupBy("level", F.when(F.col("level") == 0, F.col("token")).otherwise(F.substring("token", F.lit(1), F.col("level"))).alias("token"))
    # a vocabulary of the sample, bounded with it
    counts = tokens.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") + F.col("clean") >= RAREST).toPandas()
    if not len(counts) or not counts["toxic"].sum() or not counts["clean"].sum():
        blank = Model({}, {}, -DRIFT)
        blank.line = (-60.0, 0.0, 0.0)
        return blank
    model = token_scores(counts)

    def best_raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch["_text"], batch["_toxic"]):
                words = words_of(text)
                scores = scores_of(words, model.tokens)
                # all token scores of a clean text, as counts of rounded ones
                values, times = np.unique(np.round(scores, 2), return_counts=True) if not toxic else (scores[:0], scores[:0])
                out.append((int(toxic), len(words), max((s for *_, s in maximal_segments(scores)), default=0.0), values.tolist(), times.astype(int).tolist()))
            yield pd.DataFrame(out, columns=["toxic", "n", "best", "scores", "times"])

    seen = rows.where(second).select("_text", "_toxic").mapInPandas(best_raw, "toxic int, n long, best double, scores array<double>, times array<long>").toPandas()
    clean = seen[(seen["toxic"] == 0) & (seen["n"] > 0)]
    if len(clean):
        values, place = np.unique(np.concatenate([np.asarray(s, dtype=float) for s in clean["scores"]]), return_inverse=True)
        model.lam = law(values, np.bincount(place, np.concatenate([np.asarray(t, dtype=float) for t in clean["times"]])))
        shifted = model.lam * clean["best"].to_numpy() - np.log(clean["n"].to_numpy())
        model.k = float(np.exp(np.clip(shifted.mean() - 0.5772, -30, 5)))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.evidence(t)[:2] for t in batch["_text"]]
            yield pd.DataFrame({"toxic": batch["_toxic"], "best": [f[0] for f in found], "total": [f[1] for f in found]})

    check = rows.where(second).select("_text", "_toxic").mapInPandas(judged, "toxic int, best double, total double").toPandas()
    if check["toxic"].nunique() == 2:
        model.line = logistic(check[["best", "total"]].to_numpy(), check["toxic"].to_numpy(dtype=float))
    return model


def score(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """Per row: doc_id, what ``carry`` names, score (0 to 1), n_passages. Null and empty texts have no passage and the score of that.

    Texts of any length are scored whole; of segments that tie in score each is a passage of its own. Rows that repeat are scored each; an empty table gives an empty one; columns besides the two are not looked at.
    """
    shared.fresh(docs, id_col, text_col)
    held = spark.sparkContext.broadcast(model)  # a vocabulary of the bounded sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = held.value
        for batch in batches:
            found = [own.evidence(t if isinstance(t, str) else None) for t in batch.pop("_text")]
            batch["score"], batch["n_passages"] = [own.score(b, t) for b, t, _ in found], [n for *_, n in found]
            yield batch

    rows = docs.select(F.col(id_col).alias("doc_id"), *carry, F.col(text_col).alias("_text"))
    kept = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "_text")
    whole = [n for n, t in rows.dtypes if t in ("bigint", "int", "smallint", "tinyint")]
    return shared.exact(rows, run, f"{kept}, score double, n_passages int", *whole)


def kept_rows(spark: SparkSession, docs: DataFrame, model: Model, text_col: str = "text", below: float = DECISION) -> DataFrame:
    """The rows of docs whose score is below the decision, with all their columns; only texts go to Python."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shared.sole()
        own = held.value
        for texts in parts:
            yield pd.Series([own.score(*own.evidence(t)[:2]) for t in texts], dtype=float)

    return docs.where(scores(F.coalesce(F.col(text_col), F.lit(""))) < below)


def passages(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per significant passage: doc_id, first_word, end_word, passage_score, e_value, passage (its words)."""
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, b, e, s, v, " ".join(words_of(t)[b:e])) for i, t in zip(batch["doc_id"], batch["_text"]) for b, e, s, v in held.value.passages(t)]
            yield pd.DataFrame(out, columns=["doc_id", "first_word", "end_word", "passage_score", "e_value", "passage"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return shared.exact(rows, run, "doc_id long, first_word int, end_word int, passage_score double, e_value double, passage string", "doc_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = lambda c: F.coalesce(F.crc32(c.cast("string")) % 3 == 1, F.lit(False))
    model = fit(spark, docs, labels, ~held(F.col("doc_id")))
    found = score(spark, docs, model, carry=(held(F.col("doc_id")).alias("held_out"),))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= DECISION).cast("int").alias("predicted"), "n_passages")
