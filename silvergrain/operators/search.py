"""Search over points (namespace, path, chunk, text, vector, ...): similarity, text match, fusion by reciprocal ranks.

Every search is one plan. A leg is filtered before it is scored; the best of each namespace come from a window with a rank
limit, which Spark applies before and after the shuffle; fusion is a union and one sum by key. Ties are broken by
namespace, path and chunk, so results are deterministic.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..workspace import work_dir

#: The constant of reciprocal rank fusion (Cormack et al. 2009), and how many of a leg are fused per result wanted.
RRF_K, PREFETCH = 60, 2
#: Decimals of a similarity; ranks are made from the rounded value.
DECIMALS = 9
#: Query vectors in one matrix product, and bytes of query vectors that all tasks get for one scan of the points.
QUERY_BLOCK, SENT = 512, 32 << 20
KEY = ("namespace", "path", "chunk")


def in_namespace(points: DataFrame, namespace: str | None) -> DataFrame:
    """The points of a namespace; none given means all."""
    return points.where(F.col("namespace") == namespace) if namespace else points


def scored(points: DataFrame, query: list[float], namespace: str | None = None) -> DataFrame:
    """Points with ``score``, their cosine similarity to the query. The query is a literal of the plan."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return in_namespace(points, namespace).where(~V.is_zero(F.col("vector"))).withColumn("score", F.round(V.cosine(F.col("vector"), q), DECIMALS))


def vector_search(points: DataFrame, query: list[float], k: int = 10, namespace: str | None = None) -> DataFrame:
    return scored(points, query, namespace).orderBy(F.desc("score"), *KEY).limit(k)


def text_search(points: DataFrame, words: str, namespace: str | None = None) -> DataFrame:
    """Points whose text holds all the query's tokens. A column ``tokens``, made when indexing, is used if there."""
    return in_namespace(points, namespace).where(matched(points, words))


def matched(points: DataFrame, words: str) -> Column:
    tokens = F.col("tokens") if "tokens" in points.columns else T.match_tokens(F.col("text"))
    return T.matches(tokens, query_tokens(words))


def query_tokens(words: str) -> list[str]:
    import regex

    return [t for t in dict.fromkeys(regex.split(r"[^\p{L}\p{N}]+", words.lower())) if t]


def ranked(leg: DataFrame, k: int, by: list[Column], each: tuple[str, ...] = ()) -> DataFrame:
    """The first k rows (of each group, if ``each`` names columns), with ``rank`` from 1."""
    if not each:  # one global order: take the k first before numbering them
        return leg.orderBy(*by).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*by)))
    return leg.withColumn("rank", F.row_number().over(Window.partitionBy(*each).orderBy(*by))).where(F.col("rank") <= k)


def fuse(legs: list[tuple[DataFrame, float]], limit: int, rrf_k: int = RRF_K, key: tuple[str, ...] = KEY, each: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k + rank) over legs, by key; a leg of weight 0 is left out."""
    rrf_k = max(rrf_k, 1)
    parts = [leg.select(*key, (F.lit(float(w)) / (rrf_k + F.col("rank"))).alias("part")) for leg, w in legs if w > 0]
    if not parts:
        return legs[0][0].select(*key).withColumn("score", F.lit(0.0)).limit(0)
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    sums = both.groupBy(*key).agg(F.round(F.sum("part"), 12).alias("score"))
    order = [F.desc("score"), *key]
    return ranked(sums, limit, order, each).drop("rank") if each else sums.orderBy(*order).limit(limit)


def legs(points: DataFrame, query: list[float] | None, words: str | None, depth: int, each: tuple[str, ...] = ()) -> DataFrame:
    """(key, leg, rank): the first ``depth`` rows of the dense leg (0) and of the text leg (1), of each group if ``each`` names columns.

    One scan: a point gives a row for each leg that it is in, and the limit on ranks holds before the shuffle.
    """
    entries = []
    if query is not None:
        q = F.array(*(F.lit(float(x)) for x in query))
        entries.append(F.when(~V.is_zero(F.col("vector")), F.struct(F.lit(0).alias("leg"), F.round(V.cosine(F.col("vector"), q), DECIMALS).alias("score"))))
    if words is not None:
        entries.append(F.when(matched(points, words), F.struct(F.lit(1).alias("leg"), F.lit(0.0).alias("score"))))
    rows = points.select(*KEY, F.explode(F.array_compact(F.array(*entries))).alias("_e")).select(*KEY, "_e.leg", "_e.score")
    return ranked(rows, depth, [F.desc("score"), *map(F.col, KEY)], (*each, "leg"))


def fused_legs(found: DataFrame, weights: tuple[float, float], rrf_k: int) -> DataFrame:
    """(key, score): the sum over legs of weight / (k + rank)."""
    weight = F.when(F.col("leg") == 0, float(weights[0])).otherwise(float(weights[1]))
    return found.where(weight > 0).groupBy(*KEY).agg(F.round(F.sum(weight / (max(rrf_k, 1) + F.col("rank"))), 12).alias("score"))


def hybrid_search(points: DataFrame, query: list[float], words: str, k: int = 10, namespace: str | None = None, dense: float = 1.0, sparse: float = 1.0, rrf_k: int = RRF_K, paths: DataFrame | None = None) -> DataFrame:
    """Similarity and text match, fused. ``paths`` (path, or namespace and path) restricts both legs; the text leg is unranked and taken by key."""
    by = [] if paths is None else [c for c in ("namespace", "path") if c in paths.columns]
    own = in_namespace(points.join(paths.select(*by).distinct(), by, "left_semi") if by else points, namespace)
    return fused_legs(legs(own, query, words, PREFETCH * k), (dense, sparse), rrf_k).orderBy(F.desc("score"), *KEY).limit(k)


def keyword_search(points: DataFrame, words: str, k: int = 10, namespace: str | None = None, rrf_k: int = RRF_K) -> DataFrame:
    return fuse([(ranked(text_search(points, words, namespace), PREFETCH * k, [*map(F.col, KEY)]), 1.0)], k, rrf_k)


def fan_out(points: DataFrame, query: list[float] | None = None, words: str | None = None, k: int = 10, namespaces: list[str] | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """The best k of every namespace, then fused across namespaces by rank; one plan instead of a request each.

    With a query vector only: by similarity. With words only: by text match. With both: fused in each namespace first.
    ``source_namespace`` says where a result comes from. An empty list of namespaces gives nothing.
    """
    own = points if namespaces is None else points.where(F.col("namespace").isin(*namespaces)) if namespaces else points.limit(0)
    each, order = ("namespace",), [F.desc("score"), *map(F.col, KEY)]
    if words is None:
        local = ranked(scored(own, query), k, order, each).select(*KEY, "score", "rank")
    else:
        local = ranked(fused_legs(legs(own, query, words, PREFETCH * k, each), (1.0, 1.0), rrf_k), k, order, each)
    # keys hold the namespace: ranks of different ones never add up
    return fuse([(local, 1.0)], k, rrf_k).withColumn("source_namespace", F.col("namespace"))


def weighted_merge(primary: DataFrame, secondary: DataFrame, k: int, weight: float = 0.7, rrf_k: int = RRF_K) -> DataFrame:
    """Two ranked legs (key, rank), the second at a lower weight."""
    return fuse([(primary, 1.0), (secondary, weight)], k, rrf_k)


class _Best:
    """The k best rows of each of a block's queries, by score, then id."""

    def __init__(self, names: np.ndarray, unit: np.ndarray, k: int):
        self.names, self.unit, self.k = names, unit, k
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(names)

    def add(self, rows: np.ndarray, vectors: np.ndarray) -> None:
        score = np.round(vectors @ self.unit.T, DECIMALS)
        score[rows[:, None] == self.names[None, :]] = -np.inf
        # ties of the k-th score stay until ids decide
        bound = np.partition(score, len(rows) - self.k, axis=0)[len(rows) - self.k] if len(rows) > self.k else np.full(len(self.names), -np.inf)
        for q, ((s, i), least) in enumerate(zip(self.best, bound)):
            new = np.flatnonzero((score[:, q] >= least) & (score[:, q] > -np.inf))
            s, i = np.concatenate([s, score[new, q]]), np.concatenate([i, rows[new]])
            order = np.lexsort((i, -s))[: self.k]
            self.best[q] = s[order], i[order]


def batch_search(spark: SparkSession, points: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """For every query (query_id, vector) its k most similar points, itself excluded: query_id, id, score, rank.

    All tasks get up to SENT bytes of queries and score their points against them in blocks of QUERY_BLOCK, one matrix product a
    block and batch; each hands on its k best a query, so what is shuffled is k rows a query and task, never a pair each.
    More queries than that take another scan of the points for each such share.
    """
    first = queries.select("vector").first()
    if first is None:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    at_once = max(QUERY_BLOCK, SENT // (4 * len(first["vector"])))
    total = queries.count()
    shares, out = -(-total // at_once), None
    kept = f"{work_dir(spark)}/nearest-{uuid.uuid4().hex}"
    for share in range(shares):
        # ids dealt evenly by their hash; a share is collected within its bound, give or take
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(shares)) == share).select("query_id", "vector").toPandas()
        matrix = np.stack(block["vector"].to_numpy()).astype(np.float64) if len(block) else np.zeros((0, len(first["vector"])))
        sent = spark.sparkContext.broadcast((block["query_id"].to_numpy(), (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300))))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, unit = sent.value
            blocks = [_Best(names[i : i + QUERY_BLOCK], unit[i : i + QUERY_BLOCK], k) for i in range(0, len(names), QUERY_BLOCK)]
            for batch in batches:
                if not len(batch):
                    continue
                own = np.stack(batch["_v"].to_numpy()).astype(np.float64)
                own /= np.where((norm := np.linalg.norm(own, axis=1)) > 0, norm, 1)[:, None]
                for b in blocks:
                    b.add(batch["_id"].to_numpy(), own)
            for b in blocks:
                sizes = [len(i) for _, i in b.best]
                yield pd.DataFrame({"query_id": np.repeat(b.names, sizes), "id": np.concatenate([i for _, i in b.best]), "score": np.concatenate([s for s, _ in b.best])})

        part = points.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).mapInPandas(run, "query_id long, id long, score double")
        if shares > 1:  # a share's best go to the shared folder, so the plan stays as small as one share's
            ranked(part, k, [F.desc("score"), F.col("id")], ("query_id",)).drop("rank").write.mode("append").parquet(kept)
        out = part
    out = out if shares == 1 else spark.read.schema("query_id long, id long, score double").parquet(kept)
    return ranked(out, k, [F.desc("score"), F.col("id")], ("query_id",))


def each_namespace(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], search: Callable[[DataFrame], DataFrame], k: int = 10, seconds: float = 30.0, rrf_k: int = RRF_K) -> tuple[DataFrame, list[str], list[str]]:
    """One search over namespaces that are kept apart: fused results, the namespaces that answered, those that failed.

    ``sources`` opens each namespace's points. A leg that raises, or is not there after ``seconds``, leaves the others alone.
    What comes back of a leg is a list of at most k rows.
    """

    def leg(name: str) -> list[tuple]:
        spark.sparkContext.setJobGroup(f"{group}-{name}", name, True)
        found = ranked(search(sources[name]()), k, [F.desc("score"), *map(F.col, KEY)])
        return [tuple(r) for r in found.select(*KEY, "rank").collect()]

    group, rows, failed, end = uuid.uuid4().hex, [], [], time.monotonic() + seconds
    pool = ThreadPoolExecutor(max(1, min(len(sources), 16)))
    waiting = {name: pool.submit(inheritable_thread_target(spark)(leg), name) for name in sources}
    for name, job in waiting.items():
        try:
            rows += job.result(timeout=max(0.0, end - time.monotonic()))
        except Exception:  # noqa: BLE001 - whatever fails a leg fails no other
            spark.sparkContext.cancelJobGroup(f"{group}-{name}")
            failed.append(name)
    pool.shutdown(wait=False, cancel_futures=True)
    local = spark.createDataFrame(rows, "namespace string, path string, chunk long, rank int")
    return fuse([(local, 1.0)], k, rrf_k).withColumn("source_namespace", F.col("namespace")), [n for n in sources if n not in failed], failed


def rerank(results: DataFrame, scores: DataFrame, top_k: int = 0, threshold: float = 0.0) -> DataFrame:
    """results (key, rank) by the scores (key, rerank_score); missing ones count 0.

    A threshold that nothing reaches changes nothing. ``new_rank`` is the order after, ``moved`` whether it differs.
    """
    joined = results.join(scores, list(KEY), "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))
    order = Window.orderBy(F.desc("rerank_score"), "rank")  # a result list, k rows
    done = joined.withColumn("new_rank", F.row_number().over(order)).withColumn("moved", F.col("new_rank") != F.col("rank"))
    if top_k:
        done = done.where(F.col("new_rank") <= top_k)
    if threshold > 0:
        any_left = F.max(F.when(F.col("rerank_score") >= threshold, 1).otherwise(0)).over(Window.partitionBy(F.lit(1)))
        done = done.withColumn("_any", any_left).where((F.col("_any") == 0) | (F.col("rerank_score") >= threshold)).drop("_any")
    return done


def reranked(results: DataFrame, question: str, model: Callable[[str, list[str]], list[float]], top_k: int = 0, threshold: float = 0.0) -> DataFrame:
    """A result list (key, score, text) in the order that a model of relevance gives it; the list is scored in one call."""
    spark, order = results.sparkSession, [F.desc("score"), *map(F.col, KEY)]
    rows = results.orderBy(*order).collect()  # k rows
    scores = model(question, [r["text"] or "" for r in rows]) if rows else []
    before = spark.createDataFrame([(*(r[c] for c in KEY), float(r["score"]), i + 1, float(s)) for i, (r, s) in enumerate(zip(rows, scores))], "namespace string, path string, chunk long, score double, rank int, rerank_score double")
    return rerank(before.drop("rerank_score"), before.select(*KEY, "rerank_score"), top_k, threshold)


def search(points: DataFrame, mode: str = "hybrid", **options) -> DataFrame:
    """Search by mode: hybrid, semantic or keyword."""
    if mode == "semantic":
        return vector_search(points, options["query"], options.get("k", 10), options.get("namespace"))
    if mode == "keyword":
        return keyword_search(points, options["words"], options.get("k", 10), options.get("namespace"))
    if mode == "hybrid":
        return hybrid_search(points, options["query"], options["words"], options.get("k", 10), options.get("namespace"))
    raise ValueError(f"mode must be hybrid, semantic or keyword, not {mode!r}")
