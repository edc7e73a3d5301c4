"""Indexing: files to texts to chunks to points, as one lazy plan; sinks and scans of the point table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, relations as R
from ..functions import text as T
from ..functions import vectors as V

#: Similarity below which a sentence opens a new semantic chunk, words of one at most, sentences up to which a text is cut by words instead.
SIMILAR, MAX_WORDS, FEW = 0.7, 512, 3
POINT = "point_id string, path string, chunk long, text string, vector array<float>, relations string, tokens array<string>, indexed_at long, namespace string"


def hash_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for an embedding model: signed counts of hashed words, normalised."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in t.lower().split():
                h = int(ids.xxhash.xxh3_64_intdigest(w))
                v[h % dim] += 1 if h >> 32 & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype("float32").tolist())
        return out

    return embed


def embedded(df: DataFrame, embed: Callable[[list[str]], list[list[float]]], column: str = "input") -> DataFrame:
    """df with ``vector``: texts go to the model in Arrow batches, whatever document they are of."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = embed(texts.tolist())
            if len(found) != len(texts):
                raise ValueError(f"the model gave {len(found)} vectors for {len(texts)} texts")
            yield pd.Series(found)

    return df.withColumn("vector", run(F.col(column)))


def trimmed_text(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def trimmed(texts: DataFrame) -> DataFrame:
    """Texts without white space at their ends; those that are then too short go."""
    return texts.withColumn("text", trimmed_text(F.col("text"))).where(F.octet_length("text") >= T.MIN_TEXT)


def chunks(texts: DataFrame, size: int = T.CHUNK_SIZE, overlap: int = T.CHUNK_OVERLAP) -> DataFrame:
    """(namespace, path, text, ...) to a row per chunk, numbered from 0; blank ones go, numbers stay. Short texts give none."""
    size, overlap = T.chunk_params(size, overlap)
    own = trimmed(texts)
    cut = own.select(*(c for c in own.columns if c != "text"), F.posexplode(T.smart_chunk(T.fields(F.col("text")), size, overlap)).alias("chunk", "text"))
    return cut.where(F.trim("text") != "")


def sentence_groups(sentences: list[str], vectors: list, threshold: float = SIMILAR, max_words: int = MAX_WORDS) -> list[str]:
    """Sentences joined while they stay near the mean of their group and within its words."""
    out, group, total, words = [], [], None, 0
    for sentence, v in zip(sentences, np.asarray(vectors, dtype=float)):
        n = len(sentence.split())
        if group:
            norm = np.linalg.norm(total) * np.linalg.norm(v)
            if (float(total @ v) / norm if norm else 0.0) < threshold or words + n > max_words:
                out.append(" ".join(group))
                group, words = [], 0
        total = total + v if group else v
        group.append(sentence)
        words += n
    return [*out, " ".join(group)] if group else out


def semantic_chunks(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], threshold: float = SIMILAR, max_words: int = MAX_WORDS) -> DataFrame:
    """As ``chunks``, cut where the meaning moves on: sentences are embedded and grouped inside their row, so nothing is shuffled.

    Texts of few sentences, and those whose embedding fails, are cut by words.
    """

    def grouped(sentences: list[str]) -> list[str] | None:
        try:
            vectors = embed(sentences) if len(sentences) > FEW else []
            return sentence_groups(sentences, vectors, threshold, max_words) if sentences and len(vectors) == len(sentences) else None
        except Exception:  # noqa: BLE001 - an injected model may fail in any way
            return None

    # the model takes one text's sentences at a time, so rows come in hundreds to a plain function: an Arrow batch of whole texts would be held several times over
    by_meaning = F.udf(grouped, "array<string>", useArrow=False)
    size, overlap = T.chunk_params(max_words, 0)
    own = trimmed(texts).withColumn("_by_meaning", by_meaning(T.sentences(F.col("text"))))
    cut = F.coalesce("_by_meaning", T.smart_chunk(T.fields(F.col("text")), size, overlap))
    return own.select(*(c for c in texts.columns if c != "text"), F.posexplode(cut).alias("chunk", "text")).where(F.trim("text") != "")


def points(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], size: int = T.CHUNK_SIZE, overlap: int = T.CHUNK_OVERLAP, namespaced_ids: bool = True, strategy: str = "fixed") -> DataFrame:
    """Points of (namespace, path, text and, optionally, context): id, vector, chunk, relations on the first chunk, tokens for text match.

    Texts are cut by words (``fixed``) or by meaning (``semantic``). Chunks are embedded with their context and stored without;
    zero vectors are dropped.
    """
    if strategy not in ("fixed", "semantic"):
        raise ValueError(f"strategy must be fixed or semantic, not {strategy!r}")
    own = texts if "context" in texts.columns else texts.withColumn("context", F.lit(""))
    read = R.to_json(R.relations(F.col("path"), F.col("text")))
    # relations that a plug-in gave stand before those read off the text
    own = own.withColumn("relations", F.when(F.coalesce("relations", F.lit("")) != "", F.col("relations")).otherwise(read) if "relations" in own.columns else read)
    cut = chunks(own, size, overlap) if strategy == "fixed" else semantic_chunks(own, embed, max_words=size)
    cut = cut.withColumn("input", T.enrich(F.col("context"), F.col("text")))
    made = embedded(cut, embed).where(~V.is_zero(F.col("vector")))
    name = F.col("namespace") if namespaced_ids else None
    return made.select(
        ids.point_id(F.col("path"), F.col("chunk"), name).alias("point_id"), "namespace", "path", F.col("chunk").cast("long").alias("chunk"), "text", "vector",
        F.when(F.col("chunk") == 0, F.col("relations")).otherwise("").alias("relations"), T.match_tokens(F.col("text")).alias("tokens"), (F.unix_micros(F.current_timestamp()) * 1000).alias("indexed_at"),
    )


def semantic_groups(sentences: DataFrame, by: list[str], order: str, vector: str, threshold: float = 0.5, max_words: int = 512, words: str | None = None) -> DataFrame:
    """Number of the group of each sentence: a new one opens where the similarity to the group's running centroid falls under the threshold or its words exceed the limit.

    A fold per document, whose sentences are one group of rows; the frame resets on its own data, so no window expresses it.
    """
    schema = ", ".join(f"{c} {t}" for c, t in sentences.select(*by, order).dtypes) + ", grp int"

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        total, n, size, group, out = None, 0, 0, 0, []
        counts = part[words].tolist() if words else [0] * len(part)
        for v, w in zip(part[vector], counts):
            v = np.asarray(v, dtype=float)
            if total is not None:
                mean = total / n
                norm = np.sqrt((mean * mean).sum()) * np.sqrt((v * v).sum())
                like = float((mean * v).sum() / norm) if norm else 0.0
                if like < threshold or size + w > max_words:
                    group, total, n, size = group + 1, None, 0, 0
            total, n, size = v if total is None else total + v, n + 1, size + w
            out.append(group)
        return part[[*by, order]].assign(grp=out)

    return sentences.groupBy(*by).applyInPandas(fold, schema)


def contexts(texts: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """texts with ``context``: what a model says of each text's beginning; empty for short texts and where the model fails."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(excerpt: str | None) -> str:
            try:
                return (ask(excerpt) or "").strip() if excerpt else ""
            except Exception:  # noqa: BLE001 - an injected model may fail in any way
                return ""

        for batch in parts:
            yield batch.map(one)

    return texts.withColumn("context", run(T.excerpt(F.col("text"))))


def ensure_points(spark: SparkSession, path: str, dim: int) -> bool:
    """Create an empty point table for vectors of ``dim`` numbers, unless there is one; whether it was made. One of another size is an error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.size")
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        have = int(spark.read.text(f"{path}.size").first()["value"])
        if have != dim:
            raise ValueError(f"the table holds vectors of {have} numbers, not {dim}")
        return False
    spark.createDataFrame([], POINT).write.partitionBy("namespace").parquet(path)
    spark.createDataFrame([(str(dim),)], "value string").coalesce(1).write.text(f"{path}.size")
    return True


def sized(df: DataFrame, dim: int) -> DataFrame:
    """df; a vector of another size fails the job that meets it."""
    fault = F.raise_error(F.concat(F.lit(f"vectors must have {dim} numbers, not "), F.size("vector").cast("string")))
    return df.withColumn("vector", F.when(F.size("vector") == dim, F.col("vector")).otherwise(fault.cast("array<float>")))


def file_text(points: DataFrame, path: str, namespace: str | None = None) -> DataFrame:
    """The chunks of one file in their order: namespace, path, chunk, text."""
    own = points.where(F.col("path") == path)
    own = own.where(F.col("namespace") == namespace) if namespace else own
    return own.select("namespace", "path", "chunk", "text").orderBy("namespace", "chunk")


def write_points(df: DataFrame, path: str) -> None:
    """The point table, a folder a namespace, so that searches of one read no other."""
    df.write.partitionBy("namespace").mode("overwrite").option("compression", "zstd").parquet(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """The point table; one that holds nothing yet has no file to tell its columns, which are those of ``POINT``."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.read.schema(POINT).parquet(path)


def counts(points: DataFrame) -> DataFrame:
    return points.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


def scroll(points: DataFrame, after: tuple[str, str, int] | None = None, limit: int = 250, namespace: str | None = None) -> tuple[DataFrame, Callable[[], tuple | None]]:
    """A page of points in the order of their keys, behind the key ``after``; and what finds the key to go on from, None when there is no further page.

    The next page is told by a key, not by a number of rows, so points that come or go in between move no other from one page to the next. The
    scan of a page leaves out files and row groups whose greatest path lies before it.
    """
    own = points.where(F.col("namespace") == namespace) if namespace else points
    key = [F.col(c) for c in ("namespace", "path", "chunk")]
    if after is not None:
        n, p, c = after
        later = (F.col("namespace") > n) | ((F.col("namespace") == n) & ((F.col("path") > p) | ((F.col("path") == p) & (F.col("chunk") > c))))
        # implied by the above, and plain enough to reach the files
        own = own.where(later & (F.col("namespace") >= n) & ((F.col("namespace") > n) | (F.col("path") >= p)))
    page = own.orderBy(*key).limit(limit)

    def token() -> tuple | None:
        rows = page.select("namespace", "path", "chunk").collect()  # a page of keys
        return tuple(rows[-1]) if len(rows) == limit else None

    return page, token
