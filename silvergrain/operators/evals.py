"""Quality of retrieval and answers, judged by injected models."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import work_dir
from . import index
from . import search as S

PASS, PARTIAL = 0.7, 0.4


def verdict(recall: Column, faithfulness: Column) -> Column:
    mean = (recall + faithfulness) / 2
    return F.when(mean >= PASS, "PASS").when(mean >= PARTIAL, "PARTIAL").otherwise("FAIL")


def recall_score(confidence: Column, contained: Column) -> Column:
    """The judge's confidence, of which a missing answer leaves three tenths."""
    return F.when(contained, confidence).otherwise(confidence * 0.3)


def summary(outcomes: DataFrame, threshold: float = PASS) -> DataFrame:
    """Totals of a suite: an entry passes by its recall alone."""
    return outcomes.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("context_recall") >= threshold).alias("passed"), F.count_if(~(F.col("context_recall") >= threshold)).alias("failed"))


def by_verdict(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("namespace", "verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("context_recall"), 9).alias("avg_recall"), F.round(F.avg("faithfulness"), 9).alias("avg_faithfulness"))


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("question string, expected_answer string, namespace string").option("multiLine", "true").json(path)


def contexts(spark: SparkSession, points: DataFrame, suite: DataFrame, embed: Callable[[list[str]], list[list[float]]], namespace: str | None = None, k: int = 10) -> DataFrame:
    """suite (question, expected_answer, namespace) with ``context``: the texts of the k nearest points of the entry's namespace, without tags.

    Questions are numbered, embedded in Arrow batches and kept as a table, so that a number stays what it is if an executor is lost; each
    namespace, of which there are few, takes one batch search.
    """
    numbered = index.embedded(suite.withColumn("namespace", F.coalesce("namespace", F.lit(namespace))).withColumn("query_id", F.monotonically_increasing_id()), embed, "question")
    path = f"{work_dir(spark)}/questions-{uuid.uuid4().hex}"
    numbered.write.parquet(path)
    asked = spark.read.schema(numbered.schema).parquet(path)
    known = points.withColumn("_row", F.xxhash64(*S.KEY))  # numbers the points: what a search hands on
    out = None
    for (name,) in asked.select("namespace").distinct().toLocalIterator():
        own = S.in_namespace(known, name)
        these = asked.where(F.col("namespace").eqNullSafe(F.lit(name)))
        best = S.batch_search(spark, own, these.select("query_id", "vector"), k, "_row")
        shown = best.join(own.select(F.col("_row").alias("id"), "text"), "id").where(F.coalesce("text", F.lit("")) != "")
        part = shown.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda r: r["text"]), "\n").alias("context"))
        out = part if out is None else out.unionByName(part)
    held = asked.drop("vector")
    return (held.join(out, "query_id", "left") if out is not None else held.withColumn("context", F.lit(""))).withColumn("context", F.coalesce("context", F.lit(""))).drop("query_id")


def run_suite(suite: DataFrame, judge_recall: Callable[[str, str, str], dict], generate: Callable[[str, str], str], judge_faith: Callable[[str, str], dict]) -> DataFrame:
    """Entries (question, expected_answer, namespace, context) with context_recall, faithfulness and verdict.

    The models are called on executors, in Arrow batches. An entry that a model fails has null scores and the verdict FAIL.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for question, expected, name, context in zip(batch["question"], batch["expected_answer"], batch["namespace"], batch["context"]):
                try:
                    seen = judge_recall(question, expected, context)
                    recall = float(seen["confidence"]) * (1.0 if seen["contains_answer"] else 0.3)
                    out.append((question, name, recall, float(judge_faith(context, generate(question, context))["score"])))
                except Exception:  # noqa: BLE001 - an injected model may fail in any way
                    out.append((question, name, None, None))
            yield pd.DataFrame(out, columns=["question", "namespace", "context_recall", "faithfulness"])

    rows = suite.select("question", "expected_answer", "namespace", "context").mapInPandas(run, "question string, namespace string, context_recall double, faithfulness double")
    return rows.withColumn("verdict", F.coalesce(verdict(F.col("context_recall"), F.col("faithfulness")), F.lit("FAIL")))
