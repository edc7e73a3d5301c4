"""The corpus pipeline: toxicity, exact dedup, near-dedup, suffix-array dedup, packing, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents, and further ones of any name that docs may have; the last returns the
pieces of the packed sequences.

Null texts count as empty; they are equal to each other and to blank ones, so exact dedup leaves one. Rows that repeat id and text
leave one, rows that repeat an id only are judged each until near-dedup, which takes them for one document. Rows without an id stay unless
a row with an id has their text. Of equal or near texts the smallest id stays. Texts of any length are worked on whole. Empty tables give
empty results, and without labels of both kinds nothing is toxic. Runs in one process may follow each other; of runs side by side over
the same folder, tables of finished stages stay until the session ends.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvergrain.llm import exact_dedup, near_dedup, packing, shared, suffix_dedup, toxicity


#: By folder and stage: tables that stages have left for their results, which read them until they are written.
_LEFT: dict[tuple[str, str], list[list[str]]] = {}


def _stage(before: str | None):
    """A stage that first removes what the stage before it kept on the shared folder: the result of that has been written by then.

    Where that stage has run several times since, any of its results may be still unread, and nothing is removed.
    """

    def wrapped(work):
        @functools.wraps(work)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            shared.ship(spark)
            left = _LEFT.pop((sf_dir, before), [])
            if len(left) == 1:
                shared.remove(spark, left[0])
            with shared.noted() as made:
                out = work(spark, docs, sf_dir)
            _LEFT.setdefault((sf_dir, work.__name__), []).append(list(made))
            return out

        return run

    return wrapped


@_stage(None)
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score reaches the decision; the model is fitted on labels of the documents given."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.kept_rows(spark, docs, toxicity.fit(spark, docs, labels))


@_stage("toxic")
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of documents equal but for white space, the one with the smallest id."""
    return exact_dedup.kept_rows(spark, docs)


@_stage("exact")
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return near_dedup.kept_rows(spark, docs)


@_stage("near")
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes long repeated strings out of the texts; a text of which nothing is left stays as an empty one."""
    return suffix_dedup.trimmed_rows(spark, docs).withColumn("n_chars", F.length("text").cast("long"))


@_stage("repeats")
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: the pieces, with digests of their ids."""
    return packing.pieces(spark, docs)


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("near-dedup", near), ("suffix-array dedup", repeats), ("packing", packed)]

#: SQL can't express token scores, samples or vocabularies; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage needed goes when the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        with shared.noted() as made:
            docs = shared.table(spark, out, f"pipeline-{name.replace(' ', '-')}")
        shared.remove(spark, last)
        last = list(made)
    return docs
