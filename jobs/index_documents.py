"""Keep a searchable index of a growing folder of documents.

    python jobs/index_documents.py --documents PATH --output PATH --checkpoint PATH [--config jobs/index_documents.json]

Documents (doc_id, text, lang, source) are Parquet files that arrive in a folder. Each run takes the files that its checkpoint has not
seen, cuts texts into chunks, reads relations off them and writes two tables below the output: ``chunks`` (by batch and namespace) and
``index`` (postings for text match by batch and bucket, and the files of each batch). A document that comes again, by its source and id,
replaces its earlier version; one whose text has become null is taken out. ``current`` gives the chunks as they stand. With the setting
``embedder``, ``package.module:factory``, chunks get vectors from what the factory returns, a function from texts to vectors.

A run that is repeated finds nothing new and changes nothing. A run that broke off repeats its last batch, which
overwrites the partitions of that batch. Of versions of a document in one batch, the one whose text sorts last counts.
"""

from __future__ import annotations

import importlib
import logging
import sys
from collections.abc import Callable
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from silvergrain.functions import relations as R
from silvergrain.functions import text as T
from silvergrain.operators import delta, index, postings

log = logging.getLogger("index_documents")
SETTINGS = {"files_per_batch": 1000, "chunk_words": T.CHUNK_SIZE, "overlap_words": T.CHUNK_OVERLAP, "default_namespace": "default", "embedder": None}
CHUNK = "namespace string, path string, chunk long, text string, relations string, tokens array<string>, vector array<float>, batch long"
STATE = ("namespace", "path")


def named(documents: DataFrame, default_namespace: str) -> DataFrame:
    """(namespace, path, text): the language is the namespace, source and id make the path."""
    path = F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".md"))
    return documents.select(F.coalesce("lang", F.lit(default_namespace)).alias("namespace"), path.alias("path"), "text")


def texts_of(documents: DataFrame, default_namespace: str) -> DataFrame:
    """(namespace, path, text), the last text of each."""
    return delta.latest(named(documents, default_namespace), list(STATE), ["text"])


def embedder_of(name: str | None) -> Callable[[list[str]], list[list[float]]] | None:
    """What ``package.module:factory`` makes."""
    if not name:
        return None
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)()


def chunks_of(texts: DataFrame, chunk_words: int, overlap_words: int, embed: Callable | None = None) -> DataFrame:
    """(namespace, path, chunk, text, relations, tokens and, with a model, vector), relations on first chunks."""
    own = texts.withColumn("relations", R.to_json(R.relations(F.col("path"), F.col("text"))))
    cut = index.chunks(own, chunk_words, overlap_words)
    first = F.when(F.col("chunk") == 0, F.col("relations")).otherwise("")
    made = cut.select("namespace", "path", F.col("chunk").cast("long").alias("chunk"), "text", first.alias("relations"), T.match_tokens(F.col("text")).alias("tokens"))
    return index.embedded(made, embed, "text") if embed else made


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, files_per_batch: int = 1000, chunk_words: int = T.CHUNK_SIZE, overlap_words: int = T.CHUNK_OVERLAP, default_namespace: str = "default", embedder: str | None = None) -> int:
    """Take in the files that are new; how many batches that took. Returns when all are written."""
    embed = embedder_of(embedder)

    def batch(part: DataFrame, number: int) -> None:
        own = part.sparkSession
        texts = texts_of(part, default_namespace)
        made = chunks_of(texts.where("text IS NOT NULL"), chunk_words, overlap_words, embed)
        made.withColumn("batch", F.lit(number).cast("long")).write.partitionBy("batch", "namespace").mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(f"{output}/chunks")
        # what follows reads what was written, not the documents again
        stored = own.read.schema(CHUNK).parquet(f"{output}/chunks").where(F.col("batch") == number)
        # a file with any text is there, since a null never counts as the last one: so files need no texts to be compared
        listed = named(part, default_namespace)
        postings.add(stored, f"{output}/index", number, files=listed.where("text IS NOT NULL"), gone=listed.where("text IS NULL"))
        counts = stored.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct(*STATE).alias("files")).first()
        log.info("batch %d: read %d documents of %s, wrote %d chunks of %d files to %s", number, part.count(), documents, counts["chunks"], counts["files"], output)

    schema = spark.read.parquet(documents).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(common.any_path(documents))
    done = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    done.awaitTermination()
    batches = sum(1 for p in done.recentProgress if p["numInputRows"])
    log.info("%s: %d new batches", documents, batches)
    return batches


def current(spark: SparkSession, output: str) -> DataFrame:
    """The chunks of all documents as they stand (``CHUNK``)."""
    return postings.current(spark, f"{output}/index", spark.read.schema(CHUNK).parquet(f"{output}/chunks"))


if __name__ == "__main__":
    common.main("index_documents", {"documents": "folder of Parquet files", "output": "folder of the two tables", "checkpoint": "folder of the stream's progress"}, run, SETTINGS)
