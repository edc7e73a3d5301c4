"""Full-text index: for each token, blocks of the points that hold it.

A block is one row: token, namespace, slice (a hash range of paths), the least and greatest key in it, how many keys, and the keys. A key is the place of a
point in its slice, by namespace, path and chunk; which points these are is listed once, by batch, beside the blocks. All chunks of a file lie in
one slice, so a text match is decided slice by slice and a token that every point holds is spread over all slices. Blocks lie in
Parquet folders by batch and bucket, a hash range of tokens: a search opens the buckets of its own tokens and no other.

Each indexing run is a batch of its own. It adds blocks and a list of its files and rewrites nothing; of a file that several
batches list, the last one counts, and a file that it lists as gone has no points. Running a batch again replaces that batch only.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import read_or_empty
from . import search as S

#: Folders of tokens; points of a batch for each slice, which bounds the keys of a block but for files of more chunks.
BUCKETS, SLICE = 64, 4096
#: Slices whose points one task lists.
LISTED = 32
BLOCK = "token string, namespace string, slice long, lo int, hi int, n long, keys array<int>, batch long, bucket int"
PLACES = "namespace string, path string, chunk long, slice long, place int, batch long"
FILES = "namespace string, path string, gone boolean, batch long"


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def placed(points: DataFrame, slices: int, tasks: int, *rest: Column) -> DataFrame:
    """(namespace, path, chunk, ..., slice, place): a slice is in one task, which numbers its points. Points alone decide the numbers, whatever goes with them."""
    part = F.pmod(F.xxhash64("namespace", "path"), F.lit(slices)).alias("slice")
    dealt = points.select("namespace", "path", F.col("chunk").cast("long").alias("chunk"), *rest, part).repartition(tasks, "slice")
    return dealt.withColumn("place", F.row_number().over(Window.partitionBy("slice").orderBy("namespace", "path", "chunk")))


def _told(blocks: DataFrame) -> DataFrame:
    """Blocks with what follows from their token and keys; it is added after a shuffle, not carried through it."""
    return blocks.withColumns({"lo": F.get("keys", F.lit(0)), "hi": F.element_at("keys", -1), "n": F.size("keys").cast("long"), "bucket": bucket_of(F.col("token"))})


def _grouped(points: DataFrame, slices: int) -> DataFrame:
    """(token, namespace, slice, keys) of points.

    Points are shuffled by slice, their tokens as one text, and each slice's tokens are grouped where they are.
    """
    own = placed(points, slices, slices, F.to_json(F.array_distinct("tokens")).alias("tokens"))
    each = own.select("namespace", "slice", "place", F.explode(F.from_json("tokens", "array<string>")).alias("token"))
    return each.groupBy("token", "namespace", "slice").agg(F.sort_array(F.collect_list("place")).alias("keys"))


def blocks(points: DataFrame, slices: int) -> DataFrame:
    """Points (namespace, path, chunk, tokens) to blocks, without a batch. Points without a token have none."""
    return _told(_grouped(points, slices))


def _put(df: DataFrame, path: str, *by: str) -> None:
    df.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(path)


def add(points: DataFrame, root: str, batch: int, files: DataFrame | None = None, gone: DataFrame | None = None) -> None:
    """Index a batch of points. ``files`` (namespace, path) names all its files, those without a point too (by default those of the points), ``gone`` those that are no more."""
    spark = points.sparkSession
    slices = max(1, math.ceil(points.count() / SLICE))
    listing = placed(points.select("namespace", "path", "chunk"), slices, math.ceil(slices / LISTED)).withColumn("batch", F.lit(batch).cast("long"))
    _put(listing, f"{root}/places", "batch")
    # the blocks of a bucket lie in one file, by token, so that its statistics tell where a token can be
    made = _told(_grouped(points, slices).repartition(BUCKETS, bucket_of(F.col("token")))).sortWithinPartitions("bucket", "token", "namespace", "slice")
    _put(made.withColumn("batch", F.lit(batch).cast("long")), f"{root}/blocks", "batch", "bucket")
    own = (points if files is None else files).select("namespace", "path", F.lit(False).alias("gone"))
    lost = spark.createDataFrame([], "namespace string, path string, gone boolean") if gone is None else gone.select("namespace", "path", F.lit(True).alias("gone"))
    # a file that is listed both ways is there
    listed = own.unionByName(lost).groupBy("namespace", "path").agg(F.min("gone").alias("gone"))
    _put(listed.withColumn("batch", F.lit(batch).cast("long")), f"{root}/files", "batch")


def posted(spark: SparkSession, root: str) -> DataFrame:
    """(batch, namespace, path, chunk, tokens): the index turned round, each point that has tokens with those under which it is held, sorted."""
    held, places = spark.read.schema(BLOCK).parquet(f"{root}/blocks"), spark.read.schema(PLACES).parquet(f"{root}/places")
    dealt = held.select("batch", "slice", "token", "keys").repartition(max(1, math.ceil(places.count() / SLICE)), "batch", "slice")
    each = dealt.select("batch", "slice", "token", F.explode("keys").alias("place")).groupBy("batch", "slice", "place").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    return places.join(each, ["batch", "slice", "place"]).select("batch", "namespace", "path", "chunk", "tokens")


def batches(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the batches, from the names of their folders."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/files")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return sorted(int(f.getPath().getName()[6:]) for f in found if f.getPath().getName().startswith("batch="))


def current(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """Those of rows (namespace, path, batch, ...) whose file no later batch lists.

    Files of the first batch, which is the bulk of an index, are not looked at, as nothing is older than they are.
    """
    known = batches(spark, root)
    if len(known) < 2:
        return rows
    later = spark.read.schema(FILES).parquet(f"{root}/files").where(F.col("batch") > known[0]).select(F.col("namespace").alias("_n"), F.col("path").alias("_p"), F.col("batch").alias("_b"))
    return rows.join(later, (F.col("namespace") == F.col("_n")) & (F.col("path") == F.col("_p")) & (F.col("batch") < F.col("_b")), "left_anti")


def _blocks_of(spark: SparkSession, root: str, tokens: list[str]) -> DataFrame:
    """The blocks of these tokens; only their buckets' folders are listed and opened."""
    buckets = {r[0] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select(bucket_of(F.col("t"))).collect()}  # a row a word of the query
    try:
        held = spark.read.schema(BLOCK).option("basePath", f"{root}/blocks").parquet(f"{root}/blocks/batch=*/bucket={{{','.join(map(str, sorted(buckets)))}}}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], BLOCK)
    return held.where(F.col("token").isin(*tokens))


def matches(spark: SparkSession, root: str, words: str, namespace: str | None = None) -> DataFrame:
    """(namespace, path, chunk) of the points that hold all tokens of the query; without a token, of none.

    Only blocks of the query's tokens are read. In a slice that lacks one of them nothing matches; in the others the keys are cut from
    the rarest token on.
    """
    tokens = S.query_tokens(words)
    own = S.in_namespace(_blocks_of(spark, root, tokens), namespace)
    met = own.groupBy("batch", "namespace", "slice").agg(F.sort_array(F.collect_list(F.struct("n", "keys"))).alias("b"), F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    cut = F.aggregate(F.slice("b", 2, len(tokens)), F.get("b", F.lit(0))["keys"], lambda a, x: F.array_intersect(a, x["keys"]))
    # ranges of keys that do not overlap have none in common
    found = met.where((F.size("b") == len(tokens)) & (F.col("lo") <= F.col("hi"))).select("batch", "slice", F.explode(cut).alias("place"))
    found = read_or_empty(spark, f"{root}/places", PLACES).join(found, ["batch", "slice", "place"]).select("batch", *S.KEY)
    return current(spark, root, found).select(*S.KEY)


def keyword_search(spark: SparkSession, root: str, words: str, k: int = 10, namespace: str | None = None, rrf_k: int = S.RRF_K) -> DataFrame:
    """As ``search.keyword_search``, by the index alone: no point is read."""
    return S.fuse([(S.ranked(matches(spark, root, words, namespace), S.PREFETCH * k, [F.col(c) for c in S.KEY]), 1.0)], k, rrf_k)


def hybrid_search(spark: SparkSession, points: DataFrame, root: str, query: list[float], words: str, k: int = 10, namespace: str | None = None, dense: float = 1.0, sparse: float = 1.0, rrf_k: int = S.RRF_K) -> DataFrame:
    """As ``search.hybrid_search``: similarity by a scan of the vectors, text match by the index."""
    depth, order = S.PREFETCH * k, [F.col(c) for c in S.KEY]
    near = S.ranked(S.scored(points.select(*S.KEY, "vector"), query, namespace), depth, [F.desc("score"), *order])
    return S.fuse([(near, dense), (S.ranked(matches(spark, root, words, namespace), depth, order), sparse)], k, rrf_k)
