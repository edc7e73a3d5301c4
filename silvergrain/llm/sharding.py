"""Shards of near equal size by sampled splitters.

Records are ordered by key: the hash of their text, then that of their id. So equal texts lie together, and a group that is larger
than it may be is divided by ids. A sample that draws records in proportion to their size gives quantiles of bytes, not of rows; its
boundaries cut the order into ranges, the rows of a range meet in one task, and a range that came out overfull is
divided again by a sample of its own rows. Exact sizes of ranges and a running sum inside each give every record its place
in the order, and the place its shard.

Law ``bytes``: a record belongs to the shard in whose part of the total the middle of its bytes lies. A group of equal texts that holds at
most 1 / TOGETHER of a shard, and a quarter of a range, is placed as one record; larger ones are cut. Shards therefore differ by less than
the larger of two such groups and two records.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

SHARDS = 8
#: Part of a shard's bytes up to which a group of equal texts stays together.
TOGETHER = 100
#: Ranges by shuffle partition, at least and at most; records drawn for each range; times the mean from which a range is overfull; rounds of division.
EACH, LEAST, MOST, DRAWN, OVERFULL, ROUNDS = 4, 256, 1 << 16, 32, 3, 6
KEY = ("_group", "_salt")


def text_size(text: Column) -> Column:
    """Bytes of the text in UTF-8, and one for the record."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def keyed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rows with _group and _salt, the two parts of the key, and _size. Null and empty texts are one group."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return rows.withColumns({"_group": F.xxhash64(text), "_salt": F.xxhash64(F.col(id_col), F.lit("shard")), "_size": text_size(F.col(text_col))})


def _drawn(rows: DataFrame, rate: Column, seed: int) -> DataFrame:
    """Keys of records drawn in proportion to their size: ``_times`` is size * rate, rounded up or down by a hash of the key."""
    even = F.pmod(F.xxhash64(*KEY, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return rows.select(*KEY, F.floor(F.col("_size") * rate + even).alias("_times")).where("_times > 0")


def _boundaries(drawn: pd.DataFrame, every: float) -> np.ndarray:
    """Keys (n, 2) at the sample's quantiles. A group that takes one boundary starts at it; one that takes several is divided by salt."""
    drawn = drawn.sort_values(list(KEY), kind="stable")
    ends = drawn["_times"].cumsum().to_numpy()
    at = np.searchsorted(ends, np.arange(every, ends[-1] if len(ends) else 0, every), side="left")
    keys = drawn[list(KEY)].to_numpy(dtype=np.int64)[np.unique(at)]
    first = np.concatenate([[True], keys[1:, 0] != keys[:-1, 0]]) if len(keys) else np.zeros(0, bool)
    keys[first, 1] = np.iinfo(np.int64).min
    return np.unique(keys, axis=0) if len(keys) else keys.reshape(0, 2)


def _ranged(rows: DataFrame, edges: np.ndarray) -> DataFrame:
    """rows with ``_range``: how many of the sorted edges are at or below their key."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((edges[:, 0].copy(), edges[:, 1].copy()))  # MOST rows of 16 bytes at most, a few more for overfull ranges

    @F.pandas_udf("int")
    def place(groups: pd.Series, salts: pd.Series) -> pd.Series:
        heads, tails = sent.value
        g, s = groups.to_numpy(), salts.to_numpy()
        low, high = np.searchsorted(heads, g, side="left"), np.searchsorted(heads, g, side="right")
        for i in np.flatnonzero(high > low):
            low[i] += np.searchsorted(tails[low[i] : high[i]], s[i], side="right")
        return pd.Series(low.astype("int32"))

    return rows.withColumn("_range", place(*KEY))


def splitters(spark: SparkSession, rows: DataFrame) -> tuple[np.ndarray, pd.DataFrame, int]:
    """The edges of ranges over keyed rows, (_range, bytes, n) of each range, and the number of ranges aimed at. Edges are at most a few times MOST rows."""
    ranges = min(MOST, max(LEAST, EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    total = rows.agg(F.sum("_size")).first()[0] or 0
    rate = ranges * DRAWN / max(total, 1)
    edges = _boundaries(_drawn(rows, F.lit(rate), 0).toPandas(), DRAWN)  # ranges * DRAWN draws, whatever the input
    for seed in range(1, ROUNDS + 1):
        placed = _ranged(rows, edges)
        sizes = placed.groupBy("_range").agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("n"), (F.min(F.struct(*KEY)) != F.max(F.struct(*KEY))).alias("divisible")).toPandas()
        over = sizes[(sizes["bytes"] > OVERFULL * total / ranges) & sizes["divisible"]]
        if seed == ROUNDS or not len(over):
            break
        again = placed.join(F.broadcast(spark.createDataFrame(over[["_range"]])), "_range", "left_semi")  # fewer rows than ranges
        # drawn more finely each round, so a range that no boundary has met yet gets one
        grown = np.unique(np.concatenate([edges, _boundaries(_drawn(again, F.lit(rate * 2**seed), seed).toPandas(), DRAWN)]), axis=0)
        if len(grown) == len(edges):
            break
        edges = grown
    return edges, sizes, ranges


def assigned(spark: SparkSession, rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Keyed rows with ``shard`` and ``slot``, the place in the shard; other columns stay.

    Null texts count as empty, so they and empty ones are equal and hold the record's byte alone. Rows without an id, and rows that repeat one, are
    placed each; rows that tie in id and text may change places. Texts of any length are one record. An empty table gives an empty result.
    """
    edges, sizes, ranges = splitters(spark, rows)
    sizes = sizes.sort_values("_range")
    total = int(sizes["bytes"].sum())
    starts = [(int(r), int(s)) for r, s in zip(sizes["_range"], sizes["bytes"].cumsum() - sizes["bytes"])]
    placed = _ranged(rows, edges).join(F.broadcast(spark.createDataFrame(starts, "_range int, _start long")), "_range")  # a row a range
    order, group = Window.partitionBy("_range").orderBy(*KEY), Window.partitionBy("_range", "_group")
    before = F.coalesce(F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_start")
    placed = placed.withColumn("_before", before).withColumns({"_first": F.min("_before").over(group), "_bytes": F.sum("_size").over(group)})
    # a group well below a range has no edge inside
    whole = F.col("_bytes") * max(TOGETHER * shards, 4 * ranges) <= total
    unit = placed.withColumns({"_begin": F.when(whole, F.col("_first")).otherwise(F.col("_before")), "_span": F.when(whole, F.col("_bytes")).otherwise(F.col("_size"))})
    # twice the middle, in whole numbers
    dealt = unit.withColumn("shard", F.expr(f"cast(least((2 * _begin + _span) * {shards} div {max(2 * total, 1)}, {shards - 1}) AS int)"))
    counts = dealt.groupBy("_range", "shard").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("_range").alias("_r"), F.col("shard").alias("_s"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))  # little more than a row a range
    numbered = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_range", "shard").orderBy(*KEY)))
    found = numbered.join(F.broadcast(bases), (F.col("_range") == F.col("_r")) & (F.col("shard") == F.col("_s")))
    return found.withColumn("slot", F.col("_base") + F.col("_i") - 1).drop("_range", "_start", "_before", "_first", "_bytes", "_begin", "_span", "_i", "_r", "_s", "_base")


def slim(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size and text_crc32 of each record with its key, on the shared folder: all that shards are decided by. Texts are read once and not shuffled."""
    shared.fresh(docs, id_col, text_col)
    own = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "doc_id", "_text")
    return shared.table(spark, own.select("doc_id", F.col("_size").alias("size"), F.crc32(F.coalesce("_text", F.lit(""))).alias("text_crc32"), *KEY, "_size"), "shard-keys")


def shards_of(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, shard, slot. Cases as for ``assigned``; further columns are not looked at."""
    return assigned(spark, slim(spark, docs, id_col, text_col), shards).drop(*KEY, "_size")


def write_shards(spark: SparkSession, docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", files: int = 4) -> None:
    """docs, whole, as Parquet in a folder a shard (``shard=0`` and on), in the order of their slots within each of its files.

    A shard is a stretch of the order of keys, so its first key is all a record needs to find it.
    """
    # named apart from the columns of docs, whatever they are called
    g, s, at, part = shared.unused(docs, "_group", "_salt", "shard", "_part")
    firsts = assigned(spark, slim(spark, docs, id_col, text_col), shards).groupBy("shard").agg(F.min(F.struct(*KEY)).alias("k")).orderBy("shard").collect()  # a row a shard
    own = docs.withColumns({g: F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), s: F.xxhash64(F.col(id_col), F.lit("shard"))})
    key = F.struct(F.col(g).alias("_group"), F.col(s).alias("_salt"))
    shard = F.lit(firsts[0]["shard"] if firsts else 0)
    for r in firsts[1:]:
        shard = F.when(key >= F.struct(F.lit(r["k"]["_group"]).alias("_group"), F.lit(r["k"]["_salt"]).alias("_salt")), r["shard"]).otherwise(shard)
    dealt = own.withColumns({at: shard, part: F.pmod(F.col(s), F.lit(files))})
    dealt.repartition(max(1, shards * files), at, part).sortWithinPartitions(at, g, s).drop(g, s, part).write.partitionBy(at).option("compression", "zstd").parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards_of(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
