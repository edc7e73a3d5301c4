"""Exact dedup through an extendible-hash index on shared files, in DataFrame operations only.

Keys: every row's hash of its normalised text, 64 bits, beside its id on shared files. Counts by hash tell the hot ones.

Directory: doubling from depth 0, a bucket (the leading bits of the hash) with more than ``capacity`` hashes
splits until it fits. Only the counts by leading bits take part; their number follows the hashes, so all tasks get the
directory while it has at most ``SENT`` rows, and it is joined beyond.

Owners: each row goes through the directory to its bucket, and the buckets of a range of keys to one owner task, which
sorts them by hash and text. Texts are compared byte by byte there: equal ones are a group, different ones of one hash a chain. The
owner decides who stays, and writes the bucket's entries (hash, keep_id, size, digest); only chains keep their texts. Copies of a hash with more than a share
of 1 / ``HOT`` of all rows, of which there can't be more than HOT, are combined before they are sent, so no owner gets them row by row.

Probe: a row's hash leads through the directory to its bucket, where it meets the bucket's entries; in a chain, the bytes of the
text decide. Entries of hot groups go to all tasks, and their rows are dealt evenly.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Hashes a bucket holds before it splits; how far the directory may go beyond an even split.
CAPACITY, SPARE_DEPTH = 8192, 3
#: Rows of the directory up to which it is sent to all tasks (16 bytes each); largest number of groups that count as hot, and in how many parts their rows are dealt.
SENT, HOT, PARTS = 1 << 18, 1000, 4096


def normalised(text: str | Column) -> Column:
    """The text with each run of blanks, tabs and line ends as one space; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def directory(index: DataFrame, capacity: int, max_depth: int) -> DataFrame:
    """The directory: leaf (leading max_depth bits of a hash), depth (of its bucket), start (the bucket's first leaf), n_entries.

    A bucket doubles from depth 0 until it fits or max_depth is reached: a leaf's bucket is its shortest prefix that fits.
    At most 2**max_depth rows; that depth is chosen by the number of entries, so only a chain can hold more than the capacity.
    """
    leaves = index.groupBy(F.shiftrightunsigned("_hash", 64 - max_depth).alias("leaf")).agg(F.count(F.lit(1)).alias("n"))
    prefix = F.expr(f"shiftright(leaf, {max_depth} - depth)").alias("prefix")
    levels = leaves.select("leaf", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")).select("*", prefix)
    sized = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("n_entries")).where((F.col("n_entries") <= capacity) | (F.col("depth") == max_depth))
    found = levels.join(sized, ["depth", "prefix"]).groupBy("leaf").agg(F.min(F.struct("depth", "prefix", "n_entries")).alias("b"))
    return found.select("leaf", "b.depth", F.expr(f"shiftleft(b.prefix, {max_depth} - b.depth)").alias("start"), "b.n_entries")


def _placed(rows: DataFrame, found: DataFrame, depth: int, small: bool) -> DataFrame:
    """rows with ``start``, the bucket to which the directory leads their _hash."""
    leaves = found.select("leaf", "start")
    return rows.join(F.broadcast(leaves) if small else leaves, F.shiftrightunsigned("_hash", 64 - depth) == F.col("leaf"), "left").drop("leaf")


def keys(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=F.xxhash64) -> DataFrame:
    """_id and _hash of each row, on shared files."""
    return shared.table(spark, docs.select(F.col(id_col).alias("_id"), hash_of(normalised(text_col)).alias("_hash")), "hash-keys")


def build_index(spark: SparkSession, docs: DataFrame, keyed: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=F.xxhash64, capacity: int = CAPACITY) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The index on shared files, and what adds the bucket to rows that have a _hash. ``keyed``: the keys of docs.

    An entry: _hash, keep_id, group_size, text_sha256, chained (its text where others have its hash, else null), start (of its
    bucket). Each bucket lies in one file, in order of its hashes; an owner task decides and writes the buckets of a range of keys.
    """
    counts = shared.table(spark, keyed.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")), "hash-counts")
    seen = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("hashes")).first()
    depth = min(60, max(1, math.ceil(math.log2(max(seen["hashes"], 1) / capacity + 1)) + SPARE_DEPTH))
    found = shared.table(spark, directory(counts, capacity, depth), "hash-directory")
    small = found.count() <= SENT
    hot = counts.where(F.col("n") * HOT > seen["rows"]).select("_hash")  # fewer than HOT rows
    norm = normalised(text_col)
    rows = docs.select(F.col(id_col).alias("keep_id"), norm.alias("_norm"), hash_of(norm).alias("_hash"))
    few = rows.join(F.broadcast(hot), "_hash", "left_semi").groupBy("_hash", "_norm").agg(F.min("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    each = rows.join(F.broadcast(hot), "_hash", "left_anti").withColumn("group_size", F.lit(1).cast("long"))
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a bucket's first leaf, as a share of all leaves, tells its owner: ranges of keys, one a task
    owner = F.least(F.floor(F.col("start").cast("double") * owners / float(1 << depth)), F.lit(owners - 1)).cast("int")
    sent = _placed(each.unionByName(few), found, depth, small).withColumn("_owner", owner).repartitionById(owners, "_owner")
    groups = sent.groupBy("_owner", "start", "_hash", "_norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    chain = F.count(F.lit(1)).over(Window.partitionBy("_owner", "start", "_hash"))
    entries = groups.select("_owner", "start", "_hash", "keep_id", "group_size", F.sha2("_norm", 256).alias("text_sha256"), F.when(chain > 1, F.col("_norm")).alias("chained"))
    index = shared.table(spark, entries.sortWithinPartitions("start", "_hash", "keep_id").drop("_owner"), "hash-index")
    return index, lambda probes: _placed(probes, found, depth, small)


def classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=F.xxhash64) -> DataFrame:
    """Per row of docs: id, keep_id, group_size, kept, text_sha256 of the normalised text.

    Null texts equal empty ones; texts of any length are compared whole. An empty table gives an empty result. Rows without
    an id are kept only if no row of their group has one. Rows that repeat both id and text are one group and all carry the same flags
    (``kept_rows`` leaves one of them). Other columns of docs are not looked at, whatever their names.
    """
    shared.fresh(docs, id_col, text_col)
    keyed = keys(spark, docs, id_col, text_col, hash_of)
    index, placed = build_index(spark, docs, keyed, id_col, text_col, hash_of)
    total = keyed.count()
    chains = not index.where("chained IS NOT NULL").isEmpty()
    entry = F.struct("keep_id", "group_size", "text_sha256").alias("_entry")
    hot = index.where((F.col("group_size") * HOT > total) & F.col("chained").isNull()).select("_hash", entry.alias("_hot"))  # fewer than HOT rows
    norm = normalised(text_col)
    # texts are read again only where a chain must be told apart
    rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"), hash_of(norm).alias("_hash")) if chains else keyed
    # a row of a hot group has its entry by now; its part differs from that of all entries, so the join deals it anywhere
    part = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("_id"), F.lit(PARTS)) + 1).otherwise(0).cast("int")
    probes = placed(rows.join(F.broadcast(hot), "_hash", "left")).withColumn("_part", part)
    own = index.select("_hash", "start", F.lit(0).alias("_part"), *["chained"] * chains, entry)
    on = [probes[c] == own[c] for c in ("start", "_hash", "_part")]
    if chains:
        on.append(own["chained"].isNull() | (own["chained"] == probes["_norm"]))
    found = probes.join(own, on, "left").select("_id", F.coalesce("_hot", "_entry").alias("_entry"))
    return found.select(F.col("_id").alias(id_col), "_entry.keep_id", "_entry.group_size", F.col("_id").eqNullSafe(F.col("_entry.keep_id")).alias("kept"), "_entry.text_sha256")


def kept_rows(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names; of rows that repeat both id and text, one."""
    key, sha = shared.unused(docs, "_keep", "_sha")
    kept = classes(spark, docs, id_col, text_col).where("kept").select(F.col(id_col).alias(key), F.col("text_sha256").alias(sha)).distinct()
    same = docs[id_col].eqNullSafe(kept[key])
    if docs.groupBy(id_col).count().where("count > 1").isEmpty():
        return docs.join(kept, same, "left_semi")
    # ids that repeat: decide by text too
    digest = F.sha2(normalised(docs[text_col]), 256)
    return docs.join(kept, same & (digest == kept[sha]), "left_semi").withColumn(sha, digest).dropDuplicates([id_col, sha]).drop(sha)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""
