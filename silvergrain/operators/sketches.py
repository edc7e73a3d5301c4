"""Counts of points by namespace without a scan: theta sketches of point ids, kept beside the points.

Each indexing batch leaves one row a namespace: a sketch of the ids it added and one of those it removed. A count
merges the rows of all batches, in their order: union with what was added, difference by what was removed. Sketches of up to
2^LOG entries are exact; beyond that the estimate is off by about 1 / sqrt(2^LOG) of the count (2 % for 4096), more where most of the points have been removed.

The ids themselves lie beside the sketches, in a folder of the same name with ``-ids`` behind it, by batch. ``exact_counts`` reads those of the
namespaces whose sketches are full, and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = 12
ROW = "namespace string, added binary, removed binary, batch long"
#: ``there``: whether the batch added the id or removed it.
IDS = "namespace string, point_id string, batch long, there boolean"


def note(added: DataFrame, removed: DataFrame | None, root: str, batch: int) -> None:
    """Ids and sketches of a batch from (namespace, point_id) added and removed. Running it again replaces what it added, and adds to what it removed:
    a change that is repeated no longer finds what it has taken away already.

    A point that is in both was replaced and counts as added.
    """
    spark = added.sparkSession
    own = f"{root}-ids/batch={batch}"
    each = lambda df: df.select(F.col("namespace").cast("string").alias("namespace"), F.col("point_id").cast("string").alias("point_id"))
    each(added).write.mode("overwrite").parquet(f"{own}/there=true")
    each(added.limit(0) if removed is None else removed).write.mode("append").parquet(f"{own}/there=false")
    held = spark.read.schema("namespace string, point_id string")
    sketch = lambda there, name: held.parquet(f"{own}/there={there}").groupBy("namespace").agg(F.theta_sketch_agg("point_id", LOG).alias(name))
    both = sketch("true", "added").join(sketch("false", "removed"), "namespace", "full").withColumn("batch", F.lit(batch).cast("long"))
    both.write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)


def _merged(spark: SparkSession, root: str) -> DataFrame:
    """(namespace, sketch, batch, sure) of the points that are there: the last batch, and whether no sketch on the way can have been full."""
    rows = spark.read.schema(ROW).parquet(root)
    empty = spark.range(0).agg(F.theta_sketch_agg(F.col("id").cast("string"), LOG).alias("e")).first()["e"]

    def step(total: Column, s: Column) -> Column:
        left = F.when(s["removed"].isNull(), total).otherwise(F.theta_difference(total, s["removed"]))
        return F.when(s["added"].isNull(), left).otherwise(F.theta_union(left, s["added"], LOG))

    # a full sketch holds 2^LOG ids and stands for more
    size = lambda name: F.coalesce(F.theta_sketch_estimate(name), F.lit(0))
    sure = (F.sum(size("added")) <= 1 << LOG) & (F.max(size("removed")) <= 1 << LOG)
    steps = rows.groupBy("namespace").agg(F.sort_array(F.collect_list(F.struct("batch", "added", "removed"))).alias("s"), sure.alias("sure"))
    return steps.select("namespace", F.aggregate("s", F.lit(bytes(empty)), step).alias("sketch"), F.element_at("s", -1)["batch"].alias("batch"), "sure")


def _standing(spark: SparkSession, root: str) -> DataFrame:
    """(namespace, point_id, batch, there): each id as its last batch left it; within a batch what is added comes after what is removed."""
    last = F.max(F.struct("batch", "there"))
    return spark.read.schema(IDS).parquet(f"{root}-ids").groupBy("namespace", "point_id").agg(last.alias("_l")).select("namespace", "point_id", "_l.batch", "_l.there")


def counts(spark: SparkSession, root: str) -> DataFrame:
    """(namespace, n): about how many points each has. Reads a row a namespace and batch, and no point."""
    return _merged(spark, root).select("namespace", F.theta_sketch_estimate("sketch").alias("n"))


def exact_counts(spark: SparkSession, root: str) -> DataFrame:
    """(namespace, n): how many points each has, from its sketches where they can't have been full, else from its ids."""
    told = _merged(spark, root).select("namespace", F.theta_sketch_estimate("sketch").alias("n"), "sure")
    full = told.where("NOT sure").select(F.col("namespace").alias("_of"))
    counted = _standing(spark, root).join(full, F.col("namespace").eqNullSafe(F.col("_of")), "left_semi").groupBy("namespace").agg(F.count_if("there").alias("n"))
    return told.where("sure").select("namespace", "n").unionByName(counted)


def compact(spark: SparkSession, root: str, into: str) -> None:
    """One row a namespace in another folder: what counts read then does not grow with the number of batches, and later batches may follow. Ids that are gone go."""
    own = _merged(spark, root).select("namespace", F.col("sketch").alias("added"), F.lit(None).cast("binary").alias("removed"), "batch")
    own.write.partitionBy("batch").mode("overwrite").parquet(into)
    _standing(spark, root).where("there").write.partitionBy("batch", "there").mode("overwrite").parquet(f"{into}-ids")
