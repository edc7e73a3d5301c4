"""A point table that changes in place, in the buckets that a change touches.

Points lie in Parquet folders by namespace and bucket, a hash range of paths, so all chunks of a file lie in one. A change reads the
buckets of its files, puts what they hold from now on to the shared folder and overwrites just these partitions
from there; no other file is opened or renamed. Until the overwrite nothing has changed, so a change that fails before leaves the
table as it was, and one that fails in it is made whole by running it again: the buckets it had replaced give the same rows.

A bucket that a change has emptied keeps one row without a path, as a partition without rows would not be overwritten. ``read`` leaves these out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..workspace import work_dir

#: Buckets of a namespace.
BUCKETS = 64
PLACE = ("namespace", "bucket")


def bucket_of(path: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, root: str) -> None:
    rows.write.partitionBy(*PLACE).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(root)


def _laid(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", bucket_of(F.col("path"), buckets))


def create(points: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Write points (namespace, path, ...) as a new table."""
    made = _laid(points, buckets)
    made.repartition(*PLACE).sortWithinPartitions(*PLACE, "path").write.partitionBy(*PLACE).option("compression", "zstd").parquet(root)


def _all(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    places = StructType.fromDDL("namespace string, bucket int")
    return spark.read.schema(StructType([*(f for f in schema if f.name not in PLACE), *places])).parquet(root)


def read(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The points of the table, with the columns of ``schema``."""
    return _all(spark, root, schema).where("path IS NOT NULL").select(*schema.names)


def touched_rows(spark: SparkSession, root: str, schema: StructType, touched: DataFrame) -> DataFrame:
    """The rows of the buckets (namespace, bucket) of ``touched``; folders of other buckets and of other namespaces are not opened."""
    sets = touched.agg(F.collect_set("namespace").alias("n"), F.collect_set("bucket").alias("b")).first()  # namespaces, and BUCKETS numbers
    return _all(spark, root, schema).where(F.col("namespace").isin(*sets["n"]) & F.col("bucket").isin(*sets["b"])).join(touched, list(PLACE), "left_semi")


def change(spark: SparkSession, root: str, new: DataFrame, gone: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Put ``new`` points in place of all points of their files, and take the files ``gone`` (namespace, path) out.

    A file in both has the new points. The table must have been created with as many buckets.
    """
    key = ["namespace", "path"]
    files = new.select(*key) if gone is None else new.select(*key).unionByName(gone.select(*key))
    files = _laid(files.distinct(), buckets)
    touched = F.broadcast(files.select(*PLACE).distinct())  # at most as many rows as buckets of the namespaces
    schema = new.schema
    stay = touched_rows(spark, root, schema, touched).where("path IS NOT NULL").join(files.select(*key), key, "left_anti")
    empty = touched.select(*(F.col(f.name) if f.name in PLACE else F.lit(None).cast(f.dataType).alias(f.name) for f in [*schema, *StructType.fromDDL("bucket int")] if f.name != "bucket"), "bucket")
    rows = stay.select(*schema.names, "bucket").unionByName(_laid(new, buckets)).unionByName(empty)
    staged = f"{work_dir(spark)}/change-{uuid.uuid4().hex}"
    rows.repartition(*PLACE).sortWithinPartitions(*PLACE, "path").write.parquet(staged)
    where = spark._jvm.org.apache.hadoop.fs.Path(staged)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        _write(spark.read.schema(rows.schema).parquet(staged), root)
    finally:
        system.delete(where, True)
