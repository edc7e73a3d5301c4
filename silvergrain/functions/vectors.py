"""Vector functions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; 0 for empty vectors, unequal lengths and zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0), 0.0).when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def is_zero(v: Column) -> Column:
    """No entry differs from 0; so for an empty vector."""
    return ~F.exists(v, lambda x: x != 0)


def mean_by(df, keys: list[str], vector: str):
    """Mean vector of each group: averages by position, put together again in order."""
    flat = df.select(*keys, F.posexplode(vector).alias("_pos", "_x"))
    means = flat.groupBy(*keys, "_pos").agg(F.avg(F.col("_x").cast("double")).alias("_mean"))
    return means.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_mean"))), lambda s: s["_mean"]).alias("centroid"))
