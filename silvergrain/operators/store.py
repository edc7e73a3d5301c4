"""Points, their full-text index and their counts kept together below one folder, and changed together.

``points`` is a table that changes in place (``point_table``), ``text`` the postings and ``counts`` the sketches. A change is numbered: running
it again with its number gives the same store, so a change that broke off half-way is made whole by repeating it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..workspace import work_dir
from . import index, point_table, postings, sketches

KEY = ["namespace", "path"]


class Store:
    """The tables of one folder. ``buckets`` must be the same for as long as the folder is used."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = point_table.BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.schema = StructType.fromDDL(index.POINT)

    def points(self) -> DataFrame:
        return point_table.read(self.spark, f"{self.root}/points", self.schema)

    def exists(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/points")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def change(self, number: int, new: DataFrame, gone: DataFrame | None = None, files: DataFrame | None = None) -> None:
        """Put new points (``index.POINT``) in place of all points of their files, and take the files ``gone`` (namespace, path) out.

        ``files`` names all files that were indexed anew, those that have no point any more too. Points are made once: they are written to the
        shared folder before anything changes, since three tables take them from there.
        """
        made = f"{work_dir(self.spark)}/points-{uuid.uuid4().hex}"
        new.select(*self.schema.names).write.parquet(made)
        rows = self.spark.read.schema(self.schema).parquet(made)
        listed = rows.select(*KEY) if files is None else files.select(*KEY).unionByName(rows.select(*KEY))
        lost = listed if gone is None else listed.unionByName(gone.select(*KEY))
        old = None
        if self.exists():
            # what the files held before, by an earlier run of this change too, counts as removed
            held = lost.distinct()
            places = F.broadcast(point_table._laid(held, self.buckets).select(*point_table.PLACE).distinct())
            old = point_table.touched_rows(self.spark, f"{self.root}/points", self.schema, places).join(held, KEY, "left_semi").select("namespace", "point_id")
        sketches.note(rows, old, f"{self.root}/counts", number)
        postings.add(rows, f"{self.root}/text", number, files=listed, gone=gone)
        if old is None:
            point_table.create(rows, f"{self.root}/points", self.buckets)
        else:
            point_table.change(self.spark, f"{self.root}/points", rows, lost, self.buckets)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(made)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def keyword_search(self, words: str, k: int = 10, namespace: str | None = None) -> DataFrame:
        return postings.keyword_search(self.spark, f"{self.root}/text", words, k, namespace)

    def hybrid_search(self, query: list[float], words: str, k: int = 10, namespace: str | None = None) -> DataFrame:
        return postings.hybrid_search(self.spark, self.points(), f"{self.root}/text", query, words, k, namespace)

    def counts(self) -> DataFrame:
        return sketches.counts(self.spark, f"{self.root}/counts")
