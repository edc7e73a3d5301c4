"""What the operators of this subpackage have in common: the shared folder, intermediate tables, shipping of the package."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..workspace import work_dir

#: Where tables were written, while someone keeps note of it.
_NOTES: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """Collects the paths of the tables that are written meanwhile."""
    own: list[str] = []
    _NOTES.append(own)
    try:
        yield own
    finally:
        _NOTES[:] = [n for n in _NOTES if n is not own]  # not by what it holds


def _placed(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        where, system = _placed(spark, path)
        system.delete(where, True)


def table(spark: SparkSession, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives the loss of any executor.

    Lazy results may read it as long as the session lasts; when the driver ends, it goes.
    """
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    where, system = _placed(spark, path)
    system.deleteOnExit(where)
    for own in _NOTES:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many marks behind it as it takes to differ from every column of df."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


class Kept(dict):
    """What a worker has made of keys it has met: at most about twice ``most`` of them, and none longer than LONG.

    When the newer half is full it becomes the older one, whose entries move back when they are asked for, so common keys stay.
    """

    LONG = 64

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        found = self.older.get(key)
        return self.put(key, self.make(key) if found is None else found)

    def put(self, key, value):
        if len(key) <= self.LONG:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value

    def lacking(self, keys: Iterable) -> set:
        """Those of the keys that would have to be made."""
        return {k for k in keys if k not in self and k not in self.older}


#: The caches of the operator that this worker served last.
_OWN: list = []


def sole(*caches) -> None:
    """Keep these caches (of functools) and empty those of the operator served before: a worker lives on from stage to stage, and so would what it holds."""
    for other in _OWN:
        if other not in caches:
            other.cache_clear()
    _OWN[:] = caches
    pa.default_memory_pool().release_unused()  # what batches of the task before took


def exact(rows: DataFrame, run: Callable, schema: str, *ids: str) -> DataFrame:
    """``rows.mapInPandas(run, schema)`` with integers in the columns ``ids`` kept as they are.

    pandas turns a column of integers that holds a null into doubles, which are exact up to 2**53 only; so these columns pass it as text.
    """
    made = StructType.fromDDL(schema)
    asked = {f.name: f.dataType for f in made if f.name in ids}
    for f in made:
        f.dataType = StringType() if f.name in ids else f.dataType
    done = rows.withColumns({n: F.col(n).cast("string") for n in ids}).mapInPandas(run, made)
    return done.withColumns({n: F.col(n).cast(t) for n, t in asked.items()})


def fresh(df: DataFrame, *names: str) -> None:
    """Fail early when a column that the operator needs is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"input lacks the columns {missing}; it has {df.columns}")


#: Rows in an Arrow batch, where the session does not say: texts may be long, and a worker holds a batch in several forms.
BATCH_ROWS, BATCH = 2048, "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a cluster gets it by --py-files), in batches of moderate size."""
    if not spark._jsparkSession.sessionState().conf().contains(BATCH):  # what is set, to the default too, stays
        spark.conf.set(BATCH, str(BATCH_ROWS))
    root = str(Path(__file__).resolve().parents[2])
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
