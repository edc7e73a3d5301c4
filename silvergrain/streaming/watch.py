"""A stream of file changes: a folder is listed again and again, and what differs from the last listing is handed on.

Each poll leaves two tables below a store: ``changes/poll=N`` (path, action, size, mtime: what ``delta.classify`` says, unchanged files left out) and ``state/poll=N``, the
listing with its hashes. Listings are read in parallel by Spark and compared by one join, so neither passes through the driver, and new
folders are met as any file is. Any stream may follow ``changes``. A poll that is repeated overwrites its own two folders
and gives the same as long as the files are the same, so a stream that is restarted from its checkpoint goes on where it broke off.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import delta
from ..sources import files
from ..workspace import read_or_empty

STATE = "path string, size long, mtime long, partial_hash string, full_hash string, last_seen long"
CHANGE = "path string, action string, size long, mtime long"
#: States that are kept: the last one, and the one before in case the last poll is repeated.
KEPT = 2


def listed(spark: SparkSession, root: str, hashed: bool = False) -> DataFrame:
    """path, size, mtime, partial_hash, full_hash of the files below; hashes only if asked for, as contents are read for them. A folder that is not there lists nothing."""
    if not _there(spark, root):
        return spark.createDataFrame([], STATE).drop("last_seen")
    if hashed:
        return files.hashes(files.walk(spark, root)).select("path", "size", "mtime", "partial_hash", "full_hash")
    return files.listing(spark, root).withColumns({"partial_hash": F.lit(None).cast("string"), "full_hash": F.lit(None).cast("string")})


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def state_before(spark: SparkSession, store: str, number: int) -> DataFrame:
    """The state that poll ``number`` is compared with: that of the poll before it."""
    return read_or_empty(spark, f"{store}/state/poll={number - 1}", STATE)


def poll(spark: SparkSession, root: str, store: str, number: int, hashed: bool = False) -> DataFrame:
    """Compare the folder with the state of the poll before, keep both outcomes, and return the changes (``CHANGE``)."""
    listing, before = listed(spark, root, hashed), state_before(spark, store, number)
    delta.next_state(listing, before, number, use_hash=hashed).write.mode("overwrite").parquet(f"{store}/state/poll={number}")
    # from here on the listing is what was written, so both tables speak of the same moment
    now = spark.read.schema(STATE).parquet(f"{store}/state/poll={number}")
    same = F.col("action").isin("TOUCH", "UNCHANGED")
    found = delta.classify(now.drop("last_seen"), before, use_hash=hashed).where(~same)
    found.join(now.select("path", "size", "mtime"), "path", "left").write.mode("overwrite").parquet(f"{store}/changes/poll={number}")
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/state/poll={number - KEPT}")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return spark.read.schema(CHANGE).parquet(f"{store}/changes/poll={number}")


def watch(spark: SparkSession, root: str, store: str, checkpoint: str, handle: Callable[[DataFrame, int], None] | None = None, every: str = "60 seconds", hashed: bool = False) -> StreamingQuery:
    """Poll at every tick of a clock; ``handle`` gets the changes of each poll, at least once, with its number."""

    def run(tick: DataFrame, number: int) -> None:
        changes = poll(tick.sparkSession, root, store, number, hashed)
        if handle is not None and not changes.isEmpty():
            handle(changes, number)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def changes(spark: SparkSession, store: str) -> DataFrame:
    """The changes of all polls, as they come, as a stream: path, action, size, mtime, poll."""
    return spark.readStream.schema(f"{CHANGE}, poll int").parquet(f"{store}/changes")
