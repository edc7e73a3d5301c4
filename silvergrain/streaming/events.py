"""Streams: debounced file events, indexing metrics, heartbeats, circuit breakers, retries.

The functions take batch or streaming DataFrames alike; on streams, event time and watermarks make them deterministic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..workspace import read_or_empty

DEBOUNCE, BATCH = "500 milliseconds", "200 milliseconds"
GONE = ("delete", "rename", "remove")


def read_events(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def debounced(events: DataFrame, gap: str = DEBOUNCE, late: str = "10 seconds") -> DataFrame:
    """events (path, op, ts): one a burst, at the last event plus the gap, with the last operation; deletions pass at once, beside it."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    rest = own.where(~F.col("op").isin(*GONE))
    bursts = rest.groupBy(F.session_window("ts", gap).alias("w"), "path").agg(F.max_by("op", "ts").alias("op"), F.count(F.lit(1)).alias("n"))
    settled = bursts.select("path", "op", F.col("w.end").alias("fired_at"), "n")
    gone = own.where(F.col("op").isin(*GONE)).select("path", "op", F.col("ts").alias("fired_at"), F.lit(1).cast("long").alias("n"))
    return settled.unionByName(gone)


def sessions(events: DataFrame, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def indexing_metrics(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and files by window, namespace and status."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    sums = own.groupBy(F.window("ts", width).alias("w"), "namespace", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("files_indexed").alias("files"))
    return sums.select(F.col("w.start").alias("window_start"), "namespace", "status", "n", "files")


def first_of_path(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events of a start-up walk and of the watcher: the first of each path."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path"])
    return events.groupBy("path").agg(F.min_by("op", "ts").alias("op"), F.min("ts").alias("ts"))


def in_batches(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, dead_letters: str | None = None, every: str = BATCH, once: bool = False) -> StreamingQuery:
    """Hand events to ``handle`` in micro-batches, at least once; a batch that fails goes to a table of dead letters, if one is named."""

    def run(batch: DataFrame, number: int) -> None:
        try:
            handle(batch, number)
        except Exception:
            if dead_letters is None:
                raise
            bury(batch, number, dead_letters)

    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def bury(batch: DataFrame, number: int, dead_letters: str) -> None:
    """A batch to the table of dead letters, a folder a batch; one that fails again replaces itself."""
    batch.withColumn("batch", F.lit(number).cast("long")).write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(dead_letters)


def micro_batches(events: DataFrame, by: str, width: str = BATCH) -> DataFrame:
    """(by, opened, n): batches of each node's events that open with an event and close a fixed time later, however many follow.

    Each opening depends on the one before, so a node's events pass one task in order; nothing but the open batch is held.
    """
    span = pd.Timedelta(width)
    kind = dict(events.dtypes)[by]

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, opened, n = None, None, 0
        for part in parts:
            out = []
            for key, ts in zip(part[by], part["ts"]):
                if opened is None or key != node or ts >= opened + span:
                    if opened is not None:
                        out.append((node, opened, n))
                    node, opened, n = key, ts, 0
                n += 1
            yield pd.DataFrame(out, columns=[by, "opened", "n"])
        if opened is not None:
            yield pd.DataFrame([(node, opened, n)], columns=[by, "opened", "n"])

    order = [by, "ts", *(c for c in ("event_id",) if c in events.columns)]
    return events.select(*order).repartition(by).sortWithinPartitions(*order).mapInPandas(fold, f"{by} {kind}, opened timestamp, n long")


def acknowledged(spark: SparkSession, dead_letters: str) -> DataFrame:
    """(batch) of the dead letters that have been handled."""
    return read_or_empty(spark, f"{dead_letters}-done", "batch long")


def retry(spark: SparkSession, dead_letters: str, handle: Callable[[DataFrame, int], None]) -> int:
    """Dead letters that wait, oldest batch first, up to the first that fails; how many were handled.

    A handled batch is acknowledged in a table beside the letters before the next one is begun, and no later run takes it again. A run that
    is lost between handling and acknowledging repeats that one batch, so the handler must be idempotent.
    """
    rows, done = spark.read.parquet(dead_letters), 0
    waiting = rows.select(F.col("batch").cast("long").alias("batch")).distinct().join(acknowledged(spark, dead_letters), "batch", "left_anti")
    for (number,) in waiting.orderBy("batch").collect():  # a number a batch that failed
        try:
            handle(rows.where(F.col("batch") == number).drop("batch"), number)
        except Exception:  # noqa: BLE001
            break
        spark.createDataFrame([(number,)], "batch long").coalesce(1).write.mode("append").parquet(f"{dead_letters}-done")
        done += 1
    return done


class Breaker(StatefulProcessor):
    """Opens after ``limit`` failures in a row for ``open_for`` seconds; the count outlives the opening, so one more failure opens it again."""

    def __init__(self, limit: int = 5, open_for: int = 300):
        self.limit, self.open_for = limit, open_for

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "failures int, until double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, until = self.state.get() if self.state.exists() else (0, 0.0)
        out = []
        for part in rows:
            for ts, ok in part.sort_values("ts")[["ts", "ok"]].itertuples(index=False):
                now = ts.timestamp()
                if now < until:
                    out.append((key[0], ts, "rejected"))
                elif ok:
                    failures, until = 0, 0.0
                    out.append((key[0], ts, "closed"))
                else:
                    failures += 1
                    until = now + self.open_for if failures >= self.limit else until
                    out.append((key[0], ts, "opened" if failures >= self.limit else "failed"))
        self.state.update((failures, until))
        yield pd.DataFrame(out, columns=["service", "ts", "state"])

    def close(self) -> None:
        pass


def breaker(events: DataFrame, limit: int = 5, open_for: int = 300) -> DataFrame:
    """What a circuit breaker does with each call (service, ts, ok) of a stream."""
    return events.groupBy("service").transformWithStateInPandas(Breaker(limit, open_for), "service string, ts timestamp, state string", "Append", "None")


def write_json(events: DataFrame, path: str, checkpoint: str | None = None):
    """Audit sink: JSON lines, appended."""
    if events.isStreaming:
        return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
    return events.write.mode("append").json(path)


def progress(indexed: DataFrame, every: int = 500) -> DataFrame:
    """A progress event (namespace, ts, files_indexed) for every so many files of a namespace, in the order in which they were done (namespace, path, ts).

    Files are numbered in two steps: counts of hours by namespace give each hour's start, and only an hour is ordered in one task.
    """
    hour = F.date_trunc("hour", "ts").alias("_hour")
    starts = indexed.groupBy("namespace", hour).agg(F.count(F.lit(1)).alias("_n"))
    before = starts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("namespace").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("namespace", "_hour").orderBy("ts", "path"))
    placed = indexed.select("namespace", "path", "ts", hour).withColumn("_i", inside).join(before, ["namespace", "_hour"])
    return placed.select("namespace", "ts", (F.col("_before") + F.col("_i")).alias("files_indexed")).where(F.col("files_indexed") % every == 0)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ts timestamp, user string, action string, namespace string, query string, results long, latency_ms long, status string, metadata map<string,string>").json(path)
