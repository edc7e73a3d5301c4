"""Sinks and small stores: webhooks, event fan-out, the registry as a file or a database table, settings from a file."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "id string, url string, collections array<string>, namespaces array<string>, protocol string, health_status string, last_heartbeat timestamp, registered_at timestamp, removed boolean"


def post_json(url: str, body: dict, seconds: float = 5) -> int:
    """Status of a POST, tried once more if the server fails (5xx)."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    for again in (True, False):
        try:
            with urllib.request.urlopen(request, timeout=seconds) as answer:
                return answer.status
        except urllib.error.HTTPError as e:
            if e.code < 500 or not again:
                return e.code
    return 0


def webhook(url: str, final_only: bool = True) -> Callable[[DataFrame, int], None]:
    """A handler of micro-batches (``events.in_batches``): a POST for each finished indexing, sent from executors."""

    def handle(batch: DataFrame, number: int) -> None:
        own = batch.where("status <> 'in_progress'") if final_only else batch
        bodies = own.select(F.to_json(F.struct(F.lit("namespace.indexed").alias("event"), *own.columns)).alias("body"))

        def send(rows: Iterator) -> None:
            for r in rows:
                post_json(url, json.loads(r["body"]))

        bodies.foreachPartition(send)

    return handle


def sent_events(send: Callable[[str], None], keepalive: float = 30.0, clock: Callable[[], float] = time.monotonic) -> Callable[[DataFrame, int], None]:
    """A handler of micro-batches that sends each event to a listener as a server-sent event, and a comment after a silence.

    A listener takes what one driver can pass on: events of finished files, not the files.
    """
    last = [clock()]

    def handle(batch: DataFrame, number: int) -> None:
        quiet = True
        for r in batch.select(F.to_json(F.struct(*batch.columns)).alias("body")).toLocalIterator():
            send(f"data: {r['body']}\n\n")
            last[0], quiet = clock(), False
        if quiet and clock() - last[0] >= keepalive:
            send(": keepalive\n\n")
            last[0] = clock()

    return handle


def fan_out(handlers: list[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """One batch to several handlers; one that fails does not keep it from the others, and is reported at the end."""

    def handle(batch: DataFrame, number: int) -> None:
        kept, failed = batch.persist(), []
        for h in handlers:
            try:
                h(kept, number)
            except Exception as e:  # noqa: BLE001
                failed.append(e)
        kept.unpersist()
        if failed:
            raise failed[0]

    return handle


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODE).json(path)


def append_registry(df: DataFrame, path: str) -> None:
    """The registry is a log: registrations and removals are appended, ``governance.latest_nodes`` reads what holds."""
    df.write.mode("append").json(path)


def registry_table(spark: SparkSession, url: str, table: str = "nodes", **options) -> DataFrame:
    """The registry in a database, ordered by registration; arrays are JSON there."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    arrays = {c: F.from_json(c, "array<string>") for c in ("collections", "namespaces") if dict(rows.dtypes).get(c) == "string"}
    return rows.withColumns(arrays).orderBy("registered_at")


def registry(spark: SparkSession, path: str | None = None, database: str | None = None, high_availability: bool = False) -> DataFrame:
    """The registry by what is set: several gateways need the database."""
    if database:
        return registry_table(spark, database)
    if high_availability:
        raise ValueError("several gateways need a database for the registry")
    if not path:
        raise ValueError("name a file or a database for the registry")
    return read_registry(spark, path)


def load_settings(path: str) -> dict[str, str]:
    """KEY=value lines of a file, split at the first sign; comments and blank lines are left out, and what is set already stays."""
    found = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in map(str.strip, f):
                key, sign, value = line.partition("=")
                if sign and not line.startswith("#"):
                    found[key.strip()] = os.environ.setdefault(key.strip(), value.strip().strip("\"'"))
    return found


def scrape_file(targets: DataFrame, path: str) -> None:
    """Targets (target, namespace) as a file of monitoring targets: one JSON array, put in place as a whole."""
    rows = [{"targets": [r["target"]], "labels": {"namespace": r["namespace"]}} for r in targets.orderBy("target").collect()]  # a row a node
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(rows, f)
    os.replace(path + ".tmp", path)
