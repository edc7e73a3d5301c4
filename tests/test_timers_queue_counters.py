"""Streams with timers against their batch forms, the queue that forgets what is handled, counters, and the table that changes in place."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from silvergrain.operators import metrics, point_table
from silvergrain.streaming import events as E
from silvergrain.streaming import timers

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def signals(spark, rows):
    return spark.createDataFrame([(k, DAY + dt.timedelta(milliseconds=m)) for k, m in rows], "node string, ts timestamp")


def streamed(spark, parts, path, build):
    """The results of a stream that meets each part in a micro-batch of its own."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        query = build(spark.readStream.schema(part.schema).parquet(f"{path}/in")).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(180)  # restarted from its checkpoint for every part
        assert query.exception() is None
    return spark.read.parquet(f"{path}/out")


def test_batches_flush_as_a_stream(spark, tmp_path, rocks):
    rnd = random.Random(5)
    rows = sorted(((f"n{rnd.randint(0, 3)}", rnd.randint(0, 4000)) for _ in range(120)), key=lambda r: r[1]) + [("n0", 4200), ("n0", 4400)]
    parts = [signals(spark, rows[a:b]) for a, b in ((0, 50), (50, 51), (51, 122))]
    end = signals(spark, [("end", 99_000)])  # moves the watermark on
    got = {(r["node"], r["opened"], r["n"]) for r in streamed(spark, [*parts, end, signals(spark, [("end", 99_500)])], tmp_path, lambda s: timers.flushed(s, "node")).collect() if r["node"] != "end"}
    assert got == {(r["node"], r["opened"], r["n"]) for r in E.micro_batches(signals(spark, rows), "node").collect()}
    assert sum(n for *_, n in got) == len(rows)


def test_refreshes_by_hand():
    machine = timers.Refreshes("node", "30 seconds", "2 seconds")
    s, out, state = 1_000_000, [], machine.start
    for t in (0, 1 * s, 2 * s, 29 * s, 100 * s):
        made, state, due = machine.step(("k",), state, [t], t)
        out += [(int(m[1].value // 10**9), m[2]) for m in made]
    # the second signal is swallowed; the tick at 30 waits for the refresh at 31; the next are at 60 and 90
    assert out == [(2, "signal"), (4, "signal"), (31, "signal"), (31, "tick"), (60, "tick"), (90, "tick"), (102, "signal")] and due == 120 * s


def test_refreshes_stream_equals_batch(spark, tmp_path, rocks):
    rnd = random.Random(6)
    rows = sorted(((f"n{rnd.randint(0, 2)}", rnd.randint(0, 200_000)) for _ in range(60)), key=lambda r: r[1])
    parts = [signals(spark, rows[:20]), signals(spark, rows[20:]), signals(spark, [("end", 210_000)]), signals(spark, [("end", 210_001)])]
    last = {k: max(m for n, m in rows if n == k) for k, _ in rows}
    until = lambda r: r["node"] != "end" and (r["cause"] == "signal" or (r["refreshed"] - DAY).total_seconds() * 1000 <= last[r["node"]])
    got = sorted((r["node"], r["refreshed"], r["cause"]) for r in streamed(spark, parts, tmp_path, lambda s: timers.refreshes(s, "node")).collect() if until(r))
    want = sorted((r["node"], r["refreshed"], r["cause"]) for r in timers.refreshes(signals(spark, rows), "node").collect() if until(r))
    assert got == want and len(want) > 40
    assert timers.refreshes(signals(spark, []), "node").count() == 0


def test_letters_are_handled_once(spark, tmp_path):
    dead, seen = f"{tmp_path}/dead", []
    for n in range(4):
        E.bury(spark.range(3 * n, 3 * n + 3), n, dead)
    E.bury(spark.range(3, 6), 1, dead)  # the same batch again

    def handle(letters, number):
        if number == 2 and len(seen) < 7:
            seen.append("failed")
            raise RuntimeError
        seen.extend(sorted(r["id"] for r in letters.collect()))

    assert E.retry(spark, dead, handle) == 2 and seen == [*range(6), "failed"]
    assert E.retry(spark, dead, handle) == 2 and seen == [*range(6), "failed", *range(6, 12)]
    assert E.retry(spark, dead, handle) == 0 and len(seen) == 13
    assert sorted(r["batch"] for r in E.acknowledged(spark, dead).collect()) == [0, 1, 2, 3]


def sampled(spark, rows):
    return spark.createDataFrame([(k, None if t is None else DAY + dt.timedelta(seconds=t), v) for k, t, v in rows], "s string, ts timestamp, value double")


def test_increase_of_counters(spark):
    rows = [("up", t, 100.0 + t) for t in range(0, 300, 15)]  # every 15 s, 1 a second
    rows += [("reset", 10, 50.0), ("reset", 100, 60.0), ("reset", 190, 5.0), ("reset", 280, 15.0)]
    rows += [("one", 30, 7.0), ("flat", 0, 3.0), ("flat", 290, 3.0), ("zero", 150, 0.0), ("zero", 160, 10.0), ("up", None, 1.0), ("up", 15, None), ("up", 0, 100.0)]
    plain = {r["s"]: r["value"] for r in metrics.counter_increase(sampled(spark, rows), ["s"], extrapolate=False).collect()}
    assert plain == {"up": 285.0, "reset": 25.0, "one": None, "flat": 0.0, "zero": 10.0}
    whole = {r["s"]: r["value"] for r in metrics.counter_increase(sampled(spark, rows), ["s"]).collect()}
    assert whole["up"] == 300.0 and whole["flat"] == 0.0 and whole["one"] is None
    assert whole["reset"] == round(25 * (270 + 10 + 20) / 270, 6)
    assert whole["zero"] == 15.0  # no lead from 0; behind, half a distance
    rates = {r["s"]: r["value"] for r in metrics.counter_rate(sampled(spark, rows), ["s"]).collect()}
    assert rates["up"] == 1.0


def test_quantile_of_rates(spark):
    rows = [(le, t, float(v * t)) for le, v in ((10.0, 1), (20.0, 3), (40.0, 4), (None, 4)) for t in (0, 100, 200, 299)]
    df = spark.createDataFrame([("h", le, DAY + dt.timedelta(seconds=t), v) for le, t, v in rows], "s string, le double, ts timestamp, value double")
    at = lambda q: metrics.histogram_quantile(df, ["s"], q).first()["value"]
    assert at(0.5) == 15.0 and at(0.25) == 10.0 and at(0.875) == 30.0 and at(1.0) == 40.0
    still = df.withColumn("value", F.lit(5.0))
    assert metrics.histogram_quantile(still, ["s"], 0.5).first()["value"] is None


# --- the table that changes in place

POINT = "namespace string, path string, chunk long, text string"


def held(spark, root, schema):
    return sorted(map(tuple, point_table.read(spark, root, schema).collect()))


def test_changes_touch_their_buckets_only(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/points"
    rows = [(ns, f"f{i}", c, f"text {i} {c}") for ns in "ab" for i in range(200) for c in range(2)]
    points = spark.createDataFrame(rows, POINT)
    point_table.create(points, root, 16)
    before = {p: p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}
    new = spark.createDataFrame([("a", "f3", 0, "new 3"), ("a", "f900", 0, "f900 is new")], POINT)
    gone = spark.createDataFrame([("b", "f7"), ("a", "f3"), ("b", "f12345")], "namespace string, path string")
    point_table.change(spark, root, new, gone, 16)
    want = sorted([r for r in rows if r[:2] not in (("a", "f3"), ("b", "f7"))] + [("a", "f3", 0, "new 3"), ("a", "f900", 0, "f900 is new")])
    assert held(spark, root, points.schema) == want
    after = {p: p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}
    touched = {tuple(r) for r in new.select("namespace", "path").union(gone).select("namespace", point_table.bucket_of(F.col("path"), 16)).distinct().collect()}
    stays = {p: t for p, t in before.items() if not any(f"namespace={n}/bucket={b}/" in str(p) for n, b in touched)}
    assert stays and stays.items() <= after.items()
    # the same again changes nothing, and a change that fails before its overwrite leaves everything
    point_table.change(spark, root, new, gone, 16)
    assert held(spark, root, points.schema) == want
    files = sorted(Path(root).rglob("*.parquet"))
    monkeypatch.setattr(point_table, "_write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        point_table.change(spark, root, new.withColumn("text", F.lit("other")), None, 16)
    assert held(spark, root, points.schema) == want and sorted(Path(root).rglob("*.parquet")) == files


def test_a_bucket_may_become_empty_and_fill_again(spark, tmp_path):
    root, points = f"{tmp_path}/points", spark.createDataFrame([("n", f"f{i}", 0, "t") for i in range(20)], POINT)
    point_table.create(points, root, 4)
    point_table.change(spark, root, points.limit(0), points.select("namespace", "path"), 4)
    assert held(spark, root, points.schema) == []
    point_table.change(spark, root, points.where("path = 'f1'"), None, 4)
    assert held(spark, root, points.schema) == [("n", "f1", 0, "t")]
    point_table.change(spark, root, spark.createDataFrame([("other", "f1", 0, "t")], POINT), None, 4)  # a namespace of its own
    assert len(held(spark, root, points.schema)) == 2


def test_a_change_reads_the_touched_buckets(spark, tmp_path):
    root, points = f"{tmp_path}/points", spark.createDataFrame([("n", f"f{i}", 0, "t") for i in range(64)], POINT)
    point_table.create(points, root, 64)
    read = point_table.touched_rows(spark, root, points.schema, spark.createDataFrame([("n", 5)], "namespace string, bucket int"))
    plan = read._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = next(line for line in plan.splitlines() if line.startswith("PartitionFilters"))
    assert "bucket" in filters and "namespace" in filters
    assert {r["bucket"] for r in read.collect()} <= {5}
