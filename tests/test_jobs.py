"""The jobs over growing input, run again, broken off and from the command line."""

from __future__ import annotations

import datetime as dt
import json
import logging
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import common, index_documents, usage_report
from silvergrain.operators import postings

ROOT = Path(__file__).resolve().parents[1]
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def add(spark, folder, rows):
    spark.createDataFrame(rows, DOC).coalesce(1).write.mode("append").parquet(folder)


def doc(i, text, lang="en"):
    return (i, text, lang, "src", 0)


def held(spark, out):
    return {(r["namespace"], r["path"], r["chunk"]): r["text"] for r in index_documents.current(spark, out).collect()}


def found(spark, out, words):
    return sorted(tuple(r)[1:] for r in postings.matches(spark, f"{out}/index", words).collect())


def files_below(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_index_takes_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    docs, out, mark = (f"{tmp_path}/{n}" for n in ("docs", "out", "mark"))
    long = " ".join(f"w{i}" for i in range(1200))
    add(spark, docs, [doc(1, "the first words of one"), doc(2, "the second text, here"), doc(3, long, "de"), doc(4, None), doc(5, "short"), doc(6, "of no language at all", None)])
    assert index_documents.run(spark, docs, out, mark) == 1
    first = held(spark, out)
    assert {k[:2] for k in first} == {("en", "src/1.md"), ("en", "src/2.md"), ("de", "src/3.md"), ("default", "src/6.md")}
    assert [k[2] for k in sorted(first) if k[0] == "de"] == [0, 1, 2]
    assert found(spark, out, "the words") == [("src/1.md", 0)] and found(spark, out, "W1100") == [("src/3.md", 2)]
    before = files_below(out)
    assert index_documents.run(spark, docs, out, mark) == 0  # nothing new, nothing written
    assert files_below(out) == before and held(spark, out) == first
    # a changed text, one taken out, a new one; old partitions stay as they are
    add(spark, docs, [doc(1, "other content of one"), doc(2, None), doc(7, "the seventh words")])
    assert index_documents.run(spark, docs, out, mark) == 1
    assert {k: v for k, v in files_below(out).items() if k in before} == before
    second = held(spark, out)
    assert second[("en", "src/1.md", 0)] == "other content of one" and ("en", "src/2.md", 0) not in second and ("en", "src/7.md", 0) in second
    assert found(spark, out, "the words") == [("src/7.md", 0)] and found(spark, out, "second") == [] and found(spark, out, "") == []
    assert "read 6 documents" in caplog.text and "read 3 documents" in caplog.text
    # all at once gives the same
    index_documents.run(spark, docs, f"{out}-again", f"{mark}-again", files_per_batch=1)
    assert held(spark, f"{out}-again") == second


def test_a_batch_that_broke_off_is_repeated(spark, tmp_path, monkeypatch):
    docs, out, mark = (f"{tmp_path}/{n}" for n in ("docs", "out", "mark"))
    add(spark, docs, [doc(i, f"text number {i} of many") for i in range(30)])
    put = postings.add
    monkeypatch.setattr(postings, "add", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(Exception, match="lost"):
        index_documents.run(spark, docs, out, mark)
    monkeypatch.setattr(postings, "add", put)
    assert index_documents.run(spark, docs, out, mark) == 1
    assert len(held(spark, out)) == 30 and index_documents.CHUNK
    assert spark.read.parquet(f"{out}/chunks").count() == 30  # nothing twice


def test_chunks_get_vectors_from_a_model_that_is_named(spark, tmp_path):
    docs, out, mark = (f"{tmp_path}/{n}" for n in ("docs", "out", "mark"))
    add(spark, docs, [doc(1, "the words of one text"), doc(2, "and of another one")])
    index_documents.run(spark, docs, out, mark, embedder="silvergrain.operators.index:hash_embedder")
    from silvergrain.operators import index

    want = index.hash_embedder()(["the words of one text"])[0]
    found = {r["path"]: list(r["vector"]) for r in index_documents.current(spark, out).collect()}
    assert len(found) == 2 and found["src/1.md"] == pytest.approx(want)
    with pytest.raises(ModuleNotFoundError):
        index_documents.run(spark, docs, out, mark, embedder="nowhere.at_all:x")


def event(minute, kind, value, day=1):
    return (dt.datetime(2024, 1, day) + dt.timedelta(minutes=minute), kind, value)


EVENT = "ts timestamp, event_type string, value double"


def test_report_by_hand_and_by_days(spark, tmp_path):
    rows = [event(60 * h + m, "view", float(v)) for h in range(3) for m, v in ((1, 80), (2, 90), (3, 10))]
    rows += [event(5, "click", None), event(6, "click", 1.234), (None, "view", 1.0)] + [event(10, "view", 100.0, 2), event(70, "view", 100.0, 2)]
    spark.createDataFrame(rows, EVENT).write.parquet(f"{tmp_path}/events")
    usage_report.run(spark, f"{tmp_path}/events", f"{tmp_path}/out")
    got = {(str(r["window_start"])[:16], r["event_type"], r["metric"]): r["value"] for r in usage_report.read(spark, f"{tmp_path}/out").collect()}
    assert got["2024-01-01 00:00", "view", "n"] == 3.0 and got["2024-01-01 00:00", "view", "p50"] == 80.01 and got["2024-01-01 00:00", "view", "p99"] == 90.01
    assert got["2024-01-01 00:00", "click", "n"] == 2.0 and got["2024-01-01 00:00", "click", "mean"] == 1.234 and got["2024-01-01 00:00", "click", "p50"] == 1.24
    assert [k[0] for k in sorted(got) if k[2] == "alert:slow"] == ["2024-01-01 02:00"] and got["2024-01-01 02:00", "view", "alert:slow"] == 90.01
    # one day anew changes nothing, and touches no other day
    before = files_below(f"{tmp_path}/out")
    usage_report.run(spark, f"{tmp_path}/events", f"{tmp_path}/out", from_day="2024-01-02", to_day="2024-01-02")
    again = {(str(r["window_start"])[:16], r["event_type"], r["metric"]): r["value"] for r in usage_report.read(spark, f"{tmp_path}/out").collect()}
    after = files_below(f"{tmp_path}/out")
    assert again == got and {p for p in before if "day=2024-01-01" in p} == {p for p in after if "day=2024-01-01" in p}
    # later events of the second day come in
    spark.createDataFrame([event(130, "view", 5.0, 2)], EVENT).write.mode("append").parquet(f"{tmp_path}/events")
    usage_report.run(spark, f"{tmp_path}/events", f"{tmp_path}/out", from_day="2024-01-02")
    assert usage_report.read(spark, f"{tmp_path}/out").where("metric = 'n' AND day = '2024-01-02'").count() == 3


def test_report_of_days_equals_that_of_all(spark, tmp_path, sf_dir):
    """Alerts that began the day before are found though only one day is reported."""
    rules = [{"name": "any", "quantile": "p50", "above": 1.0, "windows": 4}, {"name": "low", "quantile": "n", "above": 1.5, "windows": 2}]
    events = f"{sf_dir}/events.parquet"
    usage_report.run(spark, events, f"{tmp_path}/all", rules=rules, window_minutes=360)
    usage_report.run(spark, events, f"{tmp_path}/some", rules=rules, window_minutes=360, from_day="2024-01-10", to_day="2024-01-12")
    at = lambda p: sorted(map(str, usage_report.read(spark, p).where("day BETWEEN '2024-01-10' AND '2024-01-12'").collect()))
    assert at(f"{tmp_path}/all") == at(f"{tmp_path}/some")
    assert usage_report.read(spark, f"{tmp_path}/some").agg(F.countDistinct("day")).first()[0] == 3


def test_report_of_nothing(spark, tmp_path):
    spark.createDataFrame([], EVENT).write.parquet(f"{tmp_path}/events")
    usage_report.run(spark, f"{tmp_path}/events", f"{tmp_path}/out", rules=[])
    assert usage_report.read(spark, f"{tmp_path}/out").count() == 0


def test_settings(spark, tmp_path):
    for job in (index_documents, usage_report):
        assert common.settings(spark, str(ROOT / "jobs" / f"{job.log.name}.json"), job.SETTINGS) == job.SETTINGS
    (tmp_path / "c.json").write_text(json.dumps({"nope": 1}))
    with pytest.raises(ValueError, match="nope"):
        common.settings(spark, str(tmp_path / "c.json"), usage_report.SETTINGS)


def test_command_line(spark, tmp_path):
    add(spark, f"{tmp_path}/docs", [doc(1, "some words in a text")])
    args = [f"--{n}={tmp_path}/{n}" for n in ("output", "checkpoint")]
    done = subprocess.run([sys.executable, ROOT / "jobs/index_documents.py", f"--documents={tmp_path}/docs", *args, f"--config={ROOT}/jobs/index_documents.json"], capture_output=True, text=True, timeout=300, env=os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"}, cwd=tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 1 documents" in done.stderr
    assert list(held(spark, f"{tmp_path}/output").values()) == ["some words in a text"]
