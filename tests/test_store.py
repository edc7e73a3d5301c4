"""A store through rounds of changes: points, text match and counts stay in step, and the engine over it answers as one over the points."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from silvergrain.engine import Engine
from silvergrain.operators import index, point_table, postings
from silvergrain.operators import search as S
from silvergrain.operators.store import Store

EMBED = index.hash_embedder()


def texts(spark, rows):
    return spark.createDataFrame(rows, "namespace string, path string, text string")


def check(spark, store, want):
    """want: texts by (namespace, path) as they should be held."""
    fresh = index.points(texts(spark, [(*k, t) for k, t in want.items()]), EMBED)
    keys = lambda df: sorted(map(tuple, df.select("namespace", "path", "chunk", "text", "point_id").collect()))
    assert keys(store.points()) == keys(fresh)
    for words in ("apples", "the red", "green pears", "nothing"):
        assert sorted(map(tuple, postings.matches(spark, f"{store.root}/text", words).collect())) == sorted(map(tuple, S.text_search(fresh, words).select(*S.KEY).collect())), words
    counts = {r["namespace"]: r["n"] for r in store.counts().collect() if r["n"]}
    assert counts == {r["namespace"]: r["n"] for r in fresh.groupBy("namespace").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_rounds_of_changes(spark, tmp_path, monkeypatch):
    store = Store(spark, f"{tmp_path}/store", 4)
    long = " ".join(f"w{i}" for i in range(1100))
    want = {("x", "a"): "the red apples of a", ("x", "b"): "green pears and the rest", ("y", "a"): "apples of another", ("y", "long"): long}
    store.change(0, index.points(texts(spark, [(*k, t) for k, t in want.items()]), EMBED))
    check(spark, store, want)
    new = {("x", "a"): "no fruit at all here", ("x", "c"): "the red one is new"}
    gone = spark.createDataFrame([("y", "long"), ("y", "nowhere")], "namespace string, path string")
    want = {k: t for k, t in (want | new).items() if k != ("y", "long")}
    change = lambda: store.change(1, index.points(texts(spark, [(*k, t) for k, t in new.items()]), EMBED), gone)
    # it breaks off after the index was written, and is repeated
    whole = point_table.change
    monkeypatch.setattr(point_table, "change", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        change()
    monkeypatch.setattr(point_table, "change", whole)
    change()
    check(spark, store, want)
    change()  # and once more
    check(spark, store, want)
    # a file whose new text has no point
    store.change(2, index.points(texts(spark, [("x", "b", "tiny")]), EMBED), files=texts(spark, [("x", "b", "tiny")]))
    check(spark, store, {k: t for k, t in want.items() if k != ("x", "b")})


def test_engine_over_a_store(spark, tmp_path):
    engine = Engine.over_store(Store(spark, f"{tmp_path}/store", 4))
    held = {"a.md": "apples are red and round", "b.md": "pears are green, see [a](a.md)"}
    listing = lambda files: spark.createDataFrame([(p, len(t), 1, None, None) for p, t in files.items()], "path string, size long, mtime long, partial_hash string, full_hash string")
    read = lambda changed: changed.join(texts(spark, [("n", p, t) for p, t in held.items()]), "path")
    empty = listing({}).withColumn("last_seen", F.lit(0))
    assert engine.refresh(listing(held), empty, read, number=0).count() == 2
    plain = Engine(spark, index.points(texts(spark, [("n", p, t) for p, t in held.items()]), EMBED))
    for mode in ("keyword", "hybrid", "semantic"):
        same = lambda e: [(r["path"], round(r["score"], 9)) for r in e.search("are green", "n", mode, 5).collect()]
        assert same(engine) == same(plain)
    before = listing(held).withColumn("last_seen", F.lit(0))
    del held["a.md"]
    held["c.md"] = "cherries are red as well"
    actions = {r["path"]: r["action"] for r in engine.refresh(listing(held), before, read, number=1).collect()}
    assert actions == {"a.md": "DELETE", "b.md": "TOUCH", "c.md": "INDEX"}
    assert [r["path"] for r in engine.search("are red", "n", "keyword").collect()] == ["c.md"] and engine.points.count() == 2
    with pytest.raises(ValueError, match="number"):
        engine.refresh(listing(held), before, read)
