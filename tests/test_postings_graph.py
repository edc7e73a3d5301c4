"""The full-text index against a scan of all points, and walks and requests that stay in their namespace."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from silvergrain.engine import Engine
from silvergrain.functions import text as T
from silvergrain.operators import graph, index, postings
from silvergrain.operators import search as S

POINT = "namespace string, path string, chunk long, text string"


def made(spark, rows):
    return spark.createDataFrame(rows, POINT).withColumn("tokens", T.match_tokens(F.col("text")))


def random_rows(n, seed):
    rnd = random.Random(seed)
    words = ["the", "of", "Été", "x1", "rare", "日本", "and", *(f"w{i}" for i in range(40))]
    return [(rnd.choice("ab"), f"f{rnd.randint(0, n // 3)}", i, " ".join(rnd.choice(words[: rnd.choice([4, 8, 47])]) for _ in range(rnd.randint(0, 8)))) for i in range(n)]


QUERIES = ["the of", "rare, ÉTÉ", "x1", "w3 w4", "nowhere", "the nowhere", "日本 the and", "", "!?", "the the"]


@pytest.mark.parametrize("slice_of", [4096, 16])
def test_matches_equal_a_scan_over_batches(spark, tmp_path, monkeypatch, slice_of):
    monkeypatch.setattr(postings, "SLICE", slice_of)
    root, live = f"{tmp_path}/index", {}
    batches = [(random_rows(300, 1), []), (random_rows(60, 2), [("a", "f1"), ("b", "f2"), ("b", "f9999")]), ([], [("a", "f3")])]
    for k, (rows, gone) in enumerate(batches):
        files = {(r[0], r[1]) for r in rows}
        gone = [g for g in gone if g not in files]
        postings.add(made(spark, rows), root, k, gone=spark.createDataFrame(gone, "namespace string, path string"))
        live = {f: own for f, own in live.items() if f not in files and f not in gone}
        for r in rows:
            live.setdefault((r[0], r[1]), []).append(r)
        if k == 1:  # a batch that runs again
            postings.add(made(spark, rows), root, k, gone=spark.createDataFrame(gone, "namespace string, path string"))
        now = made(spark, [r for own in live.values() for r in own]).cache()
        for q in QUERIES:
            for ns in (None, "a"):
                want = sorted(tuple(r) for r in S.text_search(now, q, ns).select(*S.KEY).collect()) if S.query_tokens(q) else []
                assert sorted(tuple(r) for r in postings.matches(spark, root, q, ns).collect()) == want, (k, q, ns)
    want = [tuple(r) for r in S.keyword_search(now, "the of", 7).collect()]
    assert [tuple(r) for r in postings.keyword_search(spark, root, "the of", 7).collect()] == want


def test_only_the_buckets_of_a_query_are_read(spark, tmp_path):
    root = f"{tmp_path}/index"
    postings.add(made(spark, random_rows(400, 3)), root, 0)
    before = {p: p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}
    read = postings._blocks_of(spark, root, ["the", "rare"]).inputFiles()
    assert 1 <= len({f.split("bucket=")[1].split("/")[0] for f in read}) <= 2 and len(read) < len(before) / 4
    plan = postings.matches(spark, root, "the rare")._jdf.queryExecution().executedPlan().toString()
    assert "In(token, [rare,the])" in plan or "In(token, [the,rare])" in plan
    postings.add(made(spark, random_rows(50, 4)), root, 1)
    after = {p: p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}
    assert before.items() <= after.items()  # blocks are added, none is written anew


def test_a_block_holds_a_slice_of_a_token_that_all_have(spark, monkeypatch):
    rows = [("n", f"p{i}", 0, "common") for i in range(2000)]
    found = postings.blocks(made(spark, rows), 20).collect()
    assert len(found) == 20 and sum(r["n"] for r in found) == 2000 and max(r["n"] for r in found) < 200


def test_walks_stay_in_their_namespace(spark):
    links = spark.createDataFrame([("x", "a", "b"), ("y", "b", "c"), ("x", "b", "d"), ("x", "d", "a"), ("y", "a", "z")], "namespace string, src string, dst string")
    start = spark.createDataFrame([("x", "a"), ("y", "a")], "namespace string, path string")
    found = {(r["namespace"], r["source"], r["path"], r["depth"]) for r in graph.neighbours(links, start, 3).collect()}
    assert found == {("x", "a", "b", 1), ("x", "a", "d", 2), ("y", "a", "z", 1)}
    everywhere = {(r["path"], r["depth"]) for r in graph.neighbours(links, start.select("path"), 3).collect()}
    assert everywhere == {("b", 1), ("z", 1), ("c", 2), ("d", 2)}
    nodes, edges = graph.nodes_and_edges(links, start, 1)
    assert sorted(map(tuple, edges.collect())) == [("x", "a", "b"), ("y", "a", "z")] and nodes.count() == 4


def test_engine_keeps_to_what_may_be_read(spark):
    texts = spark.createDataFrame([("x", "a.md", "apples are red, see [b](b.md)"), ("x", "b.md", "pears are green and fine"), ("y", "a.md", "apples of y, see [c](c.md)"), ("y", "c.md", "a secret of namespace y")], "namespace string, path string, text string")
    engine = Engine(spark, index.points(texts, index.hash_embedder()).cache())
    near = lambda **o: sorted((r["namespace"], r["path"]) for r in engine.neighbours("a.md", **o).collect())
    assert near() == [("x", "b.md"), ("y", "c.md")] and near(allowed=["x"]) == [("x", "b.md")] and near(namespace="y", allowed=["*"]) == [("y", "c.md")] and near(allowed=[]) == []
    assert {r["namespace"] for r in engine.search_graph("apples", allowed=["x"]).collect()} == {"x"}
    assert engine.file("c.md", allowed=["x"]).count() == 0 and engine.file("c.md").count() == 1
    assert engine.file_relations("a.md", allowed=["y"]).first()["value"] == "c.md"
    for ask in (engine.neighbours, engine.file, engine.file_relations):
        with pytest.raises(PermissionError):
            ask("a.md", namespace="y", allowed=["x"])


def test_stored_edges_are_those_of_the_points(spark, tmp_path):
    links = spark.createDataFrame([("x", "a", "b"), ("x", "a", "b"), ("y", "b", "c")], "namespace string, src string, dst string")
    graph.write_edges(links, f"{tmp_path}/edges")
    assert sorted((r["namespace"], r["src"], r["dst"]) for r in spark.read.parquet(f"{tmp_path}/edges").collect()) == [("x", "a", "b"), ("y", "b", "c")]
