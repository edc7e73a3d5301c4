"""Faults found in the third round: each test failed before."""

from __future__ import annotations

import os

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from silvergrain.operators import governance, index, postings, sketches
from silvergrain.plans import catalog
from silvergrain.sources import files


def tables(sf_dir, root, **changed):
    """A folder of tables: those of sf_dir, but for the changed ones (DataFrames)."""
    root.mkdir()
    for f in os.listdir(sf_dir):
        if f.split(".")[0] not in changed:
            (root / f).symlink_to(f"{sf_dir}/{f}")
    for name, df in changed.items():
        df.coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def differences(spark, name, root):
    """Rows that the query has and its SQL has not, and the other way round."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(root):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{root}/{f}{'/*.parquet' if os.path.isdir(f'{root}/{f}') else ''}'")
    found = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    theirs, ours = found.fetchall(), [tuple(r) for r in catalog.queries()[name](spark, root).select(*columns).collect()]
    left = list(theirs)
    more = [r for r in ours if r not in left or left.remove(r)]
    return more, left


# F1


def test_answers_are_those_of_their_own_turn(spark, sf_dir, tmp_path):
    said = "conv_id bigint, turn bigint, role string, text string"
    rows = [(3, 0, "user", "same question"), (7, 0, "user", "same question"), (15, 2, "user", "Same question "), (27, 6, "user", "same question"), (3, 6, "user", "same question"), (3, 2, "user", None), (None, 2, "user", "x"), (39, 0, "user", "same question"), (39, 0, "user", "SAME question"), (39, 0, "user", "SAME question")]
    root = tables(sf_dir, tmp_path / "t", conversations=spark.createDataFrame(rows, said))
    assert differences(spark, "answer_cache", root) == ([], [])


def test_a_request_stays_one_row_where_the_cache_has_several_answers(spark):
    requests = spark.createDataFrame([(1, "n", "m", "q"), (2, "n", "m", " Q ")], "request_id int, namespace string, model string, query string")
    none = spark.createDataFrame([], "namespace string, generation long")
    key = governance.cached_answers(requests, spark.createDataFrame([], "cache_key string, answer string, expires_at int"), none, F.lit(10)).first()["cache_key"]
    cache = spark.createDataFrame([(key, "old", 12), (key, "new", 20), (key, "gone", 5)], "cache_key string, answer string, expires_at int")
    assert sorted((r["request_id"], r["answer"]) for r in governance.cached_answers(requests, cache, none, F.lit(10)).collect()) == [(1, "new"), (2, "new")]


# F2


def test_counts_beyond_a_full_sketch_are_exact(spark, sf_dir, tmp_path):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") < 28_000, "en").when(F.col("id") < 29_900, "de").alias("lang"), F.lit("web").alias("source"), F.lit(1).alias("n_chars"))
    assert differences(spark, "sketched_counts", tables(sf_dir, tmp_path / "t", documents=rows)) == ([], [])


def test_exact_counts_follow_changes(spark, tmp_path):
    root = f"{tmp_path}/s"
    point = lambda lo, hi, ns="a": spark.range(lo, hi).select(F.lit(ns).alias("namespace"), F.col("id").cast("string").alias("point_id"))
    at = lambda where=root: {r["namespace"]: r["n"] for r in sketches.exact_counts(spark, where).collect()}
    sketches.note(point(0, 20_000).union(point(0, 10, "b")), None, root, 0)
    for _ in range(2):
        sketches.note(point(20_000, 20_500), point(0, 19_990), root, 1)
    sketches.note(point(20_000, 20_500), None, root, 1)  # again, when nothing is left to take away
    assert at() == {"a": 510, "b": 10}  # few now, but the sketches were full
    sketches.note(point(0, 100), point(50, 200).union(point(0, 10, "b")), root, 2)  # what is in both was replaced
    assert at() == {"a": 610, "b": 0}
    sketches.compact(spark, root, f"{tmp_path}/one")
    sketches.note(point(0, 5000), point(20_000, 20_100), f"{tmp_path}/one", 3)
    assert at(f"{tmp_path}/one") == {"a": 5410, "b": 0}


# F3, F4


def test_postings_are_not_shuffled_one_by_one(spark, tmp_path):
    rows = [("n" if i % 3 else "m", f"p{i // 2}", i % 2, [f"w{i % k}" for k in range(1, 6)] if i % 10 else []) for i in range(200)]
    points = spark.createDataFrame(rows, "namespace string, path string, chunk long, tokens array<string>")
    plan = postings.blocks(points, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")  # points are dealt, then opened
    root = f"{tmp_path}/index"
    postings.add(points, root, 0)
    found = {(r["namespace"], r["path"], r["chunk"]): r["tokens"] for r in postings.posted(spark, root).collect()}
    assert found == {(n, p, c): sorted(set(t)) for n, p, c, t in rows if t}


# F5


def test_workers_open_batches_in_pieces():
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(64)], "content": [bytes([i]) * (1 << 20) for i in range(64)]})
    found = list(files.pieces(iter([batch, batch.slice(0, 0)])))
    assert max(sum(map(len, f["content"])) for f in found) <= files.PIECE and [p for f in found for p in f["path"]] == [str(i) for i in range(64)]
    assert all(len(f) == 1 for f in files.pieces(iter([pa.RecordBatch.from_pydict({"content": [b"x" * 2 * files.PIECE] * 2})])))


def test_archives_and_texts_pass_as_arrow(spark):
    rows = spark.createDataFrame([("a.txt", bytearray(b"plain"), None), ("b.zip", bytearray(b"no zip"), False), ("c.txt", None, True), ("d.gz", bytearray(b""), False)], "path string, content binary, truncated boolean")
    found = files.extract(files.expand_archives(rows), [("z", (".zip",), lambda p, d: ("z", [{"type": "x"}], {"k": 1}))])
    assert "MapInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["path"]: (r["text"], r["extractor"], r["relations"], r["metadata"], r["truncated"]) for r in found.collect()}
    assert got["a.txt"] == ("plain", "plain", "", {}, False) and got["b.zip"] == ("z", "z", '[{"type": "x"}]', {"k": "1"}, False) and got["c.txt"] == (None, None, "", {}, True)


# F6


def test_whole_texts_do_not_go_to_the_model_in_arrow_batches(spark):
    texts = spark.createDataFrame([("p", "One sentence here. Another sentence here. A third sentence. A fourth one is here.")], "path string, text string")
    found = index.semantic_chunks(texts, lambda t: [[1.0, 0.0]] * len(t))
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r["text"] for r in found.collect()] == [texts.first()["text"]]
