"""Operators on hand-made rows: ranks, chunks, delta decisions, graphs, access, evaluation, rules."""

from __future__ import annotations

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from silvergrain.functions import ids, relations as R, text as T, vectors as V
from silvergrain.operators import delta, evals, governance, graph, index, metrics, rag
from silvergrain.operators import search as S
from silvergrain.plans import catalog


def leg(spark, names, namespace="docs", chunk=0):
    return spark.createDataFrame([(namespace, n, chunk, i + 1) for i, n in enumerate(names)], "namespace string, path string, chunk long, rank int")


def scores(df):
    return {(r["namespace"], r["path"]): r["score"] for r in df.collect()}


def test_fuse_adds_ranks(spark):
    found = scores(S.fuse([(leg(spark, ["shared", "v"]), 1.0), (leg(spark, ["shared", "t"]), 1.0)], 10))
    assert found[("docs", "shared")] == pytest.approx(2 / 61)
    assert found[("docs", "v")] == found[("docs", "t")] == pytest.approx(1 / 62)


def test_fuse_keeps_namespaces_apart(spark):
    both = leg(spark, ["shared", "x"], "a").unionByName(leg(spark, ["shared"], "b"))
    assert len(scores(S.fuse([(both, 1.0)], 10))) == 3


@pytest.mark.parametrize(("k", "gap"), [(1, 1 / 2 - 1 / 3), (60, 1 / 61 - 1 / 62)])
def test_fuse_constant(spark, k, gap):
    found = sorted(scores(S.fuse([(leg(spark, ["a", "b"]), 1.0)], 10, k)).values())
    assert found[1] - found[0] == pytest.approx(gap)


def test_fuse_without_weight_empty_and_limit(spark):
    assert set(scores(S.fuse([(leg(spark, ["a"]), 1.0), (leg(spark, ["b"]), 0.0)], 10))) == {("docs", "a")}
    assert not scores(S.fuse([(leg(spark, ["a"]).limit(0), 1.0)], 10))
    assert not scores(S.fuse([(leg(spark, ["a"]), 0.0)], 10))
    assert len(scores(S.fuse([(leg(spark, ["a", "b", "c"]), 1.0)], 2))) == 2


def test_unique_row_survives_a_flood(spark):
    found = scores(S.fuse([(leg(spark, [f"v{i}" for i in range(15)]), 1.0), (leg(spark, ["only"]), 1.0)], 10))
    assert len(found) == 10 and ("docs", "only") in found


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("n", "size", "overlap", "count"), [(100, 30, 5, 4), (600, 512, 50, 2), (50, 10, 9, 41), (0, 10, 1, 0), (10, 10, 1, 1), (30, 10, 1, 4)])
def test_chunks(spark, n, size, overlap, count):
    words = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), i.cast("string"))) if n else F.array().cast("array<string>")
    made = one(spark, T.smart_chunk(words, size, overlap))
    assert len(made) == count == one(spark, T.chunk_count(F.lit(n), size, overlap))
    if made:
        assert made[0].split()[0] == "w1" and made[-1].split()[-1] == f"w{n}"
        assert all(len(c.split()) <= size for c in made)


def test_chunk_params():
    assert T.chunk_params() == (512, 50)
    assert T.chunk_params(10, 0) == (10, 1)
    assert T.chunk_params(100, 200) == (100, 10)


def test_sentences(spark):
    assert one(spark, T.sentences(F.lit("First sentence. Second sentence? Third one! And a fourth. x"))) == ["First sentence.", "Second sentence?", "Third one!", "And a fourth."]


@pytest.mark.parametrize("flags", [dict(whisper=False, vision=False, frames=False, ocr=False), dict(whisper=True, vision=False, frames=False, ocr=True)])
def test_skipped(flags):
    skipped = T.skipped_extensions(**flags)
    assert ".dng" in skipped
    assert (".jpg" in skipped) != flags["ocr"]
    assert (".mp4" in skipped) == (".mp3" in skipped) != flags["whisper"]


@pytest.mark.parametrize(("path", "out"), [("/a/#recycle/x.md", True), ("/a/file.tmp", True), ("/a/important.go", False), ("/a/normal.txt", False)])
def test_excluded(spark, path, out):
    assert one(spark, T.excluded(F.lit(path), ["#recycle", "*.tmp"])) is out


@pytest.mark.parametrize(("path", "clean"), [("test.txt", "test.txt"), ("dir/./a/../file.zip", "dir/file.zip"), ("../../etc/passwd", None), ("/abs", None), ("..", None), ("a..b/c", "a..b/c")])
def test_archive_path(path, clean):
    assert T.clean_archive_path(path) == clean


@pytest.mark.parametrize("name", ["src/a.md:0", "ünï/çøde:3", ""])
def test_uuid5(spark, name):
    assert one(spark, ids.uuid5(F.lit(name))) == str(uuid.uuid5(uuid.UUID(ids.POINT_SPACE), name))


def test_answer_key_normalises(spark):
    key = lambda ns, g, m, q: one(spark, ids.answer_key(F.lit(ns), F.lit(g), F.lit(m), F.lit(q)))
    base = key("n", 1, "m", "  Hello World  ")
    assert base == key("n", 1, "m", "hello world") and len(base) == 64
    assert len({base, key("o", 1, "m", "hello world"), key("n", 2, "m", "hello world"), key("n", 1, "x", "hello world")}) == 4


def test_cosine(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, V.cosine(arr(1.0, 0.0), arr(0.0, 1.0))) == 0
    assert one(spark, V.cosine(arr(1.0, 0.0), arr(2.0, 0.0))) == pytest.approx(1)
    assert one(spark, V.cosine(arr(0.0, 0.0), arr(1.0, 0.0))) == 0
    assert one(spark, V.cosine(arr(1.0), arr(1.0, 0.0))) == 0
    assert one(spark, V.is_zero(arr(0.0, 0.0))) and not one(spark, V.is_zero(arr(0.0, 1.0)))


@pytest.mark.parametrize(("text", "want"), [
    ('package x\nimport "fmt"\nimport (\n a "b/c"\n)\nfunc (s *T) Run() {}\nfunc hidden() {}\ntype Box struct {}', ["fmt", "b/c", "Run", "Box"]),
    ('import (\r\n\t"a"\r\n\t)\r\nfunc Run() {}', ["a", "Run"]),
    ('import ( // "no"\n"a"\nimport (\n"b"\n)\n)\ntype Box struct', ["a", "b", "Box"]),
    ('import (\n"a"\nfunc Run() {}', ["a"]),
    (")\nfunc Run(", ["Run"]),
    ("", []),
])
def test_go_relations(spark, text, want):
    found = one(spark, R.go_relations(F.lit(text)))
    assert [r["target"] or r["name"] for r in found] == want


def test_relations_round_trip(spark):
    text = F.lit("see [a](b.md) and [c](http://x)")
    json = one(spark, R.to_json(R.relations(F.lit("x.md"), text)))
    assert json == '[{"type":"links_to","target":"b.md"}]'
    assert one(spark, R.to_json(R.relations(F.lit("x.png"), text))) == ""


def chain(spark, pairs):
    return spark.createDataFrame([("n", a, b) for a, b in pairs], "namespace string, src string, dst string")


def reach(spark, pairs, depth, start="a"):
    return {r["path"] for r in graph.neighbours(chain(spark, pairs), spark.createDataFrame([(start,)], "path string"), depth).collect()}


def test_graph(spark):
    assert reach(spark, [("a", "b"), ("b", "c")], 2) == {"b", "c"}
    assert reach(spark, [("x", "y")], 2) == set()
    assert reach(spark, [("a", "b"), ("b", "a")], 1) == {"b"}
    assert reach(spark, [("a", "b"), ("b", "a")], 2) == {"b"}
    assert reach(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], 9) == {"b", "c", "d"}


def snapshot(spark, rows):
    return spark.createDataFrame(rows, "path string, size long, mtime long, partial_hash string, full_hash string")


@pytest.mark.parametrize(
    ("now", "then", "full", "action"),
    [
        (("p", 1, 1, "h", "f"), ("p", 1, 1, "h", "f"), False, "UNCHANGED"), (("p", 1, 1, "g", "g"), ("p", 1, 1, "h", "f"), False, "INDEX"), (("p", 1, 2, "h", "f"), ("p", 1, 1, "h", "f"), False, "UPDATE_META"),
        (("p", 1, 1, "h", "f"), ("p", 1, 1, None, None), False, "WARM"), (("p", 1, 2, None, None), ("p", 1, 1, "h", "f"), False, "INDEX"), (("p", 1, 1, None, None), ("p", 1, 1, "h", "f"), False, "TOUCH"),
        (("p", 1, 1, "h", "g"), ("p", 1, 1, "h", "f"), True, "INDEX"), (("p", 1, 1, "h", "f"), ("p", 1, 1, "h", "f"), True, "UNCHANGED"), (("p", 1, 1, "h", "f"), ("q", 1, 1, "h", "f"), False, "INDEX"),
    ],
)
def test_delta(spark, now, then, full, action):
    found = {r["path"]: r["action"] for r in delta.classify(snapshot(spark, [now]), snapshot(spark, [then]), full_hash=full).collect()}
    assert found["p"] == action
    assert found.get("q", "DELETE") == "DELETE"


def test_reindex_leaves_no_old_chunk(spark):
    old = spark.createDataFrame([("n", "p", i, "old") for i in range(3)] + [("n", "q", 0, "old")], "namespace string, path string, chunk long, text string")
    new = spark.createDataFrame([("n", "p", 0, "new")], old.schema)
    assert sorted((r["path"], r["text"]) for r in delta.reindex(old, new).collect()) == [("p", "new"), ("q", "old")]


def test_acl_and_resolution(spark):
    users = spark.createDataFrame([("u", ["hr", "eng"]), ("a", ["admins"]), ("n", ["none"])], "user string, groups array<string>")
    acl = spark.createDataFrame([("hr", ["hr-docs", "shared"]), ("eng", ["eng-docs", "shared"]), ("admins", ["*"])], "grp string, namespaces array<string>")
    found = {r["user"]: r["namespaces"] for r in governance.allowed_namespaces(users, acl).collect()}
    assert found == {"u": ["eng-docs", "hr-docs", "shared"], "a": ["*"], "n": []}
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, governance.resolve(F.lit("*"), arr("a", "b"), arr("x"))) == []
    assert one(spark, governance.resolve(F.lit("*"), arr("a", "b"), arr("x"), compat=True)) == [""]
    assert one(spark, governance.resolve(F.lit("a"), arr("a", "b"), arr("a"))) == ["a"]


@pytest.mark.parametrize(("r", "f", "want"), [(0.9, 0.9, "PASS"), (0.7, 0.7, "PASS"), (0.5, 0.5, "PARTIAL"), (0.4, 0.4, "PARTIAL"), (0.2, 0.2, "FAIL"), (0.0, 0.0, "FAIL")])
def test_verdict(spark, r, f, want):
    assert one(spark, evals.verdict(F.lit(r), F.lit(f))) == want


def test_truncate(spark):
    assert one(spark, T.truncate_bytes(F.lit("hello world"), 5)) == "hello..."
    assert one(spark, T.truncate_chars(F.lit("héllo"), 5)) == "héllo"


def test_byte_cuts_keep_code_points_whole(spark):
    """Every cut through code points of one to four bytes, against Python's own decoder."""
    texts = ["", "a", "é" * 6, "日本語です", "🙂👍🏽x", "aé日🙂" * 4, "ab�", "�" * 5, "  é  é"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for most in range(1, 14):
        want = [t.encode()[:most].decode(errors="ignore") for t in texts]
        found = rows.select("i", T.truncate_bytes(F.col("text"), most).alias("t"), T.excerpt(F.col("text"), 2, most).alias("e")).orderBy("i").collect()
        assert [r["t"] for r in found] == [w + "..." if len(t.encode()) > most else t for t, w in zip(texts, want)]
        assert [r["e"] for r in found] == ["" if len(t.encode()) < 2 else w.strip(" ") for t, w in zip(texts, want)]


@pytest.mark.parametrize(("name", "most"), [("excerpts", 4000), ("truncate_texts", 200)])
def test_whole_table_is_cut(spark, sf_dir, tmp_path, name, most):
    """All documents, with code points across the cut at each of their bytes, against brute force."""
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = [(10**6 + i, "a" * (most - i) + c * 300, "de", "s", 0) for i in range(5) for c in ("é", "日", "🙂")]
    more = [(10**6 + k, *r[1:]) for k, r in enumerate(more)]
    given.unionByName(spark.createDataFrame(more, given.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["digest"] for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    cut = lambda t: t.encode()[:most].decode(errors="ignore")
    want = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    assert any(len(t) < len(t.encode()) for i, t in want.items() if i < 10**6)
    if name == "excerpts":
        assert found == {i: "" if len(t.encode()) < 200 else md5(cut(t).strip(" ")) if cut(t).strip(" ") else "" for i, t in want.items()}
    else:
        assert found == {i: md5(cut(t) + "..." if len(t.encode()) > most else t) for i, t in want.items()}


def test_agentic_loop(spark):
    first = spark.createDataFrame([("1", 0.5, "a"), ("2", 0.4, "b")], "point_id string, score double, text string")
    more = spark.createDataFrame([("1", 0.9, "a"), ("3", 0.7, "c")], first.schema)
    asked = []
    search = lambda q: asked.append(q) or more
    ready = lambda q, rows: {"confidence": 1.0, "answer_ready": True}
    never = lambda q, rows: {"confidence": 0.1, "answer_ready": False, "follow_up_queries": ["x"]}
    rows, n = rag.agentic_search(spark, "q", first, search, ready)
    assert n == 1 and not asked and rows.count() == 2
    rows, n = rag.agentic_search(spark, "q", first, search, never, rounds=3)
    assert n == 3 and asked == ["x", "x"]
    assert {r["point_id"]: r["score"] for r in rows.collect()} == {"1": 0.9, "2": 0.4, "3": 0.7}

    def fails(q, rows):
        raise RuntimeError

    assert rag.agentic_search(spark, "q", first, search, fails)[0].count() == 2


def test_answer_falls_back(spark):
    rows = spark.createDataFrame([("n", "p.md", "text")], "namespace string, path string, text string")

    def fails(prompt):
        raise RuntimeError

    assert rag.answer("q", rows, fails) == "text\n\n[Source: n/p.md]"


def test_parse_json(spark):
    said = one(spark, rag.parse_json(F.lit('```json\n{"confidence": 0.5, "answer_ready": true}\n```'), rag.ASSESSMENT))
    assert said["confidence"] == 0.5 and said["answer_ready"]
    assert one(spark, rag.parse_json(F.lit("no json"), "confidence double"))["confidence"] is None


def test_semantic_groups(spark):
    rows = spark.createDataFrame([("d", i, [1.0, 0.0, 0.0] if i < 5 else [0.0, 1.0, 0.0]) for i in range(10)], "doc string, i int, v array<double>")
    found = index.semantic_groups(rows, ["doc"], "i", "v", 0.5).orderBy("i").collect()
    assert [r["grp"] for r in found] == [0] * 5 + [1] * 5


def test_points_and_engine(spark):
    from silvergrain.engine import Engine

    texts = spark.createDataFrame([("n", "a.md", "Apples are red. See [b](b.md) for pears."), ("n", "b.md", "Pears are green and sweet fruit."), ("m", "c.txt", "Cars have wheels and engines."), ("n", "d.txt", "tiny")], "namespace string, path string, text string")
    own = index.points(texts, index.hash_embedder()).cache()
    assert own.count() == 3
    engine = Engine(spark, own, model=lambda prompt: "said")
    assert engine.search("pears green", "n").first()["path"] == "b.md"
    assert {r["path"] for r in engine.search("wheels", "*", mode="keyword").collect()} == {"c.txt"}
    assert [r["path"] for r in engine.neighbours("a.md").collect()] == ["b.md"]
    assert engine.search_graph("apples red", "n").count() == 2
    assert engine.answer("pears", "n") == "said"
    with pytest.raises(PermissionError):
        engine.search("x", "m", allowed=["n"])


def test_lasting(spark):
    rows = spark.createDataFrame([(d, v) for d, v in [("2024-01-01", 5), ("2024-01-02", 5), ("2024-01-04", 5), ("2024-01-05", 5), ("2024-01-06", 5)]], "d string, value int").select(F.col("d").cast("timestamp").alias("window_start"), "value")
    found = metrics.lasting(rows, [], F.col("value") > 1, 3, 86400).collect()
    assert [str(r["window_start"].date()) for r in found] == ["2024-01-06"]


def test_rerank(spark):
    base = leg(spark, ["a", "b", "c"])
    given = spark.createDataFrame([("docs", "a", 0, 0.1), ("docs", "b", 0, 0.9)], "namespace string, path string, chunk long, rerank_score double")
    order = [r["path"] for r in S.rerank(base, given).orderBy("new_rank").collect()]
    assert order == ["b", "a", "c"]
    assert S.rerank(base, given, threshold=0.5).count() == 1
    assert S.rerank(base, given, threshold=0.95).count() == 3


def test_settings(monkeypatch):
    from silvergrain import config

    assert (config.weight("0.7"), config.weight("invalid"), config.weight(-1), config.rrf_k("30"), config.rrf_k(-5)) == (0.7, 1.0, 1.0, 30, 60)
    own = config.Settings(graph_depth=9, hops=0, confident=2.0, batch=1)
    assert (own.graph_depth, own.hops, own.confident, own.batch) == (3, 1, 1.0, 10)
    monkeypatch.setenv("SILVERGRAIN_FUSION_K", "30")
    monkeypatch.setenv("SILVERGRAIN_HOPS", "many")
    assert config.Settings.from_environment() == config.Settings(fusion_k=30)


def test_semantic_chunks_and_fallback(spark):
    """Groups by direction of their vectors and by words; few sentences, a failing or a short model fall back to words."""
    texts = ["Cats are nice. Cats do sleep. Stocks went up. Stocks fell again.", "One sentence here. Two sentences.", "w " * 600 + "and so it goes on."]
    own = spark.createDataFrame([("n", str(i), t) for i, t in enumerate(texts)], "namespace string, path string, text string")
    embed = lambda found: [[1.0, 0.0] if "ats" in t else [0.0, 1.0] for t in found]
    cut = lambda e, **o: {p: [r["text"] for r in sorted(rows, key=lambda r: r["chunk"])] for p in "012" for rows in [index.semantic_chunks(own, e, **o).where(F.col("path") == p).collect()]}
    found = cut(embed)
    assert found["0"] == ["Cats are nice. Cats do sleep.", "Stocks went up. Stocks fell again."]
    assert found["1"] == [texts[1]] and [len(t.split()) for t in found["2"]] == [512, 143]
    assert cut(embed, max_words=4)["0"] == ["Cats are nice.", "Cats do sleep.", "Stocks went up.", "Stocks fell again."]

    def broken(texts):
        raise RuntimeError("no model")

    assert cut(broken)["0"] == cut(lambda t: [])["0"] == [texts[0]]
    made = index.points(own, embed, strategy="semantic")
    assert made.where("path = '0'").count() == 2


def test_contexts_come_from_a_model(spark):
    own = spark.createDataFrame([("a", "x" * 300), ("b", "short"), ("c", "y" * 300)], "path string, text string")

    def ask(excerpt):
        if excerpt[0] == "y":
            raise RuntimeError
        return f" {excerpt[:3]} "

    assert {r["path"]: r["context"] for r in index.contexts(own, ask).collect()} == {"a": "xxx", "b": "", "c": ""}


def test_point_table_has_one_size(spark, tmp_path):
    path = f"file://{tmp_path}/points"
    assert index.ensure_points(spark, path, 2) and not index.ensure_points(spark, path, 2)
    with pytest.raises(ValueError, match="of 2 numbers"):
        index.ensure_points(spark, path, 3)
    assert index.read_points(spark, path).count() == 0
    rows = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "vector array<float>")
    assert index.sized(rows.limit(1), 2).count() == 1
    with pytest.raises(Exception, match="vectors must have 2 numbers, not 1"):
        index.sized(rows, 2).collect()


def test_look_ups_of_a_file(spark):
    rows = [("n", "a.md", 0, "one", '[{"type":"links_to","target":"b.md"},{"type":"defines","name":"X"},{"type":"imports","target":""}]'), ("n", "a.md", 1, "two", ""), ("n", "b.md", 0, "three", "broken"), ("m", "a.md", 0, "other", "")]
    own = spark.createDataFrame(rows, "namespace string, path string, chunk long, text string, relations string")
    assert [r["text"] for r in index.file_text(own, "a.md", "n").collect()] == ["one", "two"]
    assert index.file_text(own, "none.md").count() == 0
    assert [(r["kind"], r["value"], r["place"]) for r in graph.file_relations(own, "a.md").collect()] == [("leads_to", "b.md", 0), ("defines", "X", 1)]
    assert graph.file_relations(own, "b.md").count() == 0


def test_fan_out_over_tables_that_may_fail(spark):
    import time

    own = spark.createDataFrame([("a", "p", 0, 0.5), ("a", "q", 0, 0.9)], "namespace string, path string, chunk long, score double")

    def broken():
        raise RuntimeError

    def slow():
        time.sleep(20)

    began = time.monotonic()
    found, answered, failed = S.each_namespace(spark, {"a": lambda: own, "b": broken, "c": slow}, lambda p: p, seconds=5)
    assert (answered, sorted(failed)) == (["a"], ["b", "c"]) and time.monotonic() - began < 15
    assert [r["path"] for r in found.collect()] == ["q", "p"]
    found, answered, failed = S.each_namespace(spark, {"b": broken}, lambda p: p, seconds=5)
    assert found.count() == 0 and failed == ["b"]


def test_batch_search_keeps_the_best_over_batches_and_shares(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    vectors = rng.integers(-2, 3, (300, 3)).astype(float)  # many ties
    own = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, vector array<double>").repartition(3)
    monkeypatch.setattr(S, "QUERY_BLOCK", 7)
    monkeypatch.setattr(S, "SENT", 7 * 4 * 3 * 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    found = S.batch_search(spark, own, own.withColumnRenamed("vec_id", "query_id"), 4).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    norm = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(norm > 0, norm, 1)[:, None]
    like = np.round(unit @ unit.T, 9)
    for q in range(300):
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-like[q, i], i))[:4]
        assert [r["id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_rerank_by_a_model(spark):
    rows = spark.createDataFrame([("n", "a", 0, 0.9, "bad"), ("n", "b", 0, 0.5, "good text")], "namespace string, path string, chunk long, score double, text string")
    done = S.reranked(rows, "good", lambda q, texts: [float(q in t) for t in texts])
    assert [(r["path"], r["new_rank"]) for r in done.orderBy("new_rank").collect()] == [("b", 1), ("a", 2)]
    assert S.reranked(rows.limit(0), "good", lambda q, t: []).count() == 0


def test_safe_archive_paths_equal_the_plain_function(spark):
    names = ["a/b", "../a", "a/../../b", "/x", "a\\..\\b", "./", "a//b/./c", "..", "a/..", "a/../b/..", "\\x", "", "c/..d"]
    found = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.safe_archive_path(F.col("n")).alias("p")).collect()
    assert {r["n"]: r["p"] for r in found} == {n: T.clean_archive_path(n) for n in names}


def test_answer_cache_on_the_driver():
    now = [0.0]
    cache = governance.AnswerCache(2, 10, lambda: now[0])
    key = cache.key("n", "m", " Hello ")
    assert key == cache.key("n", "m", "hello") and cache.get(key) is None
    cache.put(key, "hi")
    cache.put("b", "x")
    assert cache.get(key) == "hi"
    cache.put("c", "y")  # b was used longest ago
    assert cache.get("b") is None and cache.get(key) == "hi"
    cache.put("d", "")
    assert cache.get("d") is None
    now[0] = 11.0
    assert cache.get(key) is None
    cache.indexed("n")
    assert cache.key("n", "m", "hello") != key


def test_stored_answers(spark):
    cache = spark.createDataFrame([("a", "A", 100.0, 1.0), ("b", "B", 100.0, 2.0), ("old", "O", 5.0, 3.0)], "cache_key string, answer string, expires_at double, used_at double")
    said = spark.createDataFrame([("a", "A", True), ("c", "C", False), ("c", "C", False), ("d", "", False)], "cache_key string, answer string, hit boolean")
    found = {r["cache_key"]: (r["expires_at"], r["used_at"]) for r in governance.stored_answers(cache, said, F.lit(10), 50, 10).collect()}
    assert found == {"a": (100.0, 10.0), "b": (100.0, 2.0), "c": (60.0, 10.0)}
    assert {r["cache_key"] for r in governance.stored_answers(cache, said, F.lit(10), 50, 2).collect()} == {"a", "c"}
    key = spark.range(1).select(ids.answer_key(F.lit("n"), F.lit(0), F.lit("m"), F.lit(" Hi ")).alias("k")).first()["k"]
    assert key == governance.AnswerCache().key("n", "m", " Hi ")


def test_vectors_are_made_once_and_kept(spark):
    key = lambda t: hashlib.sha256(t.encode()).hexdigest()[:32]
    cache = spark.createDataFrame([(key("a"), [1.0], 100.0, 1.0), (key("late"), [2.0], 5.0, 2.0)], "embed_key string, vector array<double>, expires_at double, inserted_at double")
    texts = spark.createDataFrame([("a",), ("b",), ("b",), ("late",), ("bad",)], "text string")
    embed = lambda df: df.withColumn("vector", F.when(F.col("text") != "bad", F.array(F.length("text").cast("double"))))
    found, filled = governance.with_vectors(texts, cache, embed, F.lit(10), 50, 10)
    assert sorted((r["text"], r["vector"], r["hit"]) for r in found.collect() if r["vector"]) == [("a", [1.0], True), ("b", [1.0], False), ("b", [1.0], False), ("late", [4.0], False)]
    assert found.where("vector IS NULL").count() == 1
    assert {r["embed_key"]: (r["expires_at"], r["inserted_at"]) for r in filled.collect()} == {key("a"): (100.0, 1.0), key("b"): (60.0, 10.0), key("late"): (60.0, 2.0)}
    assert {r["embed_key"] for r in governance.with_vectors(texts, cache, embed, F.lit(10), 50, 2)[1].collect()} == {key("b"), key("late")}


def test_answer_goes_the_whole_way(spark):
    from silvergrain.engine import Engine

    texts = [("n", "a.md", "apples are red and sweet [x](b.md)"), ("n", "b.md", "pears are green, see below"), ("n", "c.md", "cars are fast machines"), ("m", "d.md", "apples of another namespace")]
    own = index.points(spark.createDataFrame(texts, "namespace string, path string, text string"), index.hash_embedder()).persist()
    asked, said = [], []

    def model(prompt):
        said.append(prompt)
        return f"answer {len(said)}"

    def assess(question, rows):
        asked.append({r["text"] for r in rows})
        return {"confidence": 0.0, "follow_up_queries": ["cars"]} if len(asked) == 1 else {"answer_ready": True}

    engine = Engine(spark, own, model=model, assess=assess, reranker=lambda q, t: [float("cars" in x) for x in t], cache=governance.AnswerCache())
    assert engine.answer("apples", "n", k=1, expand=True) == "answer 1"
    assert len(asked) == 2 and "cars are fast machines" in said[0]
    assert engine.answer(" Apples ", "n", k=1) == "answer 1" and len(said) == 1
    engine.cache.indexed("n")
    assert engine.answer("apples", "n", k=1) == "answer 2"
    with pytest.raises(PermissionError):
        engine.answer("apples", "n", allowed=["m"])
    assert engine.answer("apples", "*", allowed=["m"]) == "answer 3" and "another namespace" in said[2] and "red and sweet" not in said[2]
    assert engine.search("cars", "n", k=2, rerank=True).orderBy("new_rank").first()["path"] == "c.md"
    assert [r["chunk"] for r in engine.file("a.md").collect()] == [0] and engine.file_relations("a.md").first()["value"] == "b.md"

    def failing(prompt):
        raise RuntimeError

    broken = Engine(spark, own, model=failing, cache=governance.AnswerCache())
    assert broken.answer("apples", "m", k=1).startswith("apples of another namespace") and not broken.cache.kept
    suite = spark.createDataFrame([("apples", "red", "n"), ("apples", "x", None), ("broken", "x", "m")], "question string, expected_answer string, namespace string")

    def judge(question, expected, context):
        if question == "broken":
            raise RuntimeError
        return {"confidence": 1.0, "contains_answer": expected in context}

    found = {(r["question"], r["namespace"]): r for r in Engine(spark, own).evaluate(suite, judge, lambda c, a: {"score": 0.9}, "m").collect()}
    assert found["apples", "n"]["verdict"] == "PASS" and found["apples", "m"]["context_recall"] == pytest.approx(0.3) and found["broken", "m"]["verdict"] == "FAIL"
