"""Files, archives and extractors; streams held against the same functions on batches."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from silvergrain.sources import files
from silvergrain.sources import services as X
from silvergrain.streaming import events as E


@pytest.fixture
def root(tmp_path):
    (tmp_path / "a.md").write_text("hello world, this is a text")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/b.py").write_text("import os\n")
    (tmp_path / "x.jpg").write_bytes(b"1")
    (tmp_path / "y.tmp").write_text("t")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/c.txt", "zipped")
        z.writestr("../evil.txt", "no")
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w") as t:
        info = tarfile.TarInfo("d.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"tar"))
    (tmp_path / "t.tar.gz").write_bytes(gzip.compress(data.getvalue()))
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    return str(tmp_path)


def test_walk_and_archives(spark, root):
    found = {r["path"].rsplit("/", 1)[-1] for r in files.walk(spark, root, exclude=["*.tmp"]).select("path").collect()}
    assert found == {"a.md", "b.py", "z.zip", "t.tar.gz", "bad.zip"}
    inside = {r["path"].split(root.rsplit("/", 1)[-1] + "/")[-1]: bytes(r["content"]) for r in files.expand_archives(files.walk(spark, root, exclude=["*.tmp"])).collect()}
    assert inside["z.zip/in/c.txt"] == b"zipped" and inside["t.tar.gz/d.txt"] == b"tar" and inside["bad.zip"] == b"not a zip"
    assert not any("evil" in p for p in inside)


def test_listing_reads_no_content(spark, root):
    plan = files.listing(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "content:binary" not in plan


def test_extract_and_hashes(spark, root):
    own = files.walk(spark, root, exclude=["*.tmp"])
    texts = {r["path"].rsplit("/", 1)[-1]: r for r in files.extract(own, [("py", (".py",), lambda p, b: "from plugin")]).collect()}
    assert texts["a.md"]["text"].startswith("hello") and texts["b.py"]["text"] == "from plugin" and texts["z.zip"]["text"] is None
    hashed = files.hashes(own).where(F.col("path").endswith("a.md")).first()
    assert hashed["partial_hash"] == hashed["full_hash"] and len(hashed["full_hash"]) == 16


def test_pdf_retries_with_ocr(spark):
    pdf = spark.createDataFrame([("x.pdf", bytearray(b"1"))], "path string, content binary")
    assert files.extract(pdf, [("pdf", (".pdf",), lambda p, b: "short")], ocr=lambda p, b: "longer by ocr").first()["text"] == "longer by ocr"


def test_csv_and_mail(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n,\n2,\n")
    assert [r["text"] for r in files.csv_rows(spark, str(tmp_path / "t.csv")).collect()] == ["1 x", "2"]
    mail = spark.createDataFrame([(bytearray(b"Subject: Hi\nFrom: a@b\n\nbody"),)], "content binary")
    assert mail.select(files.mail_text("content").alias("t")).first()["t"].startswith("Subject: Hi\nFrom: a@b\n\nbody")


def streamed(spark, df, path, build, mode="append"):
    df.repartition(2).write.parquet(f"{path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{path}/in")
    query = build(source).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.parquet(f"{path}/out")


def test_debounce_stream_equals_batch(spark, tmp_path):
    rows = [("f", "write", "2024-01-01 00:00:00.000"), ("f", "write", "2024-01-01 00:00:00.400"), ("f", "chmod", "2024-01-01 00:00:00.800"), ("f", "write", "2024-01-01 00:00:05"), ("g", "delete", "2024-01-01 00:00:00.100"), ("late", "write", "2025-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "path string, op string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = {tuple(r) for r in E.debounced(df).where("path <> 'late'").collect()}
    assert len(batch) == 3 and {b[1] for b in batch} == {"chmod", "write", "delete"}
    assert {tuple(r) for r in streamed(spark, df, tmp_path, E.debounced).where("path <> 'late'").collect()} == batch


def test_metrics_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(f"2024-01-01 0{h}:10:00", "n", "complete", 2) for h in (1, 1, 2)] + [("2025-01-01 00:00:00", "n", "complete", 1)], "ts string, namespace string, status string, files_indexed long").withColumn("ts", F.col("ts").cast("timestamp"))
    old = "window_start < '2024-06-01'"
    assert {tuple(r) for r in streamed(spark, df, tmp_path, E.indexing_metrics).where(old).collect()} == {tuple(r) for r in E.indexing_metrics(df).where(old).collect()}


def test_dead_letters_and_retry(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")

    def fails(batch, n):
        raise RuntimeError

    E.in_batches(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), fails, f"{tmp_path}/cp", f"{tmp_path}/dead", once=True).awaitTermination(120)
    got = []
    assert E.retry(spark, f"{tmp_path}/dead", lambda b, n: got.extend(r["id"] for r in b.collect())) == 1
    assert sorted(got) == [1, 2]
    assert E.retry(spark, f"{tmp_path}/dead", fails) == 0


def test_frames(spark):
    row = spark.range(1).select(files.frame_times(F.lit(5), F.lit(10), 3).alias("t"), files.video_text(F.lit(" said "), F.array(F.struct(F.lit(10).alias("second"), F.lit("a cat").alias("text")))).alias("v"), files.video_text(F.lit(None).cast("string"), F.lit(None).cast("array<struct<second:int,text:string>>")).alias("none")).first()
    assert row["t"] == [0, 10, 20] and row["v"] == "said\n\n[Frame at 10s] a cat" and row["none"] == ""


@pytest.fixture
def server():
    """A local double of the services; its answers come from a function put on it."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            code, answer = self.server.answer(self.path, body)
            data = json.dumps(answer).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    web = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    web.url = f"http://127.0.0.1:{web.server_port}"
    yield web
    web.shutdown()


def test_services(server):
    calls = []

    def busy_first(path, body):
        calls.append(path)
        return (503, {}) if len(calls) < 3 else (200, {"text": "said"})

    server.answer = busy_first
    assert X.transcriber(server.url, waits=(0, 0, 0))("a.mp3", b"x") == "said" and len(calls) == 3
    server.answer = lambda path, body: (200, {"text": "ocr" if "ocr" in path else "plain"})
    assert X.extractor(server.url)("a.pdf", b"x") == "plain" and X.extractor(server.url, True)("a.pdf", b"x") == "ocr"
    server.answer = lambda path, body: (200, {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]})
    assert X.embedder("openai", server.url, "m")(["a", "b"]) == [[1.0], [2.0]]
    server.answer = lambda path, body: (200, {"results": [{"index": 1, "score": 0.5}]} if len(json.loads(body)["texts"]) == 2 else {})
    assert X.reranker(server.url)("q", ["a", "b"]) == [0.0, 0.5] and X.reranker(None)("q", ["a"]) == [0.0]
    with pytest.raises(ValueError, match="provider"):
        X.embedder("none", "", "")


def test_plugins(spark, tmp_path):
    (tmp_path / "a.py").write_text("# name: upper\n# extensions: .up, .x\nimport sys, json, base64\nd = json.load(sys.stdin)\nprint(json.dumps({'text': base64.b64decode(d['content']).decode().upper()}))\n")
    (tmp_path / "b.py").write_text("# name: late\n# extensions: .slow\nimport time\ntime.sleep(30)\n")
    found = X.discover(str(tmp_path))
    assert [(n, e) for n, e, _ in found] == [("upper", (".up", ".x")), ("late", (".slow",))]
    rows = files.extract(spark.createDataFrame([("f.up", bytearray(b"abc"))], "path string, content binary"), found).first()
    assert (rows["text"], rows["extractor"]) == ("ABC", "upper")
    with pytest.raises(Exception, match="timed out"):
        X.program(str(tmp_path / "b.py"), 0.5)("f", b"")
    assert X.discover(str(tmp_path / "none")) == []


def test_sinks(spark, server, tmp_path):
    from silvergrain.sources import sinks

    got = []
    server.answer = lambda path, body: (got.append(body) or (500 if len(got) == 1 else 200), {})
    batch = spark.createDataFrame([("n", "complete"), ("n", "in_progress")], "namespace string, status string")
    sinks.fan_out([sinks.webhook(server.url)])(batch, 0)
    assert len(got) == 2 and b"namespace.indexed" in got[1]
    sinks.append_registry(spark.createDataFrame([("n1", "http://h:1")], "id string, url string"), str(tmp_path / "reg"))
    assert sinks.registry(spark, str(tmp_path / "reg")).first()["url"] == "http://h:1"
    with pytest.raises(ValueError, match="database"):
        sinks.registry(spark, str(tmp_path / "reg"), high_availability=True)
    (tmp_path / "env").write_text("# c\nSG_TEST_A=1=2\n\nSG_TEST_B = 'x'\n")
    assert sinks.load_settings(str(tmp_path / "env")) == {"SG_TEST_A": "1=2", "SG_TEST_B": "x"}
    sinks.scrape_file(spark.createDataFrame([("h:1", "n")], "target string, namespace string"), str(tmp_path / "sd.json"))
    assert (tmp_path / "sd.json").read_text() == '[{"targets": ["h:1"], "labels": {"namespace": "n"}}]'


def test_language_models(server):
    import json

    asked = []
    answers = {"openai": {"choices": [{"message": {"content": "said"}}]}, "ollama": {"response": "said"}, "gemini": {"candidates": [{"content": {"parts": [{"text": "sa"}, {"text": "id"}]}}]}}
    for provider, answer in answers.items():
        server.answer = lambda path, body, answer=answer: (asked.append(json.loads(body)) or 200, answer)
        assert X.Generator(provider, server.url, "m", "key")("hello") == "said"
        assert "hello" in json.dumps(asked[-1])
    server.answer = lambda path, body: (200, {"response": '```json\n{"a": 1}\n```'})
    assert X.Generator("ollama", server.url, "m").json("hello") == {"a": 1}
    server.answer = lambda path, body: (200, {"response": "one line"})
    assert list(X.Generator("ollama", server.url, "m").stream("hello")) == ["one line"]
    ticks = iter([0.0, 0.5, 0.75])
    assert list(X.timed(iter(["a", "b"]), lambda: next(ticks))) == [(0.5, "a"), (0.75, "b")]
    with pytest.raises(ValueError, match="provider"):
        X.Generator("none", "", "")


def test_reranker_sends_long_lists_in_blocks(server):
    import json

    sizes = []

    def score(path, body):
        texts = json.loads(body)["texts"]
        sizes.append(len(texts))
        return 200, {"results": [{"index": i, "score": float(t)} for i, t in enumerate(texts)]}

    server.answer = score
    assert X.reranker(server.url)("q", [str(i) for i in range(250)]) == [float(i) for i in range(250)] and sizes == [100, 100, 50]


def test_plugin_behind_http_gives_relations(spark, server):
    import base64
    from silvergrain.operators import index
    server.answer = lambda path, body: (200, {"text": base64.b64decode(json.loads(body)["content"]).decode() + " and more words", "relations": [{"type": "imports", "target": "x"}]})
    own = spark.createDataFrame([("f.up", bytearray(b"abc"))], "path string, content binary")
    row = files.extract(own, [("side", (".up",), X.sidecar(server.url))]).first()
    assert row["text"] == "abc and more words" and json.loads(row["relations"]) == [{"type": "imports", "target": "x"}]
    made = index.points(files.extract(own, [("side", (".up",), X.sidecar(server.url))]).withColumn("namespace", F.lit("n")), index.hash_embedder()).first()
    assert json.loads(made["relations"]) == [{"type": "imports", "target": "x"}]
    server.answer = lambda path, body: (200, {"error": "no"})
    assert files.extract(own, [("side", (".up",), X.sidecar(server.url))]).first()["text"] is None


def test_sent_events(spark):
    from silvergrain.sources import sinks

    got, now = [], [0.0]
    handle = sinks.sent_events(got.append, 30, lambda: now[0])
    handle(spark.createDataFrame([("n", "complete")], "namespace string, status string"), 0)
    empty = spark.createDataFrame([], "namespace string, status string")
    handle(empty, 1)
    now[0] = 31.0
    handle(empty, 2)
    assert got == ['data: {"namespace":"n","status":"complete"}\n\n', ": keepalive\n\n"]


def test_progress_events(spark):
    rows = [("a", f"f{i}", f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00") for i in range(250)] + [("b", "x", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "namespace string, path string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    found = E.progress(df, 100).orderBy("files_indexed").collect()
    assert [(r["namespace"], r["files_indexed"], r["ts"].strftime("%H:%M")) for r in found] == [("a", 100, "01:39"), ("a", 200, "03:19")]


def test_walk_keeps_archives_whole_and_marks_cut_files(spark, tmp_path, monkeypatch):
    import io
    import zipfile

    monkeypatch.setattr(files, "MOST", 100)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in.txt", "inside " * 100)
    (tmp_path / "long.txt").write_text("x" * 500)
    (tmp_path / "short.txt").write_text("y" * 50)
    got = {r["path"].rsplit("/", 1)[-1]: r for r in files.walk(spark, str(tmp_path)).collect()}
    assert (len(got["long.txt"]["content"]), got["long.txt"]["truncated"], got["short.txt"]["truncated"], got["a.zip"]["truncated"]) == (100, True, False, False)
    assert zipfile.ZipFile(io.BytesIO(bytes(got["a.zip"]["content"]))).read("in.txt") == b"inside " * 100
    assert files.expand_archives(files.walk(spark, str(tmp_path))).where("path like '%a.zip/in.txt'").count() == 1


def test_readable_folders(spark, tmp_path):
    (tmp_path / "root" / "a" / "b").mkdir(parents=True)
    (tmp_path / "outside").mkdir()
    (tmp_path / "root" / "link").symlink_to(tmp_path / "outside")
    (tmp_path / "root" / "a" / "f.txt").write_text("hello there")
    fine, closed = files.readable_folders(spark, f"file://{tmp_path}/root")
    assert [p.split("/root")[1] for p in fine] == ["", "/a", "/a/b"] and closed == []


def test_breaker_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("s", f"2024-01-01 00:00:{i:02d}", False) for i in range(6)] + [("s", "2024-01-01 01:00:00", False), ("s", "2024-01-01 02:00:00", True), ("s", "2024-01-01 02:00:01", False)]
    df = spark.createDataFrame(rows, "service string, ts string, ok boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    try:
        got = [r["state"] for r in streamed(spark, df, tmp_path, E.breaker).orderBy("ts").collect()]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == ["failed"] * 4 + ["opened", "rejected", "opened", "closed", "failed"]


def test_metadata_of_extractors(spark):
    long = bytearray(b"x" * 2000)
    own = spark.createDataFrame([("a.png", bytearray(b"small"), False), ("b.png", long, True), ("c.mp3", bytearray(b"y"), False), ("d.txt", bytearray(b"plain"), False), ("e.png", bytearray(b"bad"), False)], "path string, content binary, truncated boolean")

    def vision(path, data):
        if data == b"bad":
            raise RuntimeError
        return f"a picture of {len(data)} bytes"

    speech = lambda path, data: ("said", None, {"segments": [{"start": 0.0, "end": 1.5, "text": "said"}]})
    found = {r["path"]: r for r in files.extract(own, X.media_extractors(speech=speech, vision=vision, vision_most=1000)).collect()}
    assert (found["a.png"]["text"], found["a.png"]["metadata"]) == ("a picture of 5 bytes", {"extraction_method": "vision"})
    assert (found["b.png"]["text"], found["b.png"]["metadata"], found["b.png"]["truncated"]) == ("", {"skipped": "size"}, True)
    assert json.loads(found["c.mp3"]["metadata"]["segments"])[0]["end"] == 1.5 and found["d.txt"]["metadata"] == {}
    assert found["e.png"]["text"] is None and found["e.png"]["metadata"] == {}


def test_busy_models_are_asked_again(server):
    calls = []

    def busy(path, body):
        calls.append(json.loads(body))
        if len(calls) % 2:
            return 503, {}
        sent = calls[-1]
        if "texts" in sent:
            return 200, {"results": [{"index": i, "score": len(t)} for i, t in enumerate(sent["texts"])]}
        if "content" in sent:
            return 200, {"embedding": {"values": [float(len(sent["content"]["parts"][0]["text"]))]}}
        return 200, {"embeddings": [[1.0] for _ in sent["input"]]}

    server.answer = busy
    none = (0, 0, 0)
    assert X.embedder("ollama", server.url, "m", waits=none)(["a", "b"]) == [[1.0], [1.0]] and len(calls) == 2
    assert X.embedder("gemini", server.url, "m", waits=none)(["a", "bb"]) == [[1.0], [2.0]] and len(calls) == 6
    assert X.reranker(server.url, none)("q", ["abc"]) == [3.0] and len(calls) == 8


def test_segments_of_speech(server):
    server.answer = lambda path, body: (200, {"text": "hello you", "segments": [{"id": 0, "start": 0, "end": 2, "text": "hello you", "tokens": [1]}]})
    assert X.transcriber(server.url, segments=True)("a.mp3", b"x") == ("hello you", None, {"segments": [{"start": 0, "end": 2, "text": "hello you"}]})
    assert X.transcriber(server.url, least=50, segments=True)("a.mp3", b"x") == ("", None, {})


def test_batch_search_in_shares_equals_one(spark, sf_dir, monkeypatch):
    from silvergrain.operators import search as S

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    asked = e.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    whole = sorted(map(tuple, S.batch_search(spark, e, asked, 4).collect()))
    monkeypatch.setattr(S, "SENT", 1)
    monkeypatch.setattr(S, "QUERY_BLOCK", 20)
    found = S.batch_search(spark, e, asked, 4)
    assert sorted(map(tuple, found.collect())) == whole
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1  # whatever the number of shares
