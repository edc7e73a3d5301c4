"""Tokens of access, payloads, pages, sketches, archives by entries and polls of a changing folder."""

from __future__ import annotations

import base64
import gzip
import hashlib
import hmac
import io
import json
import os
import random
import tarfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from silvergrain.functions import payload as P
from silvergrain.operators import access, delta, index, sketches
from silvergrain.sources import archives, files
from silvergrain.streaming import watch

# --- tokens


def url64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def token(claims, secret, kid="k", alg="HS256", head=None):
    message = f"{url64(json.dumps(head if head is not None else {'alg': alg, 'kid': kid}).encode())}.{url64(json.dumps(claims).encode())}"
    return f"{message}.{url64(hmac.new(secret, message.encode(), hashlib.sha256).digest())}"


SECRET = b"\x00\xff a secret that is longer than one block of the digest, " * 3
GOOD = {"sub": "ann", "aud": "search", "exp": 200, "groups": ["hr", "é"]}


def test_tokens_of_another_library(spark):
    keys = access.key_table(spark, {"k": SECRET, "short": b"s"})
    fine = token(GOOD, SECRET)
    cases = {
        "valid": [fine, token(GOOD, b"s", "short"), token({k: v for k, v in GOOD.items() if k != "groups"}, SECRET)],
        "forged": [fine[:-2] + ("AA" if fine[-2:] != "AA" else "BB"), token(GOOD, b"other"), fine.rsplit(".", 1)[0] + ".", ".".join([fine.split(".")[0], url64(json.dumps(GOOD | {"sub": "bob"}).encode()), fine.split(".")[2]])],
        "unknown key": [token(GOOD, SECRET, "nope")],
        "expired": [token(GOOD | {"exp": 100}, SECRET), token(GOOD | {"exp": 99}, SECRET)],
        "audience": [token(GOOD | {"aud": "other"}, SECRET), token({k: v for k, v in GOOD.items() if k != "aud"}, SECRET)],
        "malformed": [None, "", "a.b", "a.b.c.d", "..", "!!.??.x", token(GOOD, SECRET, alg="none"), token({"aud": "search"}, SECRET), token(GOOD, SECRET, head={"alg": "HS256"}), f"{url64(bytes([255, 254]))}.{url64(b'x')}.y", f"A.{url64(b'{}')}.y"],
    }
    rows = [(status, t) for status, own in cases.items() for t in own]
    found = access.checked(spark.createDataFrame(rows, "want string, token string"), keys, F.lit(100), "search").collect()
    assert len(found) == len(rows) and all(r["want"] == r["status"] for r in found), [(r["want"], r["status"], r["token"]) for r in found if r["want"] != r["status"]]
    assert all((r["sub"] is not None) == (r["status"] == "valid") for r in found)
    assert {tuple(r["groups"]) for r in found if r["groups"] is not None} == {("hr", "é"), ()}
    made = access.signed(spark.createDataFrame([("ann",)], "n string"), keys, F.lit("k"), F.struct(F.col("n").alias("sub"))).first()["token"]
    assert hmac.compare_digest(made.rsplit(".", 1)[1], url64(hmac.new(SECRET, made.rsplit(".", 1)[0].encode(), hashlib.sha256).digest()))


def test_chain_of_keys(spark):
    keys, acl = access.key_table(spark, {"k": SECRET}), spark.createDataFrame([("hr", ["a", "b"]), ("ops", ["*", "c"]), ("none", [])], "grp string, namespaces array<string>")
    claims = lambda *g: GOOD | {"groups": list(g)}
    headers = [None, "", "Bearer", "Bearer  x", "Basic key", "Bearer key", "bearer all", "Bearer wrong", "Bearer " + token(claims("hr"), SECRET), "BEARER " + token(claims("ops", "hr"), SECRET), "Bearer " + token(claims("none"), SECRET), "Bearer " + token(claims(), SECRET), "Bearer " + token(claims("hr") | {"exp": 1}, SECRET)]
    static = spark.createDataFrame([("key", ["z"])], "api_key string, namespaces array<string>")
    requests = spark.createDataFrame(list(enumerate(headers)), "request_id int, header string")
    found = {r["request_id"]: (r["code"], r["user"], r["namespaces"]) for r in access.authorised(requests, keys, acl, F.lit(100), "search", static, "all").collect()}
    assert [found[i][0] for i in range(len(headers))] == [401] * 5 + [200, 200, 401, 200, 200, 403, 403, 401]
    assert found[5] == (200, None, ["z"]) and found[6] == (200, None, ["*"]) and found[8] == (200, "ann", ["a", "b"]) and found[9] == (200, "ann", ["*"]) and found[10] == (403, "ann", None)
    bare = {r["request_id"]: r["code"] for r in access.authorised(requests, keys, acl, F.lit(100), "search").collect()}
    assert bare[5] == bare[6] == 401 and bare[8] == 200
    users = access.namespaces(access.checked(spark.createDataFrame([(token(claims("hr"), SECRET),), (token(claims("ops"), SECRET),)], "token string"), keys, F.lit(100), "search"), acl).collect()
    assert [(r["user"], r["namespaces"]) for r in users] == [("ann", ["*"])]


# --- payloads


def test_payload_fields(spark):
    rows = ['{"a": 1, "b": {"c": [10, 20]}}', '{"a": "7", "b": 2}', '{"a": 1.9}', '{"a": "x"}', "{}", "null", "nonsense", None, '{"a": true}', '{"a b.c": 3}']
    own = spark.createDataFrame(list(enumerate(rows)), "id int, t string").select("id", P.parsed(F.col("t")).alias("p"))
    found = {r["id"]: (r["a"], r["c"]) for r in P.fields(own, "p", {"a": "bigint"}).withColumn("c", P.field(F.col("p"), "$.b.c[1]", "int")).collect()}
    assert [found[i][0] for i in range(9)] == [1, 7, 1, None, None, None, None, None, 1] and found[0][1] == 20 and found[1][1] is None
    assert P.fields(own, "p", {"a b.c": "int"}).where("id = 9").first()["a b.c"] == 3
    assert "BIGINT" in P.schema(own.where("id = 0"), "p")
    with pytest.raises(ValueError, match="id"):
        P.fields(own, "p", {"id": "int"})


# --- pages


def test_pages_join_to_the_scan_though_points_come_between(spark):
    keys = sorted({(ns, f"f{i % 37}", i) for ns in "ab" for i in range(90)})
    points = spark.createDataFrame(keys, "namespace string, path string, chunk long")
    seen, after = [], None
    while True:
        page, token = index.scroll(points, after, 25)
        seen += [tuple(r) for r in page.collect()]
        after = token()
        if after is None:
            break
        # one that lies before the page does not shift the next, one behind it is met
        early, late = (("", "f0", 0), (after[0], after[1], after[2] + 1000))
        points = points.union(spark.createDataFrame([early, late], points.schema))
    assert seen == sorted(set(seen)) and set(keys) <= set(seen) and ("", "f0", 0) not in seen
    assert [r["namespace"] for r in index.scroll(points, None, 3, "b")[0].collect()] == ["b"] * 3
    assert index.scroll(points.limit(0))[1]() is None


# --- sketches


def test_sketched_counts_follow_changes(spark, tmp_path):
    root = f"{tmp_path}/s"
    point = lambda lo, hi, ns="a": spark.range(lo, hi).select(F.lit(ns).alias("namespace"), F.col("id").cast("string").alias("point_id"))
    at = lambda where=root: {r["namespace"]: r["n"] for r in sketches.counts(spark, where).collect()}
    sketches.note(point(0, 3000).union(point(0, 10, "b")), None, root, 0)
    sketches.note(point(3000, 3500), point(0, 1000), root, 1)
    assert at() == {"a": 2500, "b": 10}
    sketches.note(point(3000, 3500), point(0, 1000), root, 1)  # again
    sketches.note(point(0, 100), point(0, 10, "b"), root, 2)  # some come back, others go
    assert at() == {"a": 2600, "b": 0}
    sketches.compact(spark, root, f"{tmp_path}/one")
    assert at(f"{tmp_path}/one") == at()
    sketches.note(point(10_000, 110_000), None, root, 3)
    assert abs(at()["a"] / 102_600 - 1) < 0.05
    assert "point_id" not in str(sketches.counts(spark, root)._jdf.queryExecution().executedPlan().toString())


# --- archives


def zipped(path, rows):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in rows:
            z.writestr(name, data)


def tarred(path, rows, mode):
    with tarfile.open(path, mode) as t:
        for name, data in rows:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "x"
        t.addfile(link)


def test_entries_are_read_apart(spark, tmp_path, monkeypatch):
    rnd = random.Random(1)
    rows = [(f"d{i % 3}/f{i}.txt", rnd.randbytes(40_000)) for i in range(60)] + [("../out", b"no"), ("/root", b"no"), ("empty", b"")]
    zipped(tmp_path / "a.zip", rows)
    tarred(tmp_path / "b.tar", rows, "w")
    tarred(tmp_path / "c.tar.gz", rows, "w:gz")
    (tmp_path / "d.txt.gz").write_bytes(gzip.compress(b"plain"))
    (tmp_path / "bad.zip").write_bytes(b"PK not a zip")
    (tmp_path / "bad.tar.gz").write_bytes(b"\x1f\x8b nonsense")
    monkeypatch.setattr(archives, "TASK_BYTES", 300_000)
    found = archives.entries(files.listing(spark, f"file://{tmp_path}")).cache()
    sizes = {r["archive"].rsplit("/", 1)[1]: r["n"] for r in found.groupBy("archive").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {"a.zip": 61, "b.tar": 61, "c.tar.gz": 1, "d.txt.gz": 1, "bad.tar.gz": 1}
    read = archives.contents(found)
    tasks = read.withColumn("t", F.spark_partition_id()).where("path LIKE '%a.zip%'").select("t").distinct().count()
    assert tasks > 3  # one archive, several tasks
    got = {r["path"].split(str(tmp_path))[1]: bytes(r["content"]) for r in read.collect()}
    want = {f"/{a}/{n}": d for a in ("a.zip", "b.tar", "c.tar.gz") for n, d in rows if n not in ("../out", "/root")} | {"/d.txt.gz/d.txt": b"plain"}
    assert got == want
    same = {r["path"]: (len(r["content"]), r["truncated"]) for r in archives.contents(archives.entries(files.listing(spark, f"file://{tmp_path}", "*.zip")), 100).collect()}
    assert set(same.values()) == {(100, True), (0, False)}


# --- polls


def test_polls_equal_classified_listings(spark, tmp_path):
    root, store = tmp_path / "root", f"{tmp_path}/store"
    (root / "a").mkdir(parents=True)
    (root / "a" / "one.txt").write_text("one")
    (root / "two.txt").write_text("two")
    at = lambda n: {(r["path"].split("/root/")[1], r["action"]) for r in watch.poll(spark, f"file://{root}", store, n).collect()}
    assert at(0) == {("a/one.txt", "INDEX"), ("two.txt", "INDEX")}
    assert at(1) == set()
    (root / "new" / "deep").mkdir(parents=True)
    (root / "new" / "deep" / "three.txt").write_text("three")
    (root / "two.txt").write_text("two is longer")
    (root / "a" / "one.txt").unlink()
    state = watch.state_before(spark, store, 2)
    want = {(r["path"].split("/root/")[1], r["action"]) for r in delta.classify(watch.listed(spark, f"file://{root}"), state, use_hash=False).where("action <> 'TOUCH'").collect()}
    assert at(2) == want == {("new/deep/three.txt", "INDEX"), ("two.txt", "INDEX"), ("a/one.txt", "DELETE")}
    assert at(2) == want  # a poll that is repeated
    assert at(3) == set()
    os.utime(root / "two.txt", (1, 1))
    hashed = f"{tmp_path}/hashed"
    assert watch.poll(spark, f"file://{root}", hashed, 0, hashed=True).count() == 2
    os.utime(root / "two.txt", (5000, 5000))  # another time, the same content
    assert [r["action"] for r in watch.poll(spark, f"file://{root}", hashed, 1, hashed=True).collect()] == ["UPDATE_META"]
    assert watch.listed(spark, f"file://{tmp_path}/nowhere").count() == 0


def test_a_watch_goes_on_where_it_stopped(spark, tmp_path):
    root, store, mark, seen = tmp_path / "root", f"{tmp_path}/store", f"{tmp_path}/mark", []
    root.mkdir()
    (root / "f0.txt").write_text("zero")

    def run(until):
        query = watch.watch(spark, f"file://{root}", store, mark, lambda c, n: seen.extend((r["path"].rsplit("/", 1)[1], r["action"]) for r in c.collect()), every="1 second")
        end = time.monotonic() + 60
        while not until() and time.monotonic() < end:
            time.sleep(0.2)
        query.stop()
        assert query.exception() is None

    run(lambda: len(seen) >= 1)
    (root / "f1.txt").write_text("one")
    (root / "f0.txt").unlink()
    run(lambda: len(seen) >= 3)
    assert sorted(set(seen)) == [("f0.txt", "DELETE"), ("f0.txt", "INDEX"), ("f1.txt", "INDEX")]
    # what was handed on can be followed as a stream of its own
    query = watch.changes(spark, store).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
