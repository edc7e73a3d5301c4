"""Listings, change detection, upserts and routing: scenarios laid out over whole tables by arithmetic on ids."""

from __future__ import annotations

import gzip
import io
import tarfile
import uuid
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import delta, point_table
from ..sources import files
from ..workspace import work_dir
from .catalog import query, table

# the listing is all documents; the state lacks every 13th, has a file more for every 11th, another hash for every 7th, another time for every 5th and no hash for every 17th
FILES = """listing AS (SELECT 'f' || doc_id AS path, n_chars AS size, 1700000000 + doc_id AS mtime, md5(text) AS partial_hash, md5(text) AS full_hash FROM documents),
state AS (SELECT 'f' || doc_id AS path, n_chars AS size, 1700000000 + doc_id + CASE WHEN doc_id % 5 = 0 THEN 60 ELSE 0 END AS mtime,
 CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN md5(text || 'x') ELSE md5(text) END AS partial_hash, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE md5(text) END AS full_hash FROM documents WHERE doc_id % 13 <> 0
 UNION ALL SELECT 'gone' || doc_id, n_chars, 1700000000, md5(text), md5(text) FROM documents WHERE doc_id % 11 = 0)"""


def listing(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    h = F.md5("text")
    return d.select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), (F.lit(1700000000) + F.col("doc_id")).alias("mtime"), h.alias("partial_hash"), h.alias("full_hash"))


def state(spark, sf_dir) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    h = F.md5("text")
    part = F.when(i % 17 == 0, None).when(i % 7 == 0, F.md5(F.concat("text", F.lit("x")))).otherwise(h)
    kept = d.where(i % 13 != 0).select(F.concat(F.lit("f"), i.cast("string")).alias("path"), F.col("n_chars").alias("size"), (F.lit(1700000000) + i + F.when(i % 5 == 0, 60).otherwise(0)).alias("mtime"), part.alias("partial_hash"), F.when(i % 3 == 0, None).otherwise(h).alias("full_hash"))
    gone = d.where(i % 11 == 0).select(F.concat(F.lit("gone"), i.cast("string")).alias("path"), F.col("n_chars").alias("size"), F.lit(1700000000).cast("long").alias("mtime"), h.alias("partial_hash"), h.alias("full_hash"))
    return kept.unionByName(gone)


ACTIONS = """SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'INDEX' WHEN a.path IS NULL THEN 'DELETE' {rest} END AS action FROM listing a FULL JOIN state b ON a.path = b.path"""
STAT = "(a.size = b.size AND a.mtime = b.mtime)"


@query(f"WITH {FILES} " + ACTIONS.format(rest=f"WHEN {STAT} AND b.partial_hash IS NULL THEN 'WARM' WHEN a.partial_hash = b.partial_hash AND NOT {STAT} THEN 'UPDATE_META' WHEN a.partial_hash = b.partial_hash THEN 'UNCHANGED' ELSE 'INDEX'"))
def delta_classify(spark, sf_dir):
    return delta.classify(listing(spark, sf_dir), state(spark, sf_dir))


@query(f"WITH {FILES} " + ACTIONS.format(rest=f"WHEN {STAT} AND b.partial_hash IS NULL THEN 'WARM' WHEN a.partial_hash = b.partial_hash AND NOT {STAT} THEN 'UPDATE_META' WHEN a.partial_hash = b.partial_hash AND a.full_hash = b.full_hash THEN 'UNCHANGED' ELSE 'INDEX'"))
def delta_classify_full(spark, sf_dir):
    return delta.classify(listing(spark, sf_dir), state(spark, sf_dir), full_hash=True)


@query(f"WITH {FILES} " + ACTIONS.format(rest=f"WHEN {STAT} THEN 'TOUCH' ELSE 'INDEX'"))
def delta_classify_stat(spark, sf_dir):
    return delta.classify(listing(spark, sf_dir), state(spark, sf_dir), use_hash=False)


@query(f"WITH {FILES} SELECT path FROM state WHERE path NOT IN (SELECT path FROM listing)")
def tombstones(spark, sf_dir):
    return delta.tombstones(listing(spark, sf_dir), state(spark, sf_dir))


@query(f"WITH {FILES} SELECT a.path, a.size, a.mtime, a.partial_hash, a.full_hash, 1800000000::BIGINT AS last_seen FROM listing a")
def next_file_state(spark, sf_dir):
    return delta.next_state(listing(spark, sf_dir), state(spark, sf_dir), 1800000000)


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id""")
def upsert_latest(spark, sf_dir):
    return delta.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])


@query("SELECT lang AS namespace, 'f' || doc_id AS path, md5(CASE WHEN doc_id % 2 = 0 THEN reverse(text) ELSE text END) AS digest, CAST(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS INT) AS version FROM documents")
def upsert_points(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    row = lambda df, text, v: df.select(F.col("lang").alias("namespace"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.md5(text).alias("digest"), F.lit(v).alias("version"))
    return delta.upsert(row(d, F.col("text"), 1), row(d.where("doc_id % 2 = 0"), F.reverse("text"), 2), ["namespace", "path"], ["version"])


@query("""WITH h AS (SELECT doc_id, lang AS namespace, 'f' || doc_id AS path, unnest([0::BIGINT, 1]) AS chunk, unnest([left(text, length(text) // 2), substr(text, length(text) // 2 + 1)]) AS half, text FROM documents)
SELECT namespace, path, chunk, md5(CASE WHEN doc_id % 35 = 0 THEN 'back ' || half WHEN doc_id % 5 = 0 THEN text ELSE half END) AS digest FROM h WHERE doc_id % 35 = 0 OR doc_id % 7 <> 0 AND (doc_id % 5 <> 0 OR chunk = 0)""")
def points_in_place(spark, sf_dir):
    """A table of two points a file after three rounds in place: every 5th file comes as one point, every 7th goes, every 35th comes back."""
    root, d, i = f"{work_dir(spark)}/in-place-{uuid.uuid4().hex}", table(spark, sf_dir, "documents"), F.col("doc_id")
    half = F.floor(F.length("text") / 2).cast("int")
    halves = F.posexplode(F.array(F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text")))).alias("chunk", "half")
    file = [F.col("lang").alias("namespace"), F.concat(F.lit("f"), i.cast("string")).alias("path")]
    cut = d.select(i, *file, halves)
    row = lambda df, text: df.select("namespace", "path", F.col("chunk").cast("long").alias("chunk"), F.md5(text).alias("digest"))
    first = row(cut, F.col("half"))
    point_table.create(first, root, 8)
    point_table.change(spark, root, d.where(i % 5 == 0).select(*file, F.lit(0).cast("long").alias("chunk"), F.md5("text").alias("digest")), None, 8)
    point_table.change(spark, root, first.limit(0), d.where(i % 7 == 0).select(*file), 8)
    point_table.change(spark, root, row(cut.where(i % 35 == 0), F.concat(F.lit("back "), "half")), None, 8)
    return point_table.read(spark, root, first.schema)


@query("SELECT lang AS namespace, 'f' || doc_id AS path FROM documents WHERE NOT (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))")
def delete_by_path(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.col("lang").alias("namespace"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), "doc_id")
    bad = own.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select("namespace", "path")
    return delta.delete_paths(own.drop("doc_id"), bad)


@query("""WITH p AS (SELECT source AS namespace, CASE WHEN doc_id % 6 = 0 THEN '[x]' ELSE '' END AS relations FROM documents)
SELECT namespace, round(avg(CAST(relations <> '' AS INT)), 9) AS coverage, count(*) AS n, round(avg(CAST(relations <> '' AS INT)), 9) < 0.2 AS migrate FROM p GROUP BY namespace""")
def relation_coverage(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select(F.col("source").alias("namespace"), F.lit(0).alias("chunk"), F.when(F.col("doc_id") % 6 == 0, "[x]").otherwise("").alias("relations"))
    return delta.relation_coverage(p)


@query("""WITH p AS (SELECT source AS namespace, 'f' || doc_id AS path, CAST(doc_id % 6 = 0 AND (source <> 'src1' OR doc_id % 2 = 0) AS INT) AS has FROM documents), s AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY path) AS i FROM p),
c AS (SELECT 'auto' AS mode, namespace, round(avg(has), 9) AS coverage, count(*) AS n, round(avg(has), 9) < 0.2 AS migrate FROM p GROUP BY ALL UNION ALL SELECT 'sampled', namespace, round(avg(has), 9), count(*), round(avg(has), 9) < 0.2 FROM s WHERE i <= 50 GROUP BY ALL)
SELECT * FROM c UNION ALL SELECT m, namespace, coverage, n, m = 'force' FROM c, (VALUES ('skip'), ('force')) t(m) WHERE mode = 'auto'""")
def migration_modes(spark, sf_dir):
    """Which namespaces extract their relations anew, by mode."""
    i = F.col("doc_id")
    has = (i % 6 == 0) & ((F.col("source") != "src1") | (i % 2 == 0))
    p = table(spark, sf_dir, "documents").select(F.col("source").alias("namespace"), F.concat(F.lit("f"), i.cast("string")).alias("path"), F.lit(0).alias("chunk"), F.when(has, "[x]").otherwise("").alias("relations"))
    out = delta.migrations(p, "auto", 50).withColumn("mode", F.lit("sampled"))
    for mode in ("auto", "skip", "force"):
        out = out.unionByName(delta.migrations(p, mode).withColumn("mode", F.lit(mode)))
    return out


@query("""WITH h AS (SELECT (SELECT min(ts) FROM events) + INTERVAL 1 HOUR AS t)
SELECT user_id, event_id FROM events, h WHERE ts > t AND user_id NOT IN (SELECT user_id FROM events, h WHERE ts <= t)""")
def seen_dedupe(spark, sf_dir):
    """Events of users that the first hour, as a start-up walk, has not met."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    end = F.lit(e.agg(F.min("ts").alias("t")).first()["t"]) + F.expr("INTERVAL 1 HOUR")
    return delta.not_seen(e.where(F.col("ts") > end).select("user_id", "event_id"), e.where(F.col("ts") <= end), "user_id")


@query("SELECT event_id AS id, event_type FROM events ORDER BY id LIMIT 5")
def queue_head(spark, sf_dir):
    return delta.queue_head(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type"), 5)


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 256")
def cache_eviction(spark, sf_dir):
    return delta.evict(table(spark, sf_dir, "events").select("event_id", "ts"), 256, "ts", "event_id")


# files: names with extensions by arithmetic on part keys
EXTS = ["mp3", "MP4", "jpg", "dng", "md", "py", "txt", "pdf", "lrf", "csv", "tmp"]
NAMES = f"n AS (SELECT p_partkey, '/data/' || (CASE WHEN p_partkey % 23 = 0 THEN '#recycle/' ELSE '' END) || 'd' || (p_partkey % 7) || '/f' || p_partkey || '.' || {EXTS!r}[p_partkey % {len(EXTS)} + 1] AS path, CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_size::BIGINT END AS size FROM part)"
EXT = r"lower(regexp_extract(path, '(\.[^./]*)$', 1))"
SKIP = {flags: "(" + ", ".join(f"'{e}'" for e in T.skipped_extensions(*flags)) + ")" for flags in [(False,) * 4, (True, False, False, True)]}


def names(spark, sf_dir):
    k = F.col("p_partkey")
    ext = F.element_at(F.array(*map(F.lit, EXTS)), (k % len(EXTS) + 1).cast("int"))
    path = F.concat(F.lit("/data/"), F.when(k % 23 == 0, "#recycle/").otherwise(""), F.lit("d"), (k % 7).cast("string"), F.lit("/f"), k.cast("string"), F.lit("."), ext)
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), F.when(F.col("p_size") % 10 == 0, 0).otherwise(F.col("p_size")).cast("long").alias("size"))


@query(f"WITH {NAMES} SELECT path, {EXT} IN {SKIP[(False,) * 4]} AS skip_none, {EXT} IN {SKIP[(True, False, False, True)]} AS skip_some FROM n")
def walk_skip_ext(spark, sf_dir):
    ext = T.extension(F.col("path"))
    return names(spark, sf_dir).select("path", ext.isin(*T.skipped_extensions(False, False, False, False)).alias("skip_none"), ext.isin(*T.skipped_extensions(True, False, False, True)).alias("skip_some"))


OUT = "(contains(path, '#recycle') OR regexp_matches(path, '/[^/]*\\.tmp$'))"


@query(f"WITH {NAMES} SELECT path, {OUT} AS excluded FROM n")
def walk_exclude(spark, sf_dir):
    return names(spark, sf_dir).select("path", T.excluded(F.col("path"), ["#recycle", "*.tmp"]).alias("excluded"))


@query(f"""WITH {NAMES}, c AS (SELECT size, {OUT} AS o, {EXT} IN {SKIP[(False,) * 4]} AS s FROM n)
SELECT count(*) AS seen, count(*) FILTER (WHERE o) AS excluded, count(*) FILTER (WHERE s AND NOT o) AS skipped_ext, count(*) FILTER (WHERE NOT s AND NOT o AND size = 0) AS empty, count(*) FILTER (WHERE NOT s AND NOT o AND size > 0) AS indexable, CAST(sum(size) FILTER (WHERE NOT s AND NOT o) AS BIGINT) AS bytes FROM c""")
def walk_stats(spark, sf_dir):
    return files.walk_stats(names(spark, sf_dir), {"whisper": False, "vision": False, "frames": False, "ocr": False}, ["#recycle", "*.tmp"])


@query(f"WITH {NAMES} SELECT path, {EXT} AS ext, CASE {EXT} WHEN '.csv' THEN 'sheets' WHEN '.pdf' THEN 'sheets' WHEN '.md' THEN 'notes' WHEN '.txt' THEN 'notes' END AS plugin FROM n")
def plugin_match(spark, sf_dir):
    plugins = spark.createDataFrame([(1, "sheets", [".csv", ".pdf"]), (2, "notes", [".md", ".txt", ".csv"])], "ord int, name string, extensions array<string>")
    return files.plugin_for(names(spark, sf_dir), plugins)


@query(f"WITH {NAMES} SELECT path, CASE WHEN {EXT} IN ('.png', '.jpg', '.jpeg', '.tiff', '.tif', '.bmp') THEN '[Image] ' WHEN {EXT} IN ('.mp4', '.mkv', '.webm') THEN '[Video] ' WHEN {EXT} IN ('.mp3', '.wav', '.m4a', '.ogg', '.flac') THEN '[Audio] ' WHEN {EXT} = '.pdf' THEN '[PDF] ' ELSE '' END AS tag FROM n")
def media_tags(spark, sf_dir):
    return names(spark, sf_dir).select("path", T.media_tag(F.col("path")).alias("tag"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN CAST([] AS INT[]) ELSE list_transform(range(0, p_size % 4), lambda i: CAST(i * 10 AS INT)) END AS seconds, concat_ws(chr(10) || chr(10), nullif(trim(p_name), ''), '[Frame at 10s] ' || p_type) AS text FROM part")
def video_texts(spark, sf_dir):
    caption = F.array(F.struct(F.lit(10).alias("second"), F.col("p_type").alias("text")))
    return table(spark, sf_dir, "part").select("p_partkey", files.frame_times(F.col("p_size") % 4, F.lit(10)).alias("seconds"), files.video_text(F.col("p_name"), caption).alias("text"))


# names as an archive might hold them: what stands before the name, and what is left of it (null: unsafe)
ENTRIES = [("../", None), ("a/./b/../", "a/"), ("/", None), ("a/../../", None), ("x\\\\y/", "x/y/"), ("./", ""), ("a//b/", "a/b/")]


@query(f"""SELECT p_partkey, {"[" + ", ".join("NULL" if k is None else f"'{k}'" for _, k in ENTRIES) + "]"}[p_partkey % {len(ENTRIES)} + 1] || p_partkey || '.txt' AS clean FROM part""")
def archive_paths(spark, sf_dir):
    k = F.col("p_partkey")
    path = F.concat(F.get(F.array(*(F.lit(b) for b, _ in ENTRIES)), (k % len(ENTRIES)).cast("int")), k.cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "part").select("p_partkey", T.safe_archive_path(path).alias("clean"))


# documents packed in archives of four kinds, by turns, with an entry that leads out
@query("""SELECT '/data/f' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.zip/d/t.txt' WHEN 1 THEN '.tar/d/t.txt' WHEN 2 THEN '.tar.gz/d/t.txt' ELSE '.txt.gz/f' || doc_id || '.txt' END AS path, md5(text) AS digest, false AS truncated FROM documents""")
def archive_entries(spark, sf_dir):
    """Archives opened, their entries read as plain text; the entry whose name leads out is left out."""

    # rows come in hundreds to a plain function: a batch of whole texts and their archives would be held several times over
    packed = F.udf(lambda i, t: archived(i % 4, t.encode()), "binary", useArrow=False)
    ext = F.get(F.array(*map(F.lit, (".zip", ".tar", ".tar.gz", ".txt.gz"))), (F.col("doc_id") % 4).cast("int"))
    path = F.concat(F.lit("/data/f"), F.col("doc_id").cast("string"), ext)
    found = files.expand_archives(table(spark, sf_dir, "documents").select(path.alias("path"), packed("doc_id", "text").alias("content")))
    return files.extract(found, []).select("path", F.md5("text").alias("digest"), "truncated")


def archived(kind: int, data: bytes) -> bytes:
    out = io.BytesIO()
    if kind == 0:
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("d/./t.txt", data)
            z.writestr("../out.txt", b"no")
    elif kind == 3:
        return gzip.compress(data, 1)
    else:
        with tarfile.open(fileobj=out, mode="w:gz" if kind == 2 else "w") as t:
            for name, body in (("d/t.txt", data), ("/out.txt", b"no")):
                info = tarfile.TarInfo(name)
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))
    return out.getvalue()


@query("""SELECT 'f' || doc_id || '.pdf' AS path, CASE WHEN length(regexp_replace(left(text, doc_id % 100), '^\\s+|\\s+$', '', 'g')) < 50 AND doc_id % 2 = 0 THEN md5('scanned ' || text) ELSE md5(left(text, doc_id % 100)) END AS digest FROM documents""")
def pdf_passes(spark, sf_dir):
    """Short texts of an extractor go to a second pass by OCR, and the longer one stays; here every other page has a scan."""
    text = lambda path, data: data.decode()[: int(path[1:-4]) % 100]
    scan = lambda path, data: "scanned " + data.decode() if int(path[1:-4]) % 2 == 0 else ""
    pages = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.encode("text", "utf-8").alias("content"))
    return files.extract(pages, [("pdf", (".pdf",), text)], scan).select("path", F.md5("text").alias("digest"))


# fixed values: XXH3 with 64 bits of the names of nations; of names of regions 600 000 times over, that of both ends (1 MiB each) and that of the whole
NATIONS = """NATION_0=cc857cb1532169dc
NATION_1=1c2df1eac0d6a519
NATION_2=06442d49d096c85d
NATION_3=326b5fc8619a6b1e
NATION_4=8fc65d7675f49ea6
NATION_5=5c9407d8a1a34364
NATION_6=baa45b30886090c9
NATION_7=044325dcf3509f94
NATION_8=ba86d849180f4b92
NATION_9=1a77d53b8dabf5ff
NATION_10=bb63fe14789461b5
NATION_11=9920f5ffbb64e9f9
NATION_12=e3b5055974b48692
NATION_13=6670f8f664b71382
NATION_14=0f8d78a1b5938026
NATION_15=10d40cf644ee55aa
NATION_16=4dbe5810be4d1325
NATION_17=9fa231e43c494811
NATION_18=f0a06f6f9c599363
NATION_19=6016450b317b19f0
NATION_20=8c93b002de2f39e2
NATION_21=28db555f1fa1b732
NATION_22=8754b54accb77758
NATION_23=6fa2ed6de12c94c8
NATION_24=3a14cf709f45d10e"""
REGIONS = """AFRICA=3a89ecda476b2be2 42f684b41974904c
AMERICA=c8115a3b59e34fc7 70e0478dc31aefbf
ASIA=92007cf7342f4a99 049aa7b362fcdf88
EUROPE=a03f74b9dbf4c09b dc909ada648f4a5f
MIDDLE EAST=9486d933cdc0dd9e 4a098a418f4aa547"""
_HASHED = [(n, h, h) for n, h in (x.split("=") for x in NATIONS.split("\n"))] + [(n, *h.split()) for n, h in (x.split("=") for x in REGIONS.split("\n"))]


@query("SELECT 'doc ' || doc_id AS name, strlen(text) AS n_bytes, NULL AS partial_hash, NULL AS full_hash, true AS alike FROM documents UNION ALL SELECT name, n_bytes, p, f, p = f FROM (SELECT n_name AS name, strlen(n_name) AS n_bytes FROM nation UNION ALL SELECT r_name, 600000 * strlen(r_name) FROM region) JOIN (VALUES " + ", ".join(map(str, _HASHED)) + ") h(k, p, f) ON k = name")
def file_hashes(spark, sf_dir):
    """Partial and full hashes: of names, short and long, against known digests; of documents, which a partial hash reads whole, against each other."""
    named = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.encode("n_name", "utf-8").alias("content")).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.encode(F.repeat("r_name", F.lit(600_000)), "utf-8").alias("content")))
    own = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), F.encode("text", "utf-8").alias("content"))
    shown = lambda c: F.when(~F.col("name").startswith("doc "), F.col(c)).alias(c)
    return files.hashes(named.unionByName(own)).select("name", F.octet_length("content").cast("long").alias("n_bytes"), shown("partial_hash"), shown("full_hash"), (F.col("partial_hash") == F.col("full_hash")).alias("alike"))
