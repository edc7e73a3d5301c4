"""Scanning and reading files. Any URI that Hadoop opens is a source: local folders, s3a://, sftp://, mounted shares."""

from __future__ import annotations

import email
import gzip
import io
import json
import mailbox
import os
import tarfile
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from email import policy

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import ids
from ..functions import text as T

#: Bytes kept of a file and of an archive's entry; the largest archive that is opened, and what it may unpack to.
MOST, MOST_ENTRY, MOST_ARCHIVE, MOST_UNPACKED = 50 << 20, 10 << 20, 512 << 20, 2 << 30
#: Bytes of an Arrow batch that a Python worker opens at a time; the batch itself is up to 64 MiB (spark.sql.execution.arrow.maxBytesPerBatch).
PIECE = 4 << 20
#: Backends by type of node and the scheme that reaches them.
SCHEMES = {"local": "file", "s3": "s3a", "sftp": "sftp", "smb": "file", "nfs": "file"}
ARCHIVES = (".zip", ".tar", ".gz", ".tgz")


def uri(backend: str, root: str) -> str:
    """Where a backend's files are; smb and nfs are read through their mounts, unknown types are local."""
    return root if "://" in root else f"{SCHEMES.get(backend, 'file')}://{root}"


def listing(spark: SparkSession, root: str | list[str], glob: str | None = None) -> DataFrame:
    """path, size, mtime (seconds) of all files below; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(root).select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))


def walk(spark: SparkSession, root: str | list[str], flags: dict[str, bool] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """path, size, mtime, content, truncated of the files that are to be indexed; filters on the path come before any content is read.

    Of a file over MOST bytes the first ones are kept and ``truncated`` says so; archives up to MOST_ARCHIVE are kept whole, to be opened.
    Files that vanish meanwhile are left out.
    """
    flags = {"whisper": False, "vision": False, "frames": False, "ocr": False} | (flags or {})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    archive = F.lower("path").rlike(r"\.(zip|tar|gz|tgz)$") & (F.col("length") <= MOST_ARCHIVE)
    long = (F.col("length") > MOST) & ~archive
    wanted = ~T.extension(F.col("path")).isin(*T.skipped_extensions(**flags)) & ~T.excluded(F.col("path"), exclude or [])
    return files.where(wanted).select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), F.when(long, F.substring("content", 1, MOST)).otherwise(F.col("content")).alias("content"), long.alias("truncated"))


def readable_folders(spark: SparkSession, root: str) -> tuple[list[str], list[str]]:
    """The folders below a root that can be listed, and those that can't; links that lead out of it are not followed.

    For roots where some folders are closed: ``walk`` and ``listing`` take such a list, and Spark lists the rest in parallel.
    """
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    # Hadoop follows local links without a word, so for local folders the driver looks itself
    real_of = lambda p: os.path.realpath(p.toUri().getPath()) if system.getScheme() == "file" else system.resolvePath(p).toString()
    base = real_of(top).rstrip("/")
    fine, closed, waiting = [], [], [top]
    while waiting:
        at = waiting.pop()
        try:
            real = real_of(at).rstrip("/")
            if real != base and not real.startswith(base + "/"):
                continue
            below = list(system.listStatus(at))
        except Py4JJavaError:
            closed.append(at.toString())
            continue
        fine.append(at.toString())
        waiting += [f.getPath() for f in below if f.isDirectory()]
    return sorted(fine), sorted(closed)


def walk_stats(files: DataFrame, flags: dict[str, bool], exclude: list[str]) -> DataFrame:
    """One row of counts over a listing (path, size): seen, skipped by extension, excluded, empty, indexable, bytes."""
    by_ext = T.extension(F.col("path")).isin(*T.skipped_extensions(**flags))
    out = T.excluded(F.col("path"), exclude)
    own = ~by_ext & ~out & (F.col("size") > 0)
    return files.agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(out).alias("excluded"), F.count_if(by_ext & ~out).alias("skipped_ext"), F.count_if(~by_ext & ~out & (F.col("size") == 0)).alias("empty"), F.count_if(own).alias("indexable"), F.coalesce(F.sum(F.when(own, F.col("size"))), F.lit(0)).cast("long").alias("bytes")
    )


def hashes(files: DataFrame) -> DataFrame:
    """files with partial_hash (XXH3 over both ends of large ones) and full_hash."""
    return files.withColumn("partial_hash", ids.xxh3_udf(ids.sparse_bytes(F.col("content")))).withColumn("full_hash", ids.xxh3_udf("content"))


def _entries(path: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """The files in an archive, a byte more than MOST_ENTRY of long ones; raises if it can't be read."""
    name = path.lower()
    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    with z.open(info) as f:
                        yield info.filename, f.read(MOST_ENTRY + 1)
        return
    if name.endswith((".gz", ".tgz")):
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as g:
            plain = g.read(MOST_UNPACKED + 1)
        if len(plain) > MOST_UNPACKED:
            raise ValueError("it unpacks to more than is allowed")
        if not name.endswith((".tar.gz", ".tgz")):
            yield path.rsplit("/", 1)[-1][:-3], plain[: MOST_ENTRY + 1]
            return
        data = plain
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for info in t:
            if info.isfile():
                yield info.name, t.extractfile(info).read(MOST_ENTRY + 1)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """The rows of Arrow batches in frames of about PIECE bytes, one row at least: what a worker holds beside a batch does not grow with it."""
    for batch in batches:
        step = max(1, batch.num_rows * PIECE // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step).to_pandas()
        del batch
        pa.default_memory_pool().release_unused()


def expand_archives(files: DataFrame) -> DataFrame:
    """files (path, content, truncated), archives replaced by their entries as archive/entry; unsafe names are left out.

    Of an entry over MOST_ENTRY bytes the first ones are kept and ``truncated`` says so. What can't be opened, other formats (7z, iso)
    and too large archives pass as they are.
    """

    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("truncated", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for path, data, cut in zip(batch["path"], batch["content"], batch["truncated"]):
                rows = [(path, data, bool(cut))]
                if path.lower().endswith(ARCHIVES) and data is not None and len(data) <= MOST_ARCHIVE:
                    try:
                        rows = [(f"{path}/{clean}", body[:MOST_ENTRY], len(body) > MOST_ENTRY) for name, body in _entries(path, bytes(data)) if (clean := T.clean_archive_path(name))]
                    except (OSError, ValueError, EOFError, zipfile.BadZipFile, tarfile.TarError):
                        pass
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, schema.types)], schema=schema)

    cut = F.coalesce("truncated", F.lit(False)) if "truncated" in files.columns else F.lit(False)
    return files.select("path", "content", cut.alias("truncated")).mapInArrow(run, "path string, content binary, truncated boolean")


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A row of text for each row of a CSV file: its non-empty values with spaces between; blank rows go."""
    rows = spark.read.option("header", "true").csv(path)
    return rows.select(joined_values(rows.columns).alias("text")).where("text <> ''")


def joined_values(columns: list[str]):
    return F.concat_ws(" ", *(F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns))


@F.pandas_udf(StringType())
def mail_text(contents: pd.Series) -> pd.Series:
    """Subject, sender and plain body of a message, or of each message of a mailbox."""

    def one(message) -> str:
        body = message.get_body(preferencelist=("plain", "html"))
        return f"Subject: {message['Subject'] or ''}\nFrom: {message['From'] or ''}\n\n{body.get_content() if body else ''}"

    def text(data: bytes | None) -> str | None:
        if data is None:
            return None
        parse = lambda b: email.message_from_bytes(b, policy=policy.default)
        if not bytes(data).startswith(b"From "):
            return one(parse(bytes(data)))
        with tempfile.NamedTemporaryFile() as f:  # mailbox wants a file; it goes with the call
            f.write(data)
            f.flush()
            return "\n\n".join(one(parse(m.as_bytes())) for m in mailbox.mbox(f.name))

    return contents.map(text)


def extract(files: DataFrame, extractors: list[tuple[str, tuple[str, ...], Callable[[str, bytes], str]]], ocr: Callable[[str, bytes], str] | None = None, ocr_below: int = 50) -> DataFrame:
    """files (path, content) with ``text``, ``extractor``, ``relations`` (JSON, of extractors that give (text, relations), else empty), ``metadata`` (a map) and ``truncated``.

    Plain files are decoded. Otherwise the first of ``extractors`` (name, extensions, function) that takes the extension
    runs, in Arrow batches; it gives a text, (text, relations) or (text, relations, metadata). A PDF whose text is short goes to ``ocr`` too, and the longer
    of both stays. Failures give null. ``truncated`` is that of the files, false if they have none.
    """

    text_map = pa.map_(pa.string(), pa.string())
    schema = pa.schema([*((n, pa.string()) for n in ("path", "text", "extractor", "relations")), ("metadata", text_map), ("truncated", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, names, found, notes = [], [], [], []
            for path, data in zip(batch["path"], batch["content"]):
                ext = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
                name, work = next(((n, f) for n, exts, f in extractors if ext in exts), (None, None))
                relations, note = None, {}
                try:
                    if work is None and ext in T.PLAIN:
                        name, text = "plain", bytes(data).decode("utf-8", "replace")
                    else:
                        text = work(path, bytes(data)) if work else None
                        if isinstance(text, tuple):
                            text, relations, note = (*text, {})[:3]
                    if ext == ".pdf" and ocr and text is not None and len(text.strip()) < ocr_below:
                        text = max(text, ocr(path, bytes(data)), key=lambda t: len(t.strip()))
                except Exception:  # noqa: BLE001 - an injected extractor may fail in any way
                    text, relations, note = None, None, {}
                texts.append(text)
                names.append(name)
                found.append(json.dumps(relations) if relations else "")
                notes.append(list({str(k): v if isinstance(v, str) else json.dumps(v) for k, v in note.items()}.items()))
            columns = [batch["path"].tolist(), texts, names, found, notes, batch["truncated"].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    cut = F.coalesce("truncated", F.lit(False)) if "truncated" in files.columns else F.lit(False)
    return files.select("path", "content", cut.alias("truncated")).mapInArrow(run, "path string, text string, extractor string, relations string, metadata map<string,string>, truncated boolean")


def frame_times(n, interval, most: int | None = None):
    """Seconds at which frames are taken: every ``interval``, n of them, the first ``most`` if that is given."""
    n = n if most is None else F.least(n, F.lit(most))
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1) * interval, interval)).otherwise(F.array().cast("array<int>"))


def video_text(transcript, captions):
    """A transcript and captions (array of struct<second, text>) as one text; either may be missing."""
    lines = F.transform(F.coalesce(captions, F.array().cast("array<struct<second:int,text:string>>")), lambda c: F.concat(F.lit("[Frame at "), c["second"].cast("string"), F.lit("s] "), c["text"]))
    return F.concat_ws("\n\n", F.array_compact(F.concat(F.array(F.nullif(F.trim(transcript), F.lit(""))), lines)))


def plugin_for(files: DataFrame, plugins: DataFrame) -> DataFrame:
    """files (path) with the name of the first plugin (ord, name, extensions) that takes the extension, or null.

    Plugins are a handful; their extensions are one small row each.
    """
    takes = plugins.select("ord", "name", F.explode("extensions").alias("ext")).groupBy("ext").agg(F.min_by("name", "ord").alias("plugin"))
    return files.withColumn("ext", T.extension(F.col("path"))).join(takes, "ext", "left").select("path", "ext", "plugin")
