"""Entries of archives, each read by itself.

A zip tells where its entries are in a directory at its end, a tar in a header before each. So one task reads where the entries of an archive are and hops
over their contents; the list is dealt evenly by size, and the entries of one archive are opened by as many tasks as there are.
Nothing holds an archive whole. A compressed tar can only be read from its start: one task streams it, an entry at a time.

Archives are opened by URI through the file systems of pyarrow (local paths and mounts, s3, hdfs).
"""

from __future__ import annotations

import gzip
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import files

ENTRY = "archive string, kind string, name string, path string, at long, size long"
#: Bytes of entries that a task reads.
TASK_BYTES = 64 << 20


def _opened(uri: str):
    """A seekable file; Hadoop's names of local and S3 files are understood."""
    plain = uri.replace("s3a://", "s3://", 1)
    plain = plain[5:] if plain.startswith("file:") and not plain.startswith("file://") else plain
    system, path = fs.FileSystem.from_uri(plain) if "://" in plain else (fs.LocalFileSystem(), plain)
    return system.open_input_file(path)


def _kind(path: str) -> str | None:
    name = path.lower()
    return "zip" if name.endswith(".zip") else "tar.gz" if name.endswith((".tar.gz", ".tgz")) else "tar" if name.endswith(".tar") else "gz" if name.endswith(".gz") else None


def _directory(path: str) -> Iterator[tuple]:
    """(kind, name, at, size) of each regular entry; ``at`` is its number, or its place where contents can be read from there."""
    kind = _kind(path)
    if kind in ("gz", "tar.gz"):
        yield kind, "", 0, 0
    elif kind == "zip":
        with _opened(path) as f, zipfile.ZipFile(f) as z:
            for i, info in enumerate(z.infolist()):
                if not info.is_dir():
                    yield kind, info.filename, i, info.file_size
    elif kind == "tar":
        with _opened(path) as f, tarfile.open(fileobj=f, mode="r:") as t:
            for info in t:
                if info.isfile():
                    yield kind, info.name, info.offset_data, info.size


def entries(archives: DataFrame) -> DataFrame:
    """Archives (path) to their entries (``ENTRY``), names that lead out left out; one that can't be read gives none. Compressed ones are one entry without a name.

    Only directories and headers are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                try:
                    found = list(_directory(path))
                except (OSError, ValueError, EOFError, zipfile.BadZipFile, tarfile.TarError):
                    found = []
                rows = [(path, k, n, f"{path}/{clean}" if n else path, at, size) for k, n, at, size in found if not n or (clean := T.clean_archive_path(n))]
                yield pd.DataFrame(rows, columns=["archive", "kind", "name", "path", "at", "size"])

    return archives.select("path").mapInPandas(run, ENTRY)


def _streamed(path: str, kind: str, most: int) -> Iterator[tuple[str, bytes, bool]]:
    """The entries of a compressed archive, one after the other, up to what it may unpack to."""
    with _opened(path) as f, gzip.GzipFile(fileobj=f) as g:
        if kind == "gz":
            body = g.read(most + 1)
            yield f"{path}/{path.rsplit('/', 1)[-1][:-3]}", body[:most], len(body) > most
            return
        with tarfile.open(fileobj=g, mode="r|") as t:
            for info in t:
                if info.offset > files.MOST_UNPACKED:
                    raise ValueError(f"{path} unpacks to more than is allowed")
                if info.isfile() and (clean := T.clean_archive_path(info.name)):
                    yield f"{path}/{clean}", t.extractfile(info).read(most), info.size > most


def contents(found: DataFrame, most: int = files.MOST_ENTRY) -> DataFrame:
    """Entries to (path, content, truncated): ``most`` bytes of each at most.

    Entries are dealt to tasks by size, those of one archive side by side, so a task opens few archives, and reads of each what it needs. An
    entry that turns out unreadable is left out; of a compressed archive, those before the fault stay.
    """
    total = found.agg(F.sum("size")).first()[0] or 0
    parts = max(1, min(1 << 14, -(-total // TASK_BYTES)))
    dealt = found.repartitionByRange(parts, "archive", "at").sortWithinPartitions("archive", "at") if parts > 1 else found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "content", "truncated"]
        for batch in batches:
            for archive, own in batch.groupby("archive", sort=False):
                kind = own["kind"].iloc[0]
                try:
                    if kind in ("gz", "tar.gz"):
                        for row in _streamed(archive, kind, most):
                            yield pd.DataFrame([row], columns=columns)
                        continue
                    with _opened(archive) as f:
                        z = zipfile.ZipFile(f) if kind == "zip" else None
                        listed = z.infolist() if z else None
                        for path, at, size in own[["path", "at", "size"]].itertuples(index=False, name=None):
                            try:
                                if z:
                                    with z.open(listed[at]) as e:
                                        body = e.read(most)
                                else:
                                    f.seek(at)
                                    body = f.read(min(size, most))
                            except (OSError, ValueError, EOFError, RuntimeError, NotImplementedError, zipfile.BadZipFile):
                                continue
                            yield pd.DataFrame([(path, body, size > most)], columns=columns)
                except (OSError, ValueError, EOFError, zipfile.BadZipFile, tarfile.TarError):
                    continue

    return dealt.mapInPandas(run, "path string, content binary, truncated boolean")
