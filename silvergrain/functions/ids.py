"""Identifiers and digests."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the name space under which point ids are made.
POINT_SPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
#: Bytes at each end that a sparse hash reads of a file over twice that size.
SPARSE = 1 << 20


def uuid5(name: Column, space: str = POINT_SPACE) -> Column:
    """UUID of version 5 as text: SHA-1 over the name space and the name, with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(space.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def point_id(path: Column, chunk: Column, namespace: Column | None = None) -> Column:
    """Id of a chunk. With a namespace, equal paths of two namespaces differ; without, they don't (compatible form)."""
    parts = [path, chunk.cast("string")] if namespace is None else [namespace, path, chunk.cast("string")]
    return uuid5(F.concat_ws(":", *parts))


def answer_key(namespace: Column, generation: Column, model: Column, query: Column) -> Column:
    """Key of a cached answer; null where a part is null, so that requests that lack different parts share none."""
    bar = F.lit("|")
    return F.sha2(F.concat(namespace, bar, generation.cast("string"), bar, model, bar, F.lower(F.trim(query))), 256)


def embedding_key(text: Column) -> Column:
    """Key of a cached query vector: half of a SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 32)


def sparse_bytes(content: Column) -> Column:
    """What the sparse hash of a file reads: all of a small one, both ends of a large one."""
    return F.when(F.octet_length(content) <= 2 * SPARSE, content).otherwise(F.concat(F.substring(content, 1, SPARSE), F.substring(content, -SPARSE, SPARSE)))


@F.pandas_udf(StringType())
def xxh3_udf(data: pd.Series) -> pd.Series:
    """XXH3 with 64 bits, as 16 hex digits; Spark's xxhash64 is another function."""
    return data.map(lambda b: None if b is None else xxhash.xxh3_64_hexdigest(b))
