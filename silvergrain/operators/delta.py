"""Change detection: a listing against the state of the last one.

listing and state: path, size, mtime, partial_hash, full_hash (state also last_seen). One full join on path decides about
every file; nothing is looked up by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify(listing: DataFrame, state: DataFrame, use_hash: bool = True, full_hash: bool = False) -> DataFrame:
    """path and action: INDEX, TOUCH, WARM (store the hash only), UPDATE_META, UNCHANGED or DELETE.

    Without hashes the stat decides. With them, an equal partial hash means an unchanged file whatever its time; with
    ``full_hash``, files whose stat and partial hash agree are held to the full one too. DELETE: in the state and not listed.
    """
    a, b = listing.alias("a"), state.alias("b")
    same_stat = (F.col("a.size") == F.col("b.size")) & (F.col("a.mtime") == F.col("b.mtime"))
    by_stat = F.when(same_stat, "TOUCH").otherwise("INDEX")
    same_part = F.col("a.partial_hash") == F.col("b.partial_hash")
    whole = F.when(F.col("a.full_hash").isNull(), "INDEX").when(F.col("a.full_hash") == F.col("b.full_hash"), "UNCHANGED").otherwise("INDEX")
    hashed = (
        F.when(F.col("a.partial_hash").isNull(), by_stat)
        .when(same_stat & F.col("b.partial_hash").isNull(), "WARM")
        .when(same_part & ~same_stat, "UPDATE_META")
        .when(same_part, whole if full_hash else F.lit("UNCHANGED"))
        .otherwise("INDEX")
    )
    action = F.when(F.col("b.path").isNull(), "INDEX").when(F.col("a.path").isNull(), "DELETE").otherwise(hashed if use_hash else by_stat)
    return a.join(b, F.col("a.path") == F.col("b.path"), "full").select(F.coalesce("a.path", "b.path").alias("path"), action.alias("action"))


def tombstones(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Paths of the state that are no longer listed."""
    return state.join(listing, "path", "left_anti").select("path")


def next_state(listing: DataFrame, state: DataFrame, now: int, use_hash: bool = True) -> DataFrame:
    """The state after a poll: listed files with both hashes, stamped; files that are gone are gone."""
    known = state.select("path", F.col("partial_hash").alias("_p"), F.col("full_hash").alias("_f"))
    held = listing.join(known, "path", "left")
    part = F.coalesce("partial_hash", "_p") if use_hash else F.col("_p")
    return held.select("path", "size", "mtime", part.alias("partial_hash"), F.coalesce("full_hash", "_f").alias("full_hash"), F.lit(now).cast("long").alias("last_seen"))


def latest(rows: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """One row a key: the last by the given columns (what an upsert leaves)."""
    # max over a struct combines before the shuffle, where a numbered window would not
    rest = [c for c in rows.columns if c not in key and c not in by]
    found = rows.groupBy(*key).agg(F.max(F.struct(*by, *rest)).alias("_r"))
    return found.select(*key, *(F.col(f"_r.{c}").alias(c) for c in rows.columns if c not in key)).select(*rows.columns)


def upsert(points: DataFrame, new: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    return latest(points.unionByName(new, allowMissingColumns=True), key, by)


def delete_paths(points: DataFrame, paths: DataFrame, every_namespace: bool = False) -> DataFrame:
    """points without the paths; by namespace and path, or (compatible form) by path alone."""
    return points.join(paths, ["path"] if every_namespace else ["namespace", "path"], "left_anti")


def reindex(points: DataFrame, new: DataFrame) -> DataFrame:
    """New chunks in place of all old ones of their files, so that no chunk of a longer version stays."""
    gone = new.select("namespace", "path").distinct()
    return delete_paths(points, gone).unionByName(new, allowMissingColumns=True)


def relation_coverage(points: DataFrame) -> DataFrame:
    """Share of first chunks that have relations, by namespace; below 0.2, relations are worth extracting anew."""
    first = points.where("chunk = 0").groupBy("namespace")
    ratio = F.avg((F.coalesce("relations", F.lit("")) != "").cast("int"))
    return first.agg(F.round(ratio, 9).alias("coverage"), F.count(F.lit(1)).alias("n")).withColumn("migrate", F.col("coverage") < 0.2)


def migrations(points: DataFrame, mode: str = "auto", sample: int | None = None) -> DataFrame:
    """(namespace, coverage, n, migrate): whether relations are to be extracted anew. ``auto`` goes by coverage, ``skip`` never does, ``force`` always.

    ``sample`` looks at so many first chunks of each namespace only, the first by path, where a quick answer is wanted.
    """
    if mode not in ("auto", "skip", "force"):
        raise ValueError(f"mode must be auto, skip or force, not {mode!r}")
    own = points.where("chunk = 0")
    if sample is not None:
        own = own.withColumn("_i", F.row_number().over(Window.partitionBy("namespace").orderBy("path"))).where(F.col("_i") <= sample)
    found = relation_coverage(own)
    return found if mode == "auto" else found.withColumn("migrate", F.lit(mode == "force"))


def not_seen(rows: DataFrame, seen: DataFrame, key: str = "path") -> DataFrame:
    """Rows whose key an earlier pass has not handled."""
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def queue_head(queue: DataFrame, n: int = 1) -> DataFrame:
    return queue.orderBy("id").limit(n)


def evict(cache: DataFrame, capacity: int, order: str = "inserted_at", key: str = "cache_key") -> DataFrame:
    """The ``capacity`` entries inserted last."""
    return cache.orderBy(F.desc(order), key).limit(capacity)


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys of a result list in the order in which they first occur, with that place."""
    # the list is one search's results, a few rows: one task numbers them
    found = rows.where(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(F.min(order).alias(order))
    return found.withColumn("place", F.row_number().over(Window.orderBy(order, key)))
