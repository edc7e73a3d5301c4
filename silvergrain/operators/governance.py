"""Who may search what; the registry of nodes; statistics of namespaces; caches of answers and query vectors."""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids

ALL = "*"


def allowed_namespaces(users: DataFrame, acl: DataFrame) -> DataFrame:
    """users (user, groups) and acl (grp, namespaces): each user's namespaces, sorted; ``*`` alone if any group has it."""
    member = users.select("user", F.explode_outer("groups").alias("grp"))
    found = member.join(acl.select("grp", F.explode("namespaces").alias("ns")), "grp", "left")
    sets = found.groupBy("user").agg(F.sort_array(F.collect_set("ns")).alias("namespaces"))
    return sets.withColumn("namespaces", F.when(F.array_contains("namespaces", ALL), F.array(F.lit(ALL))).otherwise(F.col("namespaces")))


def may_read(allowed: Column, namespace: Column) -> Column:
    return F.array_contains(allowed, ALL) | F.array_contains(allowed, namespace)


def resolve(wanted: Column, known: Column, allowed: Column, compat: bool = False) -> Column:
    """The namespaces that a request covers. ``*`` and ``__global__`` mean all known ones that are allowed.

    Where that leaves none, nothing is searched; the compatible form searches without a filter instead (one empty name).
    """
    every = F.when(F.array_contains(allowed, ALL), known).otherwise(F.array_intersect(known, allowed))
    every = F.when(F.size(every) == 0, F.array(F.lit(""))).otherwise(every) if compat else every
    one = F.when(may_read(allowed, wanted), F.array(wanted)).otherwise(F.array().cast("array<string>"))
    return F.sort_array(F.when(wanted.isin(ALL, "__global__"), every).otherwise(one))


def latest_nodes(log: DataFrame) -> DataFrame:
    """The registry as its log leaves it: the last row of each id, removed ones dropped."""
    cols = [c for c in log.columns if c != "id"]
    last = log.groupBy("id").agg(F.max(F.struct("registered_at", *(c for c in cols if c != "registered_at"))).alias("r"))
    return last.select("id", *(F.col(f"r.{c}").alias(c) for c in cols)).where("NOT removed")


def namespace_stats(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """Per registered namespace: point count, sorted node ids, last heartbeat."""
    by = nodes.select("id", "last_heartbeat", F.explode("namespaces").alias("namespace")).groupBy("namespace")
    held = by.agg(F.sort_array(F.collect_set("id")).alias("node_ids"), F.max("last_heartbeat").alias("last_heartbeat"))
    counts = points.groupBy("namespace").agg(F.count(F.lit(1)).alias("n_points"))
    return held.join(counts, "namespace", "left").withColumn("n_points", F.coalesce("n_points", F.lit(0).cast("long")))


def topology(nodes: DataFrame) -> DataFrame:
    by = nodes.select("id", F.explode("namespaces").alias("namespace")).groupBy("namespace")
    return by.agg(F.sort_array(F.collect_set("id")).alias("node_ids"), F.count_distinct("id").alias("n_nodes"))


def scrape_targets(nodes: DataFrame, host: str | None = None) -> DataFrame:
    """A monitoring target for each node whose address parses: host:port (host replaced, if given) and its first namespace."""
    name, port = F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1), F.regexp_extract("url", r"^[a-z]+://[^/:]+:([0-9]+)", 1)
    shown = F.lit(host) if host else name
    target = F.when(port == "", shown).otherwise(F.concat_ws(":", shown, port))
    return nodes.where(name != "").select("id", target.alias("target"), F.coalesce(F.get("namespaces", F.lit(0)), F.lit("unknown")).alias("namespace"))


def alive(beats: DataFrame, now: Column, within: str = "5 minutes") -> DataFrame:
    last = beats.groupBy("node_id").agg(F.max("ts").alias("last_beat"))
    return last.withColumn("alive", F.col("last_beat") + F.expr(f"INTERVAL {within}") >= now)


def cached_answers(requests: DataFrame, cache: DataFrame, generations: DataFrame, now: Column, own: tuple[str, ...] = ()) -> DataFrame:
    """requests (request_id, namespace, model, query) with their cached answers, null where none is valid.

    A namespace's generation is part of the key: an answer from before the last indexing is not found any more. Of several valid
    answers to a key the one that lasts longest counts, so a request stays one row. Answers are shared by all who ask the same, unless ``own`` names
    columns of requests and cache that must agree too.
    """
    asked = requests.join(generations, "namespace", "left").withColumn("generation", F.coalesce("generation", F.lit(0).cast("long")))
    asked = asked.withColumn("cache_key", ids.answer_key(F.col("namespace"), F.col("generation"), F.col("model"), F.col("query")))
    key = ["cache_key", *own]
    valid = cache.where(F.col("expires_at") >= now).groupBy(*key).agg(F.max(F.struct("expires_at", "answer"))["answer"].alias("answer"))
    return asked.join(valid, key, "left")


def stored_answers(cache: DataFrame, answered: DataFrame, now: Column, ttl: float, capacity: int) -> DataFrame:
    """The cache (cache_key, answer, expires_at, used_at) after a round of requests.

    answered: cache_key, answer, hit. New answers come in for ``ttl`` seconds, hits count as used now; what has expired goes, and beyond
    ``capacity`` what was used longest ago. Empty answers are not stored. Times are seconds.
    """
    now = now.cast("double")
    touched = answered.where("hit").select("cache_key", now.alias("_now")).distinct()
    old = cache.join(touched, "cache_key", "left").select("cache_key", "answer", F.col("expires_at").cast("double").alias("expires_at"), F.coalesce("_now", F.col("used_at").cast("double")).alias("used_at"))
    new = answered.where("NOT hit AND coalesce(answer, '') <> ''").groupBy("cache_key").agg(F.max("answer").alias("answer")).select("cache_key", "answer", (now + ttl).alias("expires_at"), now.alias("used_at"))
    both = old.join(new, "cache_key", "left_anti").unionByName(new).where(F.col("expires_at") >= now)
    return both.orderBy(F.desc("used_at"), "cache_key").limit(capacity)


def with_vectors(texts: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame], now: Column, ttl: float, capacity: int) -> tuple[DataFrame, DataFrame]:
    """texts (text) with ``vector`` and ``hit``, and the cache (embed_key, vector, expires_at, inserted_at) filled with what it lacked.

    Each distinct text that no valid entry holds is embedded once (``embed`` adds ``vector`` to a table with ``text``); texts whose
    vector stays null are not stored. Beyond ``capacity`` the entries inserted first go; one that is made anew keeps its place.
    """
    now = now.cast("double")
    keyed = texts.withColumn("embed_key", ids.embedding_key(F.col("text")))
    valid = cache.where(F.col("expires_at").cast("double") >= now)
    lacking = keyed.select("text", "embed_key").distinct().join(valid.select("embed_key"), "embed_key", "left_anti")
    made = embed(lacking).where(F.col("vector").isNotNull()).select("embed_key", "vector")
    known = valid.select("embed_key", "vector", F.lit(True).alias("hit")).unionByName(made.withColumn("hit", F.lit(False)))
    placed = made.join(cache.select("embed_key", F.col("inserted_at").cast("double").alias("_at")), "embed_key", "left")
    fresh = placed.select("embed_key", "vector", (now + ttl).alias("expires_at"), F.coalesce("_at", now).alias("inserted_at"))
    old = cache.select("embed_key", "vector", F.col("expires_at").cast("double").alias("expires_at"), F.col("inserted_at").cast("double").alias("inserted_at")).join(fresh, "embed_key", "left_anti")
    filled = old.unionByName(fresh).orderBy(F.desc("inserted_at"), "embed_key").limit(capacity)
    return keyed.join(known, "embed_key", "left").drop("embed_key"), filled


class AnswerCache:
    """Answers by key on the driver: at most ``capacity`` for ``ttl`` seconds each, the one used longest ago goes first; generations by namespace."""

    def __init__(self, capacity: int = 1000, ttl: float = 3600.0, clock: Callable[[], float] = time.time):
        self.capacity, self.ttl, self.clock = capacity, ttl, clock
        self.kept: OrderedDict[str, tuple[float, str]] = OrderedDict()
        self.generation: dict[str, int] = {}

    def key(self, namespace: str, model: str, query: str) -> str:
        """Keys as ``ids.answer_key`` makes them."""
        return hashlib.sha256("|".join((namespace, str(self.generation.get(namespace, 0)), model, query.strip(" ").lower())).encode()).hexdigest()

    def get(self, key: str) -> str | None:
        until, answer = self.kept.get(key, (0.0, None))
        if answer is None or self.clock() > until:
            self.kept.pop(key, None)
            return None
        self.kept.move_to_end(key)
        return answer

    def put(self, key: str, answer: str) -> None:
        if answer:
            self.kept[key] = self.clock() + self.ttl, answer
            self.kept.move_to_end(key)
            while len(self.kept) > self.capacity:
                self.kept.popitem(last=False)

    def indexed(self, namespace: str) -> None:
        """A namespace was indexed anew: answers from before are not found any more."""
        self.generation[namespace] = self.generation.get(namespace, 0) + 1


def missing_vectors(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts (text, embed_key) that the cache of query vectors lacks: what is still to be embedded."""
    keyed = texts.select("text").distinct().withColumn("embed_key", ids.embedding_key(F.col("text")))
    return keyed.join(cache.select("embed_key"), "embed_key", "left_anti")


def generations(events: DataFrame, final_only: bool = True) -> DataFrame:
    """How often each namespace was indexed anew; progress events count only in the compatible form."""
    own = events.where("status <> 'in_progress'") if final_only else events
    return own.groupBy("namespace").agg(F.count(F.lit(1)).alias("generation"))
