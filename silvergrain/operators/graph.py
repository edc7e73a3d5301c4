"""The graph of files: edges from relations, neighbours within a few steps, expansion of search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import relations as R
from . import search as S

#: Steps that a walk may take.
MAX_DEPTH = 3


def edges(points: DataFrame) -> DataFrame:
    """(namespace, src, dst) from the relations (JSON) of first chunks; malformed ones give none, repeated ones stay."""
    first = points.where((F.col("chunk") == 0) & (F.coalesce("relations", F.lit("")) != "")) if "chunk" in points.columns else points
    found = first.select("namespace", F.col("path").alias("src"), F.explode(R.from_json(F.col("relations"))).alias("r"))
    return found.where(F.col("r.type").isin("imports", "links_to") & (F.coalesce("r.target", F.lit("")) != "")).select("namespace", "src", F.col("r.target").alias("dst"))


def write_edges(links: DataFrame, path: str) -> None:
    """The edges as a table, a folder a namespace, each edge once and ordered by source: a walk reads what its frontier can hold."""
    links.select("namespace", "src", "dst").distinct().repartition("namespace", "src").sortWithinPartitions("namespace", "src").write.partitionBy("namespace").mode("overwrite").parquet(path)


def neighbours(links: DataFrame, sources: DataFrame, depth: int = 1) -> DataFrame:
    """(source, path, depth): what each source reaches in at most ``depth`` steps (1 to 3), itself left out, at its shortest distance.

    A step joins the frontier to the edges and keeps what no earlier step reached; cycles end there. Where sources have a
    namespace, so have the results, and a walk takes edges of its own namespace only; sources without one walk over the edges of all.
    """
    own = ["namespace"] if "namespace" in sources.columns else []
    steps = links.select(*own, "src", "dst").distinct()
    start = sources.select(*own, F.col("path").alias("source")).distinct()
    frontier = start.select(*own, "source", F.col("source").alias("src"))
    key = [*own, "source", "path"]
    seen = frontier.withColumnRenamed("src", "path").withColumn("depth", F.lit(0))
    for d in range(1, min(max(depth, 1), MAX_DEPTH) + 1):
        reached = frontier.join(steps, [*own, "src"]).select(*own, "source", F.col("dst").alias("path")).distinct()
        new = reached.join(seen.select(*key), key, "left_anti")
        seen = seen.unionByName(new.withColumn("depth", F.lit(d)))
        frontier = new.withColumnRenamed("path", "src")
    return seen.where("depth > 0").select(*key, "depth")


def nodes_and_edges(links: DataFrame, sources: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """The sources and what they reach; and (source, target) pairs, each once; by namespace where sources have one."""
    own = ["namespace"] if "namespace" in sources.columns else []
    found = neighbours(links, sources, depth)
    nodes = sources.select(*own, "path").union(found.select(*own, "path")).distinct()
    return nodes, found.select(*own, "source", F.col("path").alias("target")).distinct()


def file_relations(points: DataFrame, path: str, namespace: str | None = None) -> DataFrame:
    """What a file imports, links to and defines: namespace, kind (``leads_to`` or ``defines``), value, in the order of the file (place)."""
    first = S.in_namespace(points, namespace).where((F.col("path") == path) & (F.col("chunk") == 0))
    each = first.select("namespace", F.posexplode(R.from_json(F.col("relations"))).alias("place", "r"))
    leads = F.col("r.type").isin("imports", "links_to")
    value = F.when(leads, F.col("r.target")).when(F.col("r.type") == "defines", F.col("r.name"))
    return each.select("namespace", F.when(leads, "leads_to").otherwise("defines").alias("kind"), value.alias("value"), "place").where(F.coalesce("value", F.lit("")) != "")


def expand(points: DataFrame, links: DataFrame, direct: DataFrame, query: list[float], words: str, k: int = 10, depth: int = 1, weight: float = 0.7, bound: bool = True) -> DataFrame:
    """Direct results (key, rank) merged with a search among their files' neighbours, which weigh less.

    ``bound``: a file's neighbours are those of its namespace, and so are the points searched; else paths count whatever their namespace.
    The direct results are a list of at most k rows: they are worked out once and go on as such.
    """
    own = ["namespace"] if bound else []
    direct = direct.sparkSession.createDataFrame(direct.select(*S.KEY, "rank").limit(k).collect(), direct.select(*S.KEY, "rank").schema)
    sources = F.broadcast(direct.select(*own, "path").distinct())
    near = neighbours(links, sources, depth).select(*own, "path").distinct().join(sources, [*own, "path"], "left_anti")
    second = S.hybrid_search(points, query, words, k, paths=near)
    return S.weighted_merge(direct, S.ranked(second, k, [F.desc("score"), *map(F.col, S.KEY)]), k, weight)
