"""The engine as one object: index, search, walk the graph, answer, evaluate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators import delta, evals, governance, graph, index, rag
from .operators import search as S
from .operators.store import Store
from .sources import files


class Engine:
    """Points, edges and models behind one interface. Models are plain callables and may be doubles."""

    def __init__(self, spark: SparkSession, points: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None, model: Callable[[str], str] | None = None, reranker: Callable[[str, list[str]], list[float]] | None = None, assess: Callable[[str, list], dict] | None = None, cache: governance.AnswerCache | None = None, settings: Settings | None = None, store: Store | None = None):
        self.spark, self.points, self.store = spark, points, store
        self.embed, self.model, self.reranker, self.assess = embed or index.hash_embedder(), model, reranker, assess
        self.cache, self.settings = cache, settings or Settings()

    @classmethod
    def over_files(cls, spark: SparkSession, root: str, namespace: str = "default", embed: Callable | None = None, **walk) -> Engine:
        """An engine over the plain files below a folder or URI."""
        own = embed or index.hash_embedder()
        texts = files.extract(files.expand_archives(files.walk(spark, root, **walk)), []).where("text IS NOT NULL").withColumn("namespace", F.lit(namespace))
        return cls(spark, index.points(texts, own), own)

    @classmethod
    def over_store(cls, store: Store, **models) -> Engine:
        """An engine over a store: text match goes by its index, and ``refresh`` changes it in place."""
        points = store.points() if store.exists() else store.spark.createDataFrame([], store.schema)
        return cls(store.spark, points, store=store, **models)

    def vector(self, query: str) -> list[float]:
        return self.embed([query])[0]

    @staticmethod
    def _scope(namespace: str | None, allowed: list[str] | None) -> tuple[bool, bool]:
        """Whether all namespaces are asked for, and whether nothing is forbidden; a named one that is not allowed is an error."""
        everywhere, free = namespace in (None, "*", "__global__"), allowed is None or governance.ALL in allowed
        if not everywhere and not free and namespace not in allowed:
            raise PermissionError(namespace)
        return everywhere, free

    def search(self, query: str, namespace: str | None = None, mode: str = "hybrid", k: int = 10, allowed: list[str] | None = None, rerank: bool = False) -> DataFrame:
        """By mode; over all (allowed) namespaces if none is named. ``allowed`` None means no restriction.

        With ``rerank`` twice as many results are found and the engine's model of relevance orders them (rank, rerank_score, new_rank).
        """
        everywhere, free = self._scope(namespace, allowed)
        depth = 2 * k if rerank and self.reranker else k
        if everywhere:
            found = S.fan_out(self.points, None if mode == "keyword" else self.vector(query), None if mode == "semantic" else query, depth, None if free else allowed)
        elif self.store and mode == "keyword":
            found = self.store.keyword_search(query, depth, namespace)
        elif self.store and mode == "hybrid":
            found = self.store.hybrid_search(self.vector(query), query, depth, namespace)
        else:
            found = S.search(self.points, mode, query=self.vector(query), words=query, k=depth, namespace=namespace)
        return S.reranked(self.with_text(found), query, self.reranker, k, self.settings.rerank_threshold) if rerank and self.reranker else found

    def search_apart(self, query: str, sources: dict[str, Callable[[], DataFrame]], k: int = 10, seconds: float = 30.0) -> tuple[DataFrame, list[str], list[str]]:
        """Over namespaces kept in tables of their own, some of which may fail: results, who answered, who failed."""
        vector = self.vector(query)
        return S.each_namespace(self.spark, sources, lambda own: S.hybrid_search(own, vector, query, k), k, seconds)

    def with_text(self, found: DataFrame) -> DataFrame:
        return found.select(*S.KEY, "score").join(self.points.select(*S.KEY, "text"), list(S.KEY))

    def readable(self, namespace: str | None, allowed: list[str] | None) -> DataFrame:
        """The points of a namespace, or of all that may be read."""
        everywhere, free = self._scope(namespace, allowed)
        if not everywhere:
            return S.in_namespace(self.points, namespace)
        return self.points if free else self.points.where(F.col("namespace").isin(*allowed)) if allowed else self.points.limit(0)

    def file(self, path: str, namespace: str | None = None, allowed: list[str] | None = None) -> DataFrame:
        """The chunks of a file, in order."""
        return index.file_text(self.readable(namespace, allowed), path)

    def file_relations(self, path: str, namespace: str | None = None, allowed: list[str] | None = None) -> DataFrame:
        """What a file leads to and what it defines."""
        return graph.file_relations(self.readable(namespace, allowed), path)

    def edges(self, namespace: str | None = None, allowed: list[str] | None = None) -> DataFrame:
        return graph.edges(self.readable(namespace, allowed))

    def neighbours(self, path: str, depth: int = 1, namespace: str | None = None, allowed: list[str] | None = None) -> DataFrame:
        """(namespace, source, path, depth): where a file leads, in each namespace that has it and may be read."""
        own = self.readable(namespace, allowed)
        return graph.neighbours(graph.edges(own), own.where(F.col("path") == path).select("namespace", "path"), depth)

    def search_graph(self, query: str, namespace: str | None = None, k: int = 10, depth: int = 1, allowed: list[str] | None = None) -> DataFrame:
        own = self.readable(namespace, allowed)
        first = S.hybrid_search(own, self.vector(query), query, k)
        return graph.expand(own, graph.edges(own), S.ranked(first, k, [F.desc("score"), *map(F.col, S.KEY)]), self.vector(query), query, k, depth)

    def answer(self, question: str, namespace: str | None = None, k: int = 5, allowed: list[str] | None = None, expand: bool = False) -> str:
        """From the cache, or: search, neighbours of the files found (``expand``), rounds of follow-up queries (with ``assess``), reranking, model.

        Neighbours and rounds are for one namespace, as a request over all goes to each once. Answers of a working model are stored.
        """
        across, _ = self._scope(namespace, allowed)
        key = self.cache.key(namespace or "*", getattr(self.model, "__name__", "model"), question) if self.cache else ""
        if self.cache and (known := self.cache.get(key)) is not None:
            return known
        look = lambda q: self.search_graph(q, namespace, k, self.settings.graph_depth, allowed) if expand and not across else self.search(q, namespace, k=k, allowed=allowed)
        found = self.with_text(look(question))
        if self.assess and not across:
            rows = lambda q: self.with_text(look(q)).withColumn("point_id", F.concat_ws("\x00", *(F.col(c).cast("string") for c in S.KEY)))
            best, _ = rag.agentic_search(self.spark, question, rows(question), rows, self.assess, self.settings.hops, self.settings.confident)
            part = F.split("point_id", "\x00")
            found = best.select(part[0].alias("namespace"), part[1].alias("path"), part[2].cast("long").alias("chunk"), "score", "text")
        if self.reranker:
            order = S.reranked(found, question, self.reranker, k, self.settings.rerank_threshold)
            found = order.select(*S.KEY, (-F.col("new_rank")).cast("double").alias("score")).join(found.drop("score"), list(S.KEY))
        said, made = rag.answered(question, found.orderBy(F.desc("score"), *S.KEY), self.model or (lambda prompt: prompt), across)
        if self.cache and made:
            self.cache.put(key, said)
        return said

    def evaluate(self, suite: DataFrame, judge_recall: Callable, judge_faith: Callable, namespace: str | None = None, k: int = 10) -> DataFrame:
        """A suite of questions: contexts for all by one batch search a namespace, then models in Arrow batches on executors."""
        model = self.model
        return evals.run_suite(evals.contexts(self.spark, self.points, suite, self.embed, namespace, k), judge_recall, lambda q, c: (model or (lambda p: p))(rag.answer_prompt(q, c)), judge_faith)

    def namespace_stats(self, nodes: DataFrame) -> DataFrame:
        return governance.namespace_stats(nodes, self.points)

    def refresh(self, listing: DataFrame, state: DataFrame, texts: Callable[[DataFrame], DataFrame], number: int | None = None) -> DataFrame:
        """The points after a poll: changed files anew, removed ones gone; returns the actions.

        An engine over a store changes it in place and needs the ``number`` of the poll; else the whole table is planned anew.
        """
        actions = delta.classify(listing, state)
        gone = actions.where("action = 'DELETE'").select("path")
        own = texts(actions.where("action = 'INDEX'").select("path"))
        if self.store:
            if number is None:
                raise ValueError("a change of a store needs its number")
            # a listing knows paths only: a file that is gone is gone from every namespace that held it
            held = self.points.select("namespace", "path").distinct().join(gone, "path", "left_semi")
            self.store.change(number, index.points(own, self.embed), held, own.select("namespace", "path"))
            self.points = self.store.points()
        else:
            self.points = delta.reindex(delta.delete_paths(self.points, gone, every_namespace=True), index.points(own, self.embed))
        if self.cache:
            for r in self.points.select("namespace").distinct().toLocalIterator():  # a row a namespace
                self.cache.indexed(r["namespace"])
            self.cache.indexed("*")
        return actions
