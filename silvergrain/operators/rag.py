"""From results to answers: context, bounded loops of retrieval, answers from an injected model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows kept by a merge, rows taken of a follow-up query, rounds at most.
KEPT, FOLLOW, ROUNDS = 20, 5, 5
ASSESSMENT = "confidence double, answer_ready boolean, follow_up_queries array<string>, reasoning string"


def block(source: Column, text: Column) -> Column:
    return F.concat(F.lit("[Source: "), source, F.lit("]\n"), text)


def build_context(results: DataFrame, by: list[str], tagged: bool = True) -> DataFrame:
    """One context a group: texts in order of rank, empty ones left out, each behind its source."""
    own = results.where(F.coalesce("text", F.lit("")) != "")
    shown = block(F.concat_ws("/", "namespace", "path"), F.col("text")) if tagged else F.col("text")
    parts = own.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", shown.alias("t")))).alias("_p"))
    return parts.select(*by, F.array_join(F.transform("_p", lambda p: p["t"]), "\n---\n").alias("context"))


def merge(known: DataFrame, found: DataFrame, keep: int = KEPT) -> DataFrame:
    """Results of two rounds: of one point its best score; the best ``keep``."""
    both = known.select("point_id", "score").unionByName(found.select("point_id", "score"))
    return both.groupBy("point_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "point_id").limit(keep)


def parse_json(text: Column, schema: str) -> Column:
    """A model's JSON answer, with or without a code fence around it; null if malformed."""
    bare = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    return F.from_json(bare, schema)


def last_user_message(turns: DataFrame) -> DataFrame:
    """The last message of the user in each conversation."""
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def assessment_prompt(question: str, context: str) -> str:
    return f"Is the context below enough to answer the question? Reply in JSON with the fields {ASSESSMENT}.\n\nQuestion: {question}\n\nContext:\n{context}"


def answer_prompt(question: str, context: str, across: bool = False) -> str:
    cite = " Name the namespace and the path of each source that you use." if across else ""
    return f"Answer the question from the context below.{cite}\n\nContext:\n{context}\n\nQuestion: {question}"


def agentic_search(spark: SparkSession, question: str, first: DataFrame, search: Callable[[str], DataFrame], assess: Callable[[str, list], dict], rounds: int = 3, confident: float = 0.8) -> tuple[DataFrame, int]:
    """Search until the model has enough: results (point_id, score, text) and the number of rounds.

    A loop of at most five rounds on the driver over result lists of at most KEPT rows. A model that fails ends it with what there is.
    """
    rows = {r["point_id"]: r.asDict() for r in first.orderBy(F.desc("score"), "point_id").limit(KEPT).collect()}
    done = 0
    for _ in range(min(max(rounds, 1), ROUNDS)):
        done += 1
        try:
            said = assess(question, list(rows.values()))
        except Exception:  # noqa: BLE001 - an injected model may fail in any way
            break
        if said.get("answer_ready") or said.get("confidence", 0) >= confident or done >= rounds:
            break
        for query in said.get("follow_up_queries", []):
            for r in search(query).limit(FOLLOW).collect():
                old = rows.get(r["point_id"])
                if old is None or r["score"] > old["score"]:
                    rows[r["point_id"]] = r.asDict()
        best = sorted(rows.values(), key=lambda r: (-r["score"], r["point_id"]))[:KEPT]
        rows = {r["point_id"]: r for r in best}
    return spark.createDataFrame([(r["point_id"], float(r["score"]), r.get("text")) for r in rows.values()], "point_id string, score double, text string"), done


def answer(question: str, results: DataFrame, model: Callable[[str], str], across: bool = False) -> str:
    """The model's answer over the results' context; if it fails, the first result's text and source."""
    return answered(question, results, model, across)[0]


def answered(question: str, results: DataFrame, model: Callable[[str], str], across: bool = False) -> tuple[str, bool]:
    """``answer``, and whether the model made it."""
    rows = results.collect()  # a result list
    shown = "\n---\n".join(f"[Source: {r['namespace']}/{r['path']}]\n{r['text']}" for r in rows if r["text"])
    try:
        return model(answer_prompt(question, shown, across)), True
    except Exception:  # noqa: BLE001
        return (f"{rows[0]['text']}\n\n[Source: {rows[0]['namespace']}/{rows[0]['path']}]" if rows else "No results."), False


def rank_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    joined = before.select(key, F.col("rank").alias("rank_before")).join(after.select(key, F.col("rank").alias("rank_after")), key)
    return joined.withColumn("changed", F.col("rank_before") != F.col("rank_after"))


def runs_of_failures(events: DataFrame, by: str, ts: str, ok: str) -> DataFrame:
    """For each event the failures in a row up to it: islands between successes."""
    order = Window.partitionBy(by).orderBy(ts, "event_id")
    island = events.withColumn("_i", F.sum(F.col(ok).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(by, "_i").orderBy(ts, "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("failures", F.sum((~F.col(ok)).cast("int")).over(inside)).drop("_i")
