"""The jobs over whole tables: each runs twice into a folder of its own, and its output is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from jobs import index_documents, usage_report

from ..operators import postings
from ..workspace import work_dir
from .catalog import query


@query(r"""WITH t AS (SELECT lang AS namespace, source || '/' || doc_id || '.md' AS path, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM t WHERE strlen(text) >= 10),
c AS (SELECT *, unnest(range(0, CASE WHEN len(w) <= 512 THEN 1 ELSE 1 + CAST(ceil((len(w) - 512) / 462.0) AS BIGINT) END)) AS chunk FROM w),
b AS (SELECT namespace, path, chunk, array_to_string(w[chunk * 462 + 1 : chunk * 462 + 512], ' ') AS body FROM c),
k AS (SELECT *, list_filter(regexp_split_to_array(lower(body), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS tokens FROM b)
SELECT namespace, path, chunk, md5(body) AS digest, CAST(len(tokens) AS BIGINT) AS n_tokens, CAST(len(list_distinct(tokens)) AS BIGINT) AS n_posted, md5(array_to_string(list_sort(list_distinct(tokens)), ' ')) AS posted FROM k WHERE body <> ''""")
def job1_index_documents(spark, sf_dir):
    """All documents through the incremental job: chunks, and for each the tokens under which the postings hold it."""
    root = f"{work_dir(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):  # the second run finds nothing new
        index_documents.run(spark, f"{sf_dir}/documents.parquet", f"{root}/out", f"{root}/progress")
    held = index_documents.current(spark, f"{root}/out").select("namespace", "path", "chunk", F.md5("text").alias("digest"), F.size("tokens").cast("long").alias("n_tokens"), "batch")
    turned = postings.posted(spark, f"{root}/out/index")
    # a chunk's tokens, 512 words at most
    posted = turned.select("batch", "namespace", "path", "chunk", F.size("tokens").cast("long").alias("n_posted"), F.md5(F.array_join("tokens", " ")).alias("posted"))
    return held.join(posted, ["batch", "namespace", "path", "chunk"], "left").drop("batch").withColumn("n_posted", F.coalesce("n_posted", F.lit(0).cast("long"))).withColumn("posted", F.coalesce("posted", F.md5(F.lit(""))))


#: A rule for hours that few types keep up.
SLOW = [{"name": "slow", "quantile": "p95", "above": 40.0, "windows": 2}]


@query("""WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, value, CAST(floor(value / 0.01::DOUBLE) AS BIGINT) AS bin FROM events WHERE ts IS NOT NULL),
g AS (SELECT *, count(value) OVER (PARTITION BY window_start, event_type ORDER BY bin NULLS FIRST) AS reached, count(value) OVER (PARTITION BY window_start, event_type) AS valued FROM e),
w AS (SELECT window_start, event_type, count(*)::DOUBLE AS n, round(avg(value), 6) AS mean, """ + ", ".join(f"min(round((bin + 1) * 0.01::DOUBLE, 6)) FILTER (WHERE reached * 100 >= valued * {q}) AS p{q}" for q in (50, 95, 99)) + """ FROM g GROUP BY ALL),
l AS (UNPIVOT w ON n, mean, p50, p95, p99 INTO NAME metric VALUE value),
h AS (SELECT *, epoch(window_start) / 3600 - row_number() OVER (PARTITION BY event_type ORDER BY window_start) AS i FROM l WHERE metric = 'p95' AND value > 40),
a AS (SELECT *, row_number() OVER (PARTITION BY event_type, i ORDER BY window_start) AS held FROM h)
SELECT CAST(window_start AS DATE) AS day, metric, window_start, event_type, value FROM l
UNION ALL SELECT CAST(window_start AS DATE), 'alert:slow', window_start, event_type, value FROM a WHERE held >= 2""")
def job2_usage_report(spark, sf_dir):
    """The report of all days, run twice over the same output."""
    root = f"{work_dir(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        usage_report.run(spark, f"{sf_dir}/events.parquet", f"{root}/out", rules=SLOW)
    return usage_report.read(spark, f"{root}/out")
