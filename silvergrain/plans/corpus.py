"""Text functions, chunks, relations, identifiers and evaluation over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import relations as R
from ..functions import text as T
from ..operators import evals, index, rag
from .catalog import query, table


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


WORDS = r"w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)"


@query(f"""WITH {WORDS}, c AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 512 THEN 1 ELSE 1 + CAST(ceil((len(w) - 512) / 462.0) AS BIGINT) END)) AS i FROM w)
SELECT doc_id, CAST(i AS INT) AS chunk, md5(array_to_string(w[i * 462 + 1 : i * 462 + 512], ' ')) AS digest FROM c""")
def smart_chunk(spark, sf_dir):
    cut = documents(spark, sf_dir).select("doc_id", F.posexplode(T.smart_chunk(T.fields(F.col("text")), 512, 50)).alias("chunk", "text"))
    return cut.select("doc_id", "chunk", F.md5("text").alias("digest"))


@query(f"WITH {WORDS} SELECT doc_id, CAST(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 30 THEN 1 ELSE 1 + ceil((len(w) - 30) / 25.0) END AS INT) AS n_chunks FROM w")
def chunk_counts_closed_form(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.chunk_count(T.word_count(F.col("text")), 30, 5).alias("n_chunks"))


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split(replace(replace(replace(replace(text, '. ', '. ' || chr(1)), '? ', '? ' || chr(1)), '! ', '! ' || chr(1)), chr(10) || chr(10), chr(10) || chr(10) || chr(1)), chr(1))) AS s FROM documents),
t AS (SELECT doc_id, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s FROM s)
SELECT doc_id, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars FROM t WHERE strlen(s) >= 10 GROUP BY doc_id""")
def sentence_split(spark, sf_dir):
    each = documents(spark, sf_dir).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("s")).alias("chars"))


@query(f"WITH {WORDS} SELECT doc_id, CAST(len(w) AS INT) AS n_words FROM w")
def word_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query("SELECT doc_id, md5(CASE WHEN source = 'src0' THEN text ELSE '[Context: ' || source || ']' || chr(10) || text END) AS digest FROM documents")
def context_enrich(spark, sf_dir):
    context = F.when(F.col("source") == "src0", "").otherwise(F.col("source"))
    return documents(spark, sf_dir).select("doc_id", F.md5(T.enrich(context, F.col("text"))).alias("digest"))


@query("SELECT conv_id, turn, md5(lower(trim(text))) AS digest FROM conversations WHERE role = 'user'")
def query_normalise(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.md5(T.normalised_query(F.col("text"))).alias("digest"))


@query("SELECT doc_id, strlen(trim(text)) AS n_bytes FROM documents WHERE strlen(trim(text)) >= 10")
def min_text_filter(spark, sf_dir):
    size = F.octet_length(F.trim("text"))
    return documents(spark, sf_dir).where(size >= T.MIN_TEXT).select("doc_id", size.cast("long").alias("n_bytes"))


@query(r"""SELECT page_id, length(regexp_replace(html, '[\x00-\x1f\x7f]', '', 'g')) AS n, md5(CASE WHEN length(html) > 100 THEN left(html, 100) || '...' ELSE html END) AS digest FROM pages""")
def control_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(T.strip_control(F.col("html"))).cast("long").alias("n"), F.md5(T.truncate_chars(F.col("html"), 100)).alias("digest"))


@query(r"SELECT conv_id, turn, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), lambda x: x || ' ') AS pieces FROM conversations WHERE role = 'assistant'")
def streamed_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", T.streamed_words(F.col("text")).alias("pieces"))


@query("""WITH RECURSIVE s AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
f AS (SELECT label, vec_id, i, 0 AS grp, v AS total, 1 AS n FROM s WHERE i = 1
 UNION ALL SELECT s.label, s.vec_id, s.i,
  CASE WHEN list_cosine_similarity(f.total, s.v) < 0.5 THEN f.grp + 1 ELSE f.grp END,
  CASE WHEN list_cosine_similarity(f.total, s.v) < 0.5 THEN s.v ELSE list_transform(range(1, 65), lambda k: f.total[k] + s.v[k]) END,
  CASE WHEN list_cosine_similarity(f.total, s.v) < 0.5 THEN 1 ELSE f.n + 1 END
 FROM f JOIN s ON s.label = f.label AND s.i = f.i + 1)
SELECT label, vec_id, CAST(grp AS INT) AS grp FROM f""")
def semantic_chunk_groups(spark, sf_dir):
    return index.semantic_groups(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding")


# relations: sources of programs made from each document's id
def sources(spark, sf_dir, text):
    i = F.col("doc_id").cast("string")
    return documents(spark, sf_dir).select("doc_id", text(i).alias("text"))


def listed(df, found) -> DataFrame:
    return df.select("doc_id", F.explode(found).alias("r")).select("doc_id", "r.type", F.coalesce("r.target", F.lit("")).alias("target"), F.coalesce("r.name", F.lit("")).alias("name"))


@query("""SELECT doc_id, unnest(['imports', 'imports', 'defines', 'defines']) AS type, unnest(['os.m' || doc_id, 'pkg' || doc_id, '', '']) AS target, unnest(['', '', 'run_' || doc_id, 'Thing' || doc_id]) AS name FROM documents""")
def relations_python(spark, sf_dir):
    text = lambda i: F.concat(F.lit("import os.m"), i, F.lit("\nfrom pkg"), i, F.lit(" import x\nx = 1\n    async def run_"), i, F.lit("(a):\n        pass\nclass Thing"), i, F.lit(":\n    pass\n"))
    return listed(sources(spark, sf_dir, text), R.python_relations(F.col("text")))


@query("""SELECT doc_id, unnest(['imports', 'imports', 'defines', 'defines']) AS type, unnest(['./m' || doc_id, 'lib', '', '']) AS target, unnest(['', '', 'go' || doc_id, 'Box']) AS name FROM documents""")
def relations_js(spark, sf_dir):
    text = lambda i: F.concat(F.lit("import {a} from './m"), i, F.lit("'\nconst b = require('lib')\nexport function go"), i, F.lit("() {}\nexport default class Box {}\n"))
    return listed(sources(spark, sf_dir, text), R.js_relations(F.col("text")))


@query("SELECT doc_id, 'imports' AS type, unnest(['stdio.h', 'h' || doc_id || '.h']) AS target, '' AS name FROM documents")
def relations_c(spark, sf_dir):
    text = lambda i: F.concat(F.lit("#include <stdio.h>\n  #  include \"h"), i, F.lit(".h\"\nint main(void) { return 0; }\n"))
    return listed(sources(spark, sf_dir, text), R.c_relations(F.col("text")))


@query("SELECT doc_id, 'links_to' AS type, unnest(['a/' || doc_id || '.md', 'b.md']) AS target, '' AS name FROM documents")
def relations_markdown(spark, sf_dir):
    text = lambda i: F.concat(F.lit("see [x](a/"), i, F.lit(".md) and [y](https://e.org) or [z](b.md), not [w](c.md#top)"))
    return listed(sources(spark, sf_dir, text), R.link_relations(F.col("text")))


@query("""SELECT doc_id, unnest(['imports', 'imports', 'imports', 'defines', 'defines']) AS type, unnest(['fmt', 'g/' || doc_id, 'os', '', '']) AS target, unnest(['', '', '', 'Run', 'Box']) AS name FROM documents""")
def relations_go(spark, sf_dir):
    text = lambda i: F.concat(F.lit('package p\nimport "fmt"\nimport (\n\tx "g/'), i, F.lit('"\n\t"os"\n)\nfunc (b *Box) Run(a int) {}\nfunc hidden() {}\ntype Box struct {}\n'))
    return listed(sources(spark, sf_dir, text), R.go_relations(F.col("text")))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '[{"type":"links_to","target":"p' || doc_id || '"}]' ELSE '' END AS relations FROM documents""")
def relations_json(spark, sf_dir):
    even = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("[x](p"), F.col("doc_id").cast("string"), F.lit(")"))).otherwise("none")
    return documents(spark, sf_dir).select("doc_id", R.to_json(R.link_relations(even)).alias("relations"))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"#? ]+)"', 1)) AS target FROM pages) SELECT page_id, target, count(*) AS n FROM l WHERE NOT regexp_matches(target, '^https?://') GROUP BY ALL""")
def page_links(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"#? ]+)"'), F.lit(1))).alias("target"))
    return found.where(~F.col("target").rlike("^https?://")).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('src/' || source || '/' || doc_id || '.md:0')) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def point_ids_uuid5(spark, sf_dir):
    path = F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return documents(spark, sf_dir).select("doc_id", ids.point_id(path, F.lit(0)).alias("point_id"))


@query("SELECT conv_id, turn, sha256('default|' || (conv_id % 3) || '|m1|' || lower(trim(text))) AS cache_key FROM conversations WHERE role = 'user'")
def cache_keys(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", ids.answer_key(F.lit("default"), F.col("conv_id") % 3, F.lit("m1"), F.col("text")).alias("cache_key"))


@query("SELECT conv_id, turn, left(sha256(text), 32) AS embed_key FROM conversations WHERE role = 'user'")
def embed_cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", ids.embedding_key(F.col("text")).alias("embed_key"))


@query("SELECT md5(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1")
def content_hash_dedup(spark, sf_dir):
    return documents(spark, sf_dir).groupBy(F.md5("text").alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def first_bytes_sql(most: int) -> str:
    """The longest start of text of at most so many bytes, in hexadecimal digits h of the whole: the cut moves back over bytes 10xxxxxx."""
    goes_on = lambda i: f"substr(h, {2 * i + 1}, 1) IN ('8', '9', 'A', 'B')"
    back = f"CASE WHEN NOT {goes_on(most)} THEN 0 WHEN NOT {goes_on(most - 1)} THEN 1 WHEN NOT {goes_on(most - 2)} THEN 2 ELSE 3 END"
    return f"CASE WHEN strlen(text) <= {most} THEN text ELSE decode(unhex(left(h, 2 * ({most} - {back})))) END"


HEX = "x AS (SELECT doc_id, text, hex(encode(text)) AS h FROM documents)"


@query(f"WITH {HEX} SELECT doc_id, strlen(text) <= 2000 AS small, md5({first_bytes_sql(200)} || CASE WHEN strlen(text) > 200 THEN '...' ELSE '' END) AS digest FROM x")
def truncate_texts(spark, sf_dir):
    cut = T.truncate_bytes(F.col("text"), 200)
    return documents(spark, sf_dir).select("doc_id", (F.octet_length("text") <= 2000).alias("small"), F.md5(cut).alias("digest"))


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_message(spark, sf_dir):
    return rag.last_user_message(table(spark, sf_dir, "conversations"))


# evaluation: quality and toxic marks of labels stand in for a judge's scores
SCORES = "o AS (SELECT d.lang AS namespace, CASE WHEN toxic = 0 THEN quality::DOUBLE ELSE quality * 0.3::DOUBLE END AS context_recall, CASE WHEN n_chars % 2 = 0 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS faithfulness FROM labels l JOIN documents d USING (doc_id))"


def outcomes(spark, sf_dir):
    own = table(spark, sf_dir, "labels").join(documents(spark, sf_dir), "doc_id")
    scored = own.select(F.col("lang").alias("namespace"), evals.recall_score(F.col("quality").cast("double"), F.col("toxic") == 0).alias("context_recall"), F.when(F.col("n_chars") % 2 == 0, 0.5).otherwise(0.9).alias("faithfulness"))
    return scored.withColumn("verdict", evals.verdict(F.col("context_recall"), F.col("faithfulness")))


@query(f"""WITH {SCORES}, v AS (SELECT *, CASE WHEN (context_recall + faithfulness) / 2 >= 0.7 THEN 'PASS' WHEN (context_recall + faithfulness) / 2 >= 0.4 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM o)
SELECT namespace, verdict, count(*) AS n, round(avg(context_recall), 9) AS avg_recall, round(avg(faithfulness), 9) AS avg_faithfulness FROM v GROUP BY ALL""")
def eval_verdicts(spark, sf_dir):
    return evals.by_verdict(outcomes(spark, sf_dir))


@query(f"WITH {SCORES} SELECT count(*) AS total, count(*) FILTER (WHERE context_recall >= 0.7) AS passed, count(*) FILTER (WHERE NOT context_recall >= 0.7) AS failed FROM o")
def eval_suite_summary(spark, sf_dir):
    return evals.summary(outcomes(spark, sf_dir))


@query("SELECT doc_id, quality / 2.0::DOUBLE AS confidence, toxic = 1 AS answer_ready, CASE WHEN toxic = 1 THEN 0 ELSE 2 END AS n_follow_up FROM labels")
def llm_json_parse(spark, sf_dir):
    body = F.concat(F.lit('```json\n{"confidence": '), (F.col("quality") / 2).cast("string"), F.lit(', "answer_ready": '), (F.col("toxic") == 1).cast("string"), F.lit(', "follow_up_queries": '), F.when(F.col("toxic") == 1, "[]").otherwise('["a", "b"]'), F.lit("}\n```"))
    said = table(spark, sf_dir, "labels").select("doc_id", rag.parse_json(body, rag.ASSESSMENT).alias("a"))
    return said.select("doc_id", "a.confidence", "a.answer_ready", F.size("a.follow_up_queries").alias("n_follow_up"))


@query(r"""WITH p AS (SELECT n_name, 'plug_' || lower(n_name) AS name FROM nation) SELECT n_name, trim(name) AS name, ['.x' || length(n_name), '.y'] AS extensions FROM p""")
def plugin_meta(spark, sf_dir):
    source = F.concat(F.lit("#!/usr/bin/env python3\n# name: plug_"), F.lower("n_name"), F.lit("\n# extensions: .x"), F.length("n_name").cast("string"), F.lit(", .y\nprint(1)\n"))
    return table(spark, sf_dir, "nation").select("n_name", T.plugin_meta(source).alias("m")).select("n_name", "m.name", "m.extensions")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size::BIGINT WHEN 1 THEN p_size::BIGINT * 1048576 ELSE p_size::BIGINT * 1073741824 END AS n_bytes FROM part")
def size_strings(spark, sf_dir):
    text = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "MB").otherwise("gb"))
    return table(spark, sf_dir, "part").select("p_partkey", T.size_in_bytes(text).alias("n_bytes"))


@query("SELECT r_regionkey, concat_ws(' ', nullif(r_regionkey::VARCHAR, ''), nullif(r_name, '')) AS text FROM region")
def csv_rows(spark, sf_dir):
    from ..sources import files

    return table(spark, sf_dir, "region").select("r_regionkey", files.joined_values(["r_regionkey", "r_name"]).alias("text"))


# hosts of many forms, each with what it is
HOSTS = [("10.{i}.1.2", True), ("172.{i}.1.2", None), ("8.{i}.1.2", False), ("127.{i}.1.2", True), ("192.168.{i}.1", True), ("192.{i}.1.1", None), ("169.254.{i}.1", True), ("224.0.0.{i}", True), ("224.0.1.{i}", False), ("::1", True), ("fe80::{i}", True), ("ff02::{i}", True), ("fd00::{i}", False), ("::ffff:10.0.0.{i}", True), ("localhost", False), ("2001:db8::{i}", False)]


@query(f"""SELECT c_custkey, CASE i WHEN 1 THEN c_custkey % 256 BETWEEN 16 AND 31 WHEN 5 THEN c_custkey % 256 = 168 ELSE {[bool(p) for _, p in HOSTS]!r}[i + 1] END AS private FROM (SELECT c_custkey, c_custkey % {len(HOSTS)} AS i FROM customer)""")
def private_addresses(spark, sf_dir):
    forms = F.array(*(F.lit(h) for h, _ in HOSTS))
    host = F.replace(F.get(forms, (F.col("c_custkey") % len(HOSTS)).cast("int")), F.lit("{i}"), (F.col("c_custkey") % 256).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.is_private_address(host).alias("private"))


# messages of services: kind, and whether it is an error of access
SAID = [("HTTP 401: no key", "unauthorised", True), ("HTTP 429", "rate limited", False), ("code 403", "forbidden", True), ("timeout", "other", False), ("Unauthorized request", "unauthorised", False), ("Rate Limit hit", "rate limited", False), ("RESOURCE_EXHAUSTED", "rate limited", False), ("Forbidden", "forbidden", False), ("PERMISSION_DENIED", "other", True), ("API_KEY_INVALID", "other", True)]


@query(f"SELECT event_id, {[k for _, k, _ in SAID]!r}[event_id % {len(SAID)} + 1] AS kind, {[a for *_, a in SAID]!r}[event_id % {len(SAID)} + 1] AS auth FROM events")
def error_classes(spark, sf_dir):
    message = F.get(F.array(*(F.lit(m) for m, *_ in SAID)), (F.col("event_id") % len(SAID)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", T.embedding_error(message).alias("kind"), T.is_auth_error(message).alias("auth"))


LETTERS = "aenrstiu"


def letter_embedder(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model that SQL can follow: how often each of a few letters stands in a text."""
    return [[float(t.count(c)) for c in LETTERS] for t in texts]


@query(r"""WITH t AS (SELECT doc_id, lang AS namespace, 'src/' || source || '/' || doc_id || '.md' AS path, regexp_replace(text || ' [x](p' || doc_id || '.md)', '^\s+|\s+$', '', 'g') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM t),
c AS (SELECT *, unnest(range(0, CASE WHEN len(w) <= 512 THEN 1 ELSE 1 + CAST(ceil((len(w) - 512) / 462.0) AS BIGINT) END)) AS chunk FROM w),
p AS (SELECT *, array_to_string(w[chunk * 462 + 1 : chunk * 462 + 512], ' ') AS body, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(namespace || ':' || path || ':' || chunk)) AS h FROM c)
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id,
 namespace, path, chunk, md5(body) AS digest, CASE WHEN chunk = 0 THEN '[{"type":"links_to","target":"p' || doc_id || '.md"}]' ELSE '' END AS relations,
 md5(array_to_string(list_filter(regexp_split_to_array(lower(body), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ')) AS tokens, """ + " || ',' || ".join(f"(length(body) - length(replace(body, '{c}', '')))" for c in LETTERS) + f" AS letters FROM p WHERE regexp_matches(body, '[{LETTERS}]')")
def index_pipeline(spark, sf_dir):
    """Documents to points: chunks, relations, ids, tokens, and vectors of a stand-in."""
    path = F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    own = documents(spark, sf_dir).select(F.col("lang").alias("namespace"), path.alias("path"), F.concat("text", F.lit(" [x](p"), F.col("doc_id").cast("string"), F.lit(".md)")).alias("text"))
    made = index.points(own, letter_embedder)
    letters = F.array_join(F.transform("vector", lambda x: x.cast("long").cast("string")), ",")
    return made.select("point_id", "namespace", "path", "chunk", F.md5("text").alias("digest"), "relations", F.md5(F.array_join("tokens", " ")).alias("tokens"), letters.alias("letters"))


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents WHERE strlen(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 10),
s AS (SELECT doc_id, string_split(replace(replace(replace(replace(text, '. ', '. ' || chr(1)), '? ', '? ' || chr(1)), '! ', '! ' || chr(1)), chr(10) || chr(10), chr(10) || chr(10) || chr(1)), chr(1)) AS s FROM d),
t AS (SELECT doc_id, list_filter(list_transform(s, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: strlen(x) >= 10) AS t FROM s),
e AS (SELECT doc_id, i, t[i] AS s, length(t[i]) % 2 AS kind, len(list_filter(regexp_split_to_array(t[i], '\s+'), lambda x: x <> '')) AS n FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM t WHERE len(t) > 3)),
g AS (SELECT doc_id, i, kind, n AS words, 0 AS grp FROM e WHERE i = 1
 UNION ALL SELECT e.doc_id, e.i, e.kind, CASE WHEN e.kind = g.kind AND g.words + e.n <= 512 THEN g.words + e.n ELSE e.n END, CASE WHEN e.kind = g.kind AND g.words + e.n <= 512 THEN g.grp ELSE g.grp + 1 END FROM g JOIN e ON e.doc_id = g.doc_id AND e.i = g.i + 1),
m AS (SELECT doc_id, grp AS chunk, string_agg(s, ' ' ORDER BY i) AS body FROM g JOIN e USING (doc_id, i) GROUP BY ALL),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM d JOIN t USING (doc_id) WHERE len(t) <= 3),
c AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 512 THEN 1 ELSE 1 + CAST(ceil((len(w) - 512) / 462.0) AS BIGINT) END)) AS i FROM w)
SELECT doc_id, CAST(chunk AS INT) AS chunk, md5(body) AS digest FROM m UNION ALL SELECT doc_id, CAST(i AS INT), md5(array_to_string(w[i * 462 + 1 : i * 462 + 512], ' ')) FROM c""")
def semantic_chunks(spark, sf_dir):
    """All texts, cut by a stand-in for which sentences agree if their lengths are both even or both odd; texts of few sentences are cut by words."""
    agree = lambda texts: [[1.0, 0.0] if len(t) % 2 else [0.0, 1.0] for t in texts]
    return index.semantic_chunks(documents(spark, sf_dir).select("doc_id", "text"), agree).select("doc_id", F.col("chunk").cast("int").alias("chunk"), F.md5("text").alias("digest"))


@query("""WITH q AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id), a AS (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT conv_id, q.text, CASE WHEN a.text IS NULL THEN 'No results.' ELSE '[Source: conv/' || conv_id || ']' || chr(10) || a.text END AS answer FROM q LEFT JOIN a USING (conv_id)""")
def answer_fallback(spark, sf_dir):
    """What a failing model leaves of a conversation: its last question with the first answer, as text and source."""
    turns = table(spark, sf_dir, "conversations")
    first = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("_text"))
    shown = rag.block(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")), F.col("_text"))
    return rag.last_user_message(turns).join(first, "conv_id", "left").select("conv_id", "text", F.coalesce(shown, F.lit("No results.")).alias("answer"))


# programs in five languages made of the documents' lines: what stands before the first word of each line, whether the word stays, what follows it
FORMS = {
    "py": [("import ", 1, ""), ("from ", 1, " import y"), ("def ", 1, "(a):"), ("  async def f_", 1, " ("), ("class ", 1, ":"), ("x = ", 1, "")],
    "ts": [("import {a} from './", 1, "'"), ('const b = require("', 1, '")'), ("export function ", 1, "() {}"), ("export default class Box", 0, " {"), ("const a_", 1, " = 1"), ("// ", 1, "")],
    "cpp": [("#include <", 1, ".h>"), ('  # include "', 1, '"'), ("int ", 1, ";")],
    "md": [("[a](", 1, ")"), ("see [b](https://", 1, ") x"), ("[c](", 1, "#top) [d](d/e.md)"), ("", 1, "")],
    "go": [('import "', 1, '"'), ("func ", 1, "(a int) {"), ("import (", 0, ""), ('\tx "', 1, '"'), ("type Hidden struct {", 0, ""), (" )", 0, ""), ("func (b *Box) Run", 0, "() {"), ("type ", 1, " struct {")],
}


def _line_sql(forms: list) -> str:
    cases = " ".join(f"WHEN {i} THEN '{a.replace(chr(39), chr(39) * 2)}' || {'w' if keep else chr(39) * 2} || '{z.replace(chr(39), chr(39) * 2)}'" for i, (a, keep, z) in enumerate(forms))
    return f"CASE i % {len(forms)} {cases} END".replace("\t", "' || chr(9) || '")


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


PROGRAMS = rf"""l AS (SELECT doc_id, i, regexp_extract(x, '^[^\s]*') AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
m AS (SELECT doc_id, i, CASE doc_id % {len(FORMS)} {" ".join(f"WHEN {k} THEN {_line_sql(f)}" for k, f in enumerate(FORMS.values()))} END AS x FROM l),
t AS (SELECT doc_id, doc_id % {len(FORMS)} AS k, i, x, regexp_replace(x, '^\s+|\s+$', '', 'g') AS y FROM m),
g AS (SELECT *, coalesce(max(CASE WHEN starts_with(y, 'import (') THEN i END) OVER w, -1) > coalesce(max(CASE WHEN y = ')' THEN i END) OVER w, -1) AS inside FROM t WHERE k = 4 WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT doc_id, 'imports' AS type, coalesce(nullif(regexp_extract(y, {_sql_text(R.PY_IMPORT)}, 1), ''), regexp_extract(y, {_sql_text(R.PY_FROM)}, 1)) AS target, '' AS name FROM t WHERE k = 0
UNION ALL SELECT doc_id, 'defines', '', regexp_extract(y, {_sql_text(R.PY_DEF)}, 1) FROM t WHERE k = 0
UNION ALL SELECT doc_id, 'imports', regexp_extract(y, {_sql_text(R.JS_IMPORT)}, 1), '' FROM t WHERE k = 1
UNION ALL SELECT doc_id, 'defines', '', coalesce(nullif(regexp_extract(y, {_sql_text(R.JS_DEF)}, 2), ''), regexp_extract(y, {_sql_text(R.JS_DEF)}, 1)) FROM t WHERE k = 1
UNION ALL SELECT doc_id, 'imports', regexp_extract(x, {_sql_text(R.C_INCLUDE)}, 1), '' FROM t WHERE k = 2
UNION ALL SELECT doc_id, 'links_to', trim(u), '' FROM (SELECT doc_id, unnest(regexp_extract_all(x, {_sql_text(R.MD_LINK)}, 1)) AS u FROM t WHERE k = 3) WHERE NOT regexp_matches(trim(u), '^https?://')
UNION ALL SELECT doc_id, 'imports', regexp_extract(y, {_sql_text(R.GO_PATH)}, 1), '' FROM g WHERE NOT starts_with(y, 'import (') AND (inside AND y <> ')' OR NOT inside AND starts_with(y, 'import '))
UNION ALL SELECT doc_id, 'defines', '', coalesce(nullif(regexp_extract(y, {_sql_text(R.GO_FUNC)}, 1), ''), regexp_extract(y, {_sql_text(R.GO_TYPE)}, 1)) FROM g WHERE NOT inside AND NOT starts_with(y, 'import '))"""


@query(f"WITH {PROGRAMS} SELECT doc_id, type, target, name FROM e WHERE target <> '' OR name <> ''")
def relations_of_texts(spark, sf_dir):
    """Whole texts as programs, through the dispatcher by extension."""
    word = lambda x: F.regexp_extract(x, r"^[^\s]*", 0)

    def program(forms: list):
        line = lambda x, i: F.get(F.array(*(F.concat(F.lit(a), word(x) if keep else F.lit(""), F.lit(z)) for a, keep, z in forms)), i % len(forms))
        return F.array_join(F.transform(F.split("text", "\n"), line), "\n")

    k = F.col("doc_id") % len(FORMS)
    text, ext = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, (name, forms) in enumerate(FORMS.items()):
        text, ext = F.when(k == n, program(forms)).otherwise(text), F.when(k == n, F.lit(f"f.{name}")).otherwise(ext)
    own = documents(spark, sf_dir).select("doc_id", text.alias("text"), ext.alias("path"))
    return listed(own, R.relations(F.col("path"), F.col("text"))).where("target <> '' OR name <> ''")


@query(f"WITH {HEX} SELECT doc_id, CASE WHEN strlen(text) < 200 THEN '' ELSE md5(trim({first_bytes_sql(4000)})) END AS digest FROM x")
def excerpts(spark, sf_dir):
    cut = T.excerpt(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.when(cut == "", "").otherwise(F.md5(cut)).alias("digest"))


@query("SELECT page_id, md5(replace(to_base64(encode(html)), chr(10), '')) AS digest, true AS same FROM pages")
def base64_payloads(spark, sf_dir):
    """Contents as they travel to plug-ins: base64 in one line, and back."""
    packed = F.regexp_replace(F.base64(F.encode("html", "utf-8")), r"[\r\n]", "")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(packed).alias("digest"), (F.decode(F.unbase64(packed), "utf-8") == F.col("html")).alias("same"))


@query("SELECT n_nationkey, ['r' || n_regionkey, 'all'] AS namespaces FROM nation")
def acl_json(spark, sf_dir):
    """Access lists as JSON maps, each read for the group named after its region."""
    group = F.concat(F.lit("g"), F.col("n_regionkey").cast("string"))
    text = F.concat(F.lit('{"'), group, F.lit('": ["r'), F.col("n_regionkey").cast("string"), F.lit('", "all"], "x": []}'))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.from_json(text, "map<string,array<string>>")[group].alias("namespaces"))


@query("""SELECT c_custkey, left(c_name, 12) || CASE WHEN length(c_name) > 12 THEN '...' ELSE '' END AS short, CASE WHEN length(c_name) >= 20 THEN c_name ELSE rpad(c_name, 20, ' ') END AS padded FROM customer""")
def padded_names(spark, sf_dir):
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", T.truncate_chars(name, 12).alias("short"), T.pad_right(name, 20).alias("padded"))
