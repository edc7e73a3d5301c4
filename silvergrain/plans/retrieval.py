"""Search, fusion, graph and reranking over points made from embeddings and documents."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import relations as R
from ..functions import text as T
from ..functions import vectors as V
from ..operators import governance, graph, index, postings, rag
from ..operators import search as S
from ..workspace import work_dir
from .catalog import query, table

#: The query of the examples: the vector of this id, and these words.
ASKED, WORDS = 7, "the and of"
POINTS = """points AS (SELECT e.vec_id, d.lang AS namespace, 'src/' || d.source || '/' || d.doc_id || '.md' AS path, 0::BIGINT AS chunk, d.text, e.embedding::DOUBLE[] AS v
  FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id)"""
DENSE = """scored AS (SELECT p.*, round(list_cosine_similarity(p.v, q.v), 9) AS score FROM points p, (SELECT v FROM points WHERE vec_id = 7) q)"""
MATCH = r"""hits AS (SELECT * FROM points WHERE list_has_all(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), ['the', 'and', 'of']))"""


#: Tables made from the tables of a folder, by session, folder, name and the files that it held.
_MADE: dict[tuple, tuple[str, str]] = {}


def version(spark, *paths: str) -> tuple:
    """Names, sizes and times of the files of tables: another version is another table."""
    out = []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        listed = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
        out += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in listed)
    return tuple(out)


def stored(spark, sf_dir: str, name: str, tables: tuple[str, ...], write) -> tuple[str, str]:
    """Where what ``write`` makes of the tables lies, and what it returned: made when first asked for in a session, and again when the tables have changed."""
    key = (spark.sparkContext.applicationId, sf_dir, name, version(spark, *(f"{sf_dir}/{t}.parquet" for t in tables)))
    if key not in _MADE:
        path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _MADE[key] = path, write(path)
    return _MADE[key]


def made_points(spark, sf_dir: str) -> DataFrame:
    """Embeddings joined to their documents, as points with tokens for text match; one chunk a document."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    path = F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return e.join(d, e.vec_id == d.doc_id).select("vec_id", path.alias("path"), F.lit(0).cast("long").alias("chunk"), "text", F.col("embedding").alias("vector"), T.match_tokens(F.col("text")).alias("tokens"), F.col("lang").alias("namespace"))


def points(spark, sf_dir: str) -> DataFrame:
    """The point table of these tables, read from where an index run would have left it."""

    def write(path: str) -> str:
        made = made_points(spark, sf_dir)
        index.write_points(made, path)
        return made.schema.json()

    path, schema = stored(spark, sf_dir, "points", ("embeddings", "documents"), write)
    return spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(path)


def asked(spark, sf_dir: str) -> list[float]:
    return points(spark, sf_dir).where(F.col("vec_id") == ASKED).first()["vector"]


KEYED = ["namespace", "path", "chunk", "score"]


@query(f"WITH {POINTS}, {DENSE} SELECT namespace, path, chunk, score FROM scored ORDER BY score DESC, namespace, path, chunk LIMIT 10")
def vector_topk(spark, sf_dir):
    return S.vector_search(points(spark, sf_dir), asked(spark, sf_dir)).select(KEYED)


@query(f"WITH {POINTS}, {DENSE} SELECT namespace, path, chunk, score FROM scored WHERE namespace = 'en' ORDER BY score DESC, namespace, path, chunk LIMIT 10")
def vector_topk_namespace(spark, sf_dir):
    return S.vector_search(points(spark, sf_dir), asked(spark, sf_dir), namespace="en").select(KEYED)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 9) AS score FROM embeddings e, q WHERE vec_id <> query_id)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM s) WHERE rank <= 5""")
def batch_knn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return S.batch_search(spark, e, e.where(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id"), 5)


@query(f"""WITH {POINTS}, {MATCH}, r AS (SELECT *, row_number() OVER (ORDER BY namespace, path, chunk) AS rank FROM hits)
SELECT namespace, path, chunk, round(1.0::DOUBLE / (60 + rank), 12) AS score FROM r ORDER BY score DESC, namespace, path, chunk LIMIT 10""")
def keyword_search(spark, sf_dir):
    return S.keyword_search(points(spark, sf_dir), WORDS)


HYBRID = """d AS (SELECT namespace, path, chunk, row_number() OVER (ORDER BY score DESC, namespace, path, chunk) AS rank FROM scored {where}),
t AS (SELECT namespace, path, chunk, row_number() OVER (ORDER BY namespace, path, chunk) AS rank FROM hits {where}),
f AS (SELECT namespace, path, chunk, round(sum(part), 12) AS score FROM (SELECT namespace, path, chunk, 1.0::DOUBLE / (60 + rank) AS part FROM d WHERE rank <= 20
  UNION ALL SELECT namespace, path, chunk, 1.0::DOUBLE / (60 + rank) FROM t WHERE rank <= 20) GROUP BY ALL)"""


@query(f"WITH {POINTS}, {DENSE}, {MATCH}, {HYBRID.format(where='')} SELECT * FROM f ORDER BY score DESC, namespace, path, chunk LIMIT 10")
def hybrid_search(spark, sf_dir):
    return S.hybrid_search(points(spark, sf_dir), asked(spark, sf_dir), WORDS)


@query(f"WITH {POINTS}, {DENSE}, {MATCH}, {HYBRID.format(where="WHERE path IN (SELECT 'src/' || source || '/' || doc_id || '.md' FROM documents WHERE n_chars > 2000)")} SELECT * FROM f ORDER BY score DESC, namespace, path, chunk LIMIT 10")
def hybrid_by_paths(spark, sf_dir):
    long = table(spark, sf_dir, "documents").where("n_chars > 2000").select(F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return S.hybrid_search(points(spark, sf_dir), asked(spark, sf_dir), WORDS, paths=long)


@query(f"WITH {POINTS}, {DENSE}, {MATCH}, {HYBRID.format(where="WHERE namespace = 'de' AND path IN (SELECT 'src/' || source || '/' || doc_id || '.md' FROM documents WHERE n_chars > 500)")} SELECT * FROM f ORDER BY score DESC, namespace, path, chunk LIMIT 10".replace("['the', 'and', 'of']", "['der']"))
def hybrid_by_namespace_and_paths(spark, sf_dir):
    """One namespace, some paths and a text match at once."""
    long = table(spark, sf_dir, "documents").where("n_chars > 500").select(F.col("lang").alias("namespace"), F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return S.hybrid_search(points(spark, sf_dir), asked(spark, sf_dir), "der", namespace="de", paths=long)


# the full-text index: all points, then a batch in which every 7th document comes again with another text and every 11th is gone
def posted(spark, sf_dir: str, both: bool = False) -> str:
    """Where the index of the points lies, or (``both``) that of the points after the second batch; each is made when it is first asked for."""

    def write(path: str) -> None:
        own = points(spark, sf_dir)
        postings.add(own, path, 0)
        if both:
            again = own.where((F.col("vec_id") % 7 == 0) & (F.col("vec_id") % 11 != 0))
            half = F.concat(F.lit("Zebra-"), F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")))
            postings.add(again.withColumn("tokens", T.match_tokens(half)), path, 1, files=again, gone=own.where(F.col("vec_id") % 11 == 0))

    return stored(spark, sf_dir, "postings-both" if both else "postings", ("embeddings", "documents"), write)[0]


LATER = r"""later AS (SELECT *, regexp_split_to_array(lower(CASE WHEN vec_id % 7 = 0 THEN 'Zebra-' || left(text, length(text) // 2) ELSE text END), '[^\p{L}\p{N}]+') AS tokens FROM points WHERE vec_id % 11 <> 0)"""
#: Queries of the example: common words, a word of the second batch beside one that all have, words of another language, and one that is nowhere.
LOOKED_UP = ("the and of", "zebra", "Zebra, the", "der die und", "nowhere the")


@query(f"WITH {POINTS}, {MATCH}, r AS (SELECT *, row_number() OVER (ORDER BY namespace, path, chunk) AS rank FROM hits) SELECT namespace, path, chunk, round(1.0::DOUBLE / (60 + rank), 12) AS score FROM r ORDER BY score DESC, namespace, path, chunk LIMIT 10")
def indexed_keyword_search(spark, sf_dir):
    return postings.keyword_search(spark, posted(spark, sf_dir), WORDS)


@query(f"WITH {POINTS}, {LATER}, q(words, wanted) AS (VALUES ('the and of', ['the', 'and', 'of']), ('zebra', ['zebra']), ('Zebra, the', ['zebra', 'the']), ('der die und', ['der', 'die', 'und']), ('nowhere the', ['nowhere', 'the'])) SELECT words, namespace, path, chunk FROM later, q WHERE list_has_all(tokens, wanted)")
def indexed_matches(spark, sf_dir):
    """All matches of a few queries after a second batch that changed and removed files."""
    root, out = posted(spark, sf_dir, both=True), None
    for words in LOOKED_UP:
        found = postings.matches(spark, root, words).select(F.lit(words).alias("words"), *S.KEY)
        out = found if out is None else out.unionByName(found)
    return out


@query(f"WITH {POINTS}, {DENSE}, {MATCH}, {HYBRID.format(where='')} SELECT * FROM f ORDER BY score DESC, namespace, path, chunk LIMIT 10")
def indexed_hybrid_search(spark, sf_dir):
    return postings.hybrid_search(spark, points(spark, sf_dir), posted(spark, sf_dir), asked(spark, sf_dir), WORDS)


FAN = """d AS (SELECT namespace, path, chunk, score, row_number() OVER (PARTITION BY namespace ORDER BY score DESC, path, chunk) AS rank FROM scored),
t AS (SELECT namespace, path, chunk, row_number() OVER (PARTITION BY namespace ORDER BY path, chunk) AS rank FROM hits)"""
ACROSS = "SELECT namespace, path, chunk, round(1.0::DOUBLE / (60 + rank), 12) AS score, namespace AS source_namespace FROM l WHERE rank <= 10 ORDER BY score DESC, namespace, path, chunk LIMIT 10"


@query(f"WITH {POINTS}, {DENSE}, {MATCH}, {FAN}, l AS (SELECT namespace, path, chunk, rank FROM d) {ACROSS}")
def fanout_semantic(spark, sf_dir):
    return S.fan_out(points(spark, sf_dir), asked(spark, sf_dir))


@query(f"""WITH {POINTS}, {DENSE}, {MATCH}, {FAN}, f AS (SELECT namespace, path, chunk, round(sum(part), 12) AS score FROM (SELECT namespace, path, chunk, 1.0::DOUBLE / (60 + rank) AS part FROM d WHERE rank <= 20
  UNION ALL SELECT namespace, path, chunk, 1.0::DOUBLE / (60 + rank) FROM t WHERE rank <= 20) GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY score DESC, path, chunk) AS rank FROM f) {ACROSS}""")
def fanout_hybrid(spark, sf_dir):
    return S.fan_out(points(spark, sf_dir), asked(spark, sf_dir), WORDS)


@query(f"WITH {POINTS}, {DENSE}, {MATCH}, {FAN}, l AS (SELECT * FROM t) {ACROSS}")
def fanout_keyword(spark, sf_dir):
    return S.fan_out(points(spark, sf_dir), words=WORDS)


LEGS = """a AS (SELECT namespace, path, chunk, row_number() OVER (ORDER BY score DESC, namespace, path, chunk) AS rank FROM scored),
b AS (SELECT namespace, path, chunk, row_number() OVER (ORDER BY score, namespace, path, chunk) AS rank FROM scored WHERE namespace = 'en')"""


def legs(spark, sf_dir):
    own = S.scored(points(spark, sf_dir), asked(spark, sf_dir))
    return S.ranked(own, 20, [F.desc("score"), *map(F.col, S.KEY)]), S.ranked(own.where("namespace = 'en'"), 20, [F.col("score"), *map(F.col, S.KEY)])


@query(f"""WITH {POINTS}, {DENSE}, {LEGS} SELECT namespace, path, chunk, round(sum(part), 12) AS score FROM (SELECT namespace, path, chunk, 1.0::DOUBLE / (60 + rank) AS part FROM a WHERE rank <= 20
UNION ALL SELECT namespace, path, chunk, 0.7::DOUBLE / (60 + rank) FROM b WHERE rank <= 20) GROUP BY ALL ORDER BY score DESC, namespace, path, chunk LIMIT 30""")
def rrf_merge_weighted(spark, sf_dir):
    return S.weighted_merge(*legs(spark, sf_dir), k=30)


@query(f"WITH {POINTS}, {DENSE}, {LEGS} SELECT namespace, path, chunk, round(1.0::DOUBLE / (60 + rank), 12) AS score FROM a WHERE rank <= 20")
def rrf_zero_weight_leg(spark, sf_dir):
    a, b = legs(spark, sf_dir)
    return S.fuse([(a, 1.0), (b, 0.0)], 30)


# rerank: a stand-in scores texts by their share of the query's words
RERANK = f"""{POINTS}, {DENSE}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, namespace, path, chunk) AS rank FROM scored),
k AS (SELECT namespace, path, chunk, rank, round(len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x IN ('the', 'and', 'of'))) / greatest(len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')), 1), 9) AS rerank_score FROM r WHERE rank <= 20),
n AS (SELECT *, row_number() OVER (ORDER BY rerank_score DESC, rank) AS new_rank FROM k)"""


def reranked(spark, sf_dir, **options):
    best = S.ranked(S.scored(points(spark, sf_dir), asked(spark, sf_dir)), 20, [F.desc("score"), *map(F.col, S.KEY)])
    tokens = F.col("tokens")
    share = F.round(F.size(F.filter(tokens, lambda t: t.isin("the", "and", "of"))) / F.greatest(F.size(tokens), F.lit(1)), 9)
    return S.rerank(best.select(*S.KEY, "rank"), best.select(*S.KEY, share.alias("rerank_score")), **options)


@query(f"WITH {RERANK} SELECT namespace, path, chunk, rank, rerank_score, new_rank, new_rank <> rank AS moved FROM n WHERE new_rank <= 10 AND (rerank_score >= 0.05 OR NOT EXISTS (SELECT 1 FROM n WHERE new_rank <= 10 AND rerank_score >= 0.05))")
def rerank_apply(spark, sf_dir):
    return reranked(spark, sf_dir, top_k=10, threshold=0.05)


@query(f"WITH {RERANK} SELECT count(*) AS n, count(*) FILTER (WHERE new_rank <> rank) AS changed, CAST(sum(abs(new_rank - rank)) AS BIGINT) AS distance FROM n")
def rank_delta(spark, sf_dir):
    done = reranked(spark, sf_dir)
    moves = rag.rank_changes(done, done.drop("rank").withColumnRenamed("new_rank", "rank"), "path")
    return moves.agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("changed"), F.sum(F.abs(F.col("rank_after") - F.col("rank_before"))).alias("distance"))


# access control
# customers are users: each is in a group of its nation and one of its region; what groups may read is told by their keys
@query("""WITH acl AS (SELECT 'n' || n_nationkey AS grp, CASE n_nationkey % 4 WHEN 0 THEN ['en'] WHEN 1 THEN ['fr', 'de'] WHEN 2 THEN ['de'] ELSE [] END AS ns FROM nation UNION ALL SELECT 'r' || r_regionkey, CASE WHEN r_regionkey = 4 THEN ['*', 'en'] WHEN r_regionkey % 2 = 0 THEN ['es', 'de'] ELSE [] END FROM region),
m AS (SELECT 'c' || c_custkey AS "user", unnest(['n' || c_nationkey, 'r' || n_regionkey, 'nobody']) AS grp FROM customer JOIN nation ON n_nationkey = c_nationkey),
f AS (SELECT "user", unnest(ns) AS ns FROM m JOIN acl USING (grp)), s AS (SELECT "user", list_sort(list(DISTINCT ns)) AS l FROM f GROUP BY ALL)
SELECT u."user", CASE WHEN list_contains(l, '*') THEN ['*'] ELSE coalesce(l, CAST([] AS VARCHAR[])) END AS namespaces FROM (SELECT DISTINCT "user" FROM m) u LEFT JOIN s USING ("user")""")
def group_acl(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    several = lambda *ns: F.array(*map(F.lit, ns)).cast("array<string>")
    k = F.col("n_nationkey") % 4
    of_nation = F.when(k == 0, several("en")).when(k == 1, several("fr", "de")).when(k == 2, several("de")).otherwise(several())
    r = F.col("r_regionkey")
    of_region = F.when(r == 4, several("*", "en")).when(r % 2 == 0, several("es", "de")).otherwise(several())
    acl = nation.select(name("n", "n_nationkey").alias("grp"), of_nation.alias("namespaces")).unionByName(table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("grp"), of_region.alias("namespaces")))
    users = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(name("c", "c_custkey").alias("user"), F.array(name("n", "c_nationkey"), name("r", "n_regionkey"), F.lit("nobody")).alias("groups"))
    return governance.allowed_namespaces(users, acl)


def acl_tables(spark):
    users = spark.createDataFrame([("ann", ["hr", "eng"]), ("bob", ["admins", "hr"]), ("cy", ["none"]), ("di", ["ops"])], "user string, groups array<string>")
    acl = spark.createDataFrame([("hr", ["de"]), ("eng", ["en", "de"]), ("ops", ["en", "es"]), ("admins", ["*"])], "grp string, namespaces array<string>")
    return users, acl


@query("""WITH d AS (SELECT list_sort(list(DISTINCT lang)) AS known FROM documents)
SELECT r.id, list_sort(CASE WHEN wanted IN ('*', '__global__') THEN CASE WHEN list_contains(allowed, '*') THEN known ELSE list_filter(known, lambda x: list_contains(allowed, x)) END
 WHEN list_contains(allowed, '*') OR list_contains(allowed, wanted) THEN [wanted] ELSE CAST([] AS VARCHAR[]) END) AS namespaces
FROM d, (VALUES (1, '*', ['*']), (2, '*', ['en', 'xx']), (3, '__global__', ['xx']), (4, 'en', ['en']), (5, 'de', ['en']), (6, 'de', ['*'])) r(id, wanted, allowed)""")
def resolve_namespaces(spark, sf_dir):
    asked_for = spark.createDataFrame([(1, "*", ["*"]), (2, "*", ["en", "xx"]), (3, "__global__", ["xx"]), (4, "en", ["en"]), (5, "de", ["en"]), (6, "de", ["*"])], "id int, wanted string, allowed array<string>")
    known = table(spark, sf_dir, "documents").agg(F.sort_array(F.collect_set("lang")).alias("known"))
    return asked_for.crossJoin(F.broadcast(known)).select("id", governance.resolve(F.col("wanted"), F.col("known"), F.col("allowed")).alias("namespaces"))


@query(f"""WITH {POINTS}, {DENSE}, u AS (SELECT * FROM (VALUES ('ann', 'de'), ('ann', 'en'), ('bob', '*'), ('di', 'en'), ('di', 'es')) t("user", ns)),
r AS (SELECT "user", namespace, path, chunk, score, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, namespace, path, chunk) AS rank FROM scored JOIN u ON ns = '*' OR ns = namespace)
SELECT "user", namespace, path, chunk, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def acl_filtered_search(spark, sf_dir):
    users, acl = acl_tables(spark)
    allowed = governance.allowed_namespaces(users, acl)
    own = S.scored(points(spark, sf_dir), asked(spark, sf_dir))
    # the best of each namespace first, so that what is matched to users is a few rows a namespace
    best = S.ranked(own, 5, [F.desc("score"), *map(F.col, S.KEY)], ("namespace",)).drop("rank").select(KEYED)
    seen = best.join(F.broadcast(allowed), governance.may_read(F.col("namespaces"), F.col("namespace"))).drop("namespaces")
    return S.ranked(seen, 5, [F.desc("score"), *map(F.col, S.KEY)], ("user",))


# the graph: each document links to two others by position
LINKED = """n AS (SELECT count(*) AS n FROM documents), l AS (SELECT doc_id, lang, 'see [a](' || 'p' || ((7 * doc_id + 3) % n) || ') and [b](p' || ((11 * doc_id + 5) % n) || ') or [c](https://example.org/x)' AS text FROM documents, n),
e AS (SELECT lang AS namespace, 'p' || doc_id AS src, unnest(regexp_extract_all(text, '\\[[^\\]]*\\]\\(([^)#? ]+)\\)', 1)) AS dst FROM l), g AS (SELECT * FROM e WHERE dst NOT LIKE 'http%'),
w AS (SELECT src AS source, src AS path, 0 AS d FROM (SELECT 'p' || doc_id AS src FROM documents WHERE lang = 'es')),
w1 AS (SELECT DISTINCT source, dst AS path, 1 AS d FROM w JOIN g ON g.src = w.path), w2 AS (SELECT DISTINCT source, dst AS path, 2 AS d FROM w1 JOIN g ON g.src = w1.path), w3 AS (SELECT DISTINCT source, dst AS path, 3 AS d FROM w2 JOIN g ON g.src = w2.path)"""


def linked(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    n = docs.count()
    to = lambda a, b: F.pmod(F.col("doc_id") * a + b, F.lit(n)).cast("string")
    text = F.concat(F.lit("see [a](p"), to(7, 3), F.lit(") and [b](p"), to(11, 5), F.lit(") or [c](https://example.org/x)"))
    return docs.select(F.col("lang").alias("namespace"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.lit(0).alias("chunk"), R.to_json(R.link_relations(text)).alias("relations"))


def edge_table(spark, sf_dir):
    """The edges as an index run leaves them."""
    path, _ = stored(spark, sf_dir, "edges", ("documents",), lambda path: graph.write_edges(graph.edges(linked(spark, sf_dir)), path))
    return spark.read.schema("src string, dst string, namespace string").parquet(path)


def sources(files):
    return files.where("namespace = 'es'").select("path")


@query(f"WITH {LINKED} SELECT * FROM g")
def graph_edges(spark, sf_dir):
    return graph.edges(linked(spark, sf_dir))


def _near(depth):
    steps = " UNION ALL ".join(f"SELECT * FROM w{d}" for d in range(1, depth + 1))

    @query(f"WITH {LINKED} SELECT source, path, min(d) AS depth FROM ({steps}) WHERE path <> source GROUP BY ALL")
    def near(spark, sf_dir):
        files = linked(spark, sf_dir)
        return graph.neighbours(edge_table(spark, sf_dir), sources(files), depth)

    return near


for _d in (1, 2, 3):
    from . import catalog

    _f = _near(_d)
    catalog.QUERIES[f"neighbors_depth{_d}"] = catalog.QUERIES.pop("near")
    catalog.SQL[f"neighbors_depth{_d}"] = catalog.SQL.pop("near")


# two namespaces with the same paths: of a document's links, even ones hold in its own and odd ones in the other
TWICE = """n AS (SELECT count(*) AS n FROM documents), g AS (SELECT DISTINCT CASE WHEN (doc_id + j) % 2 = 0 THEN 'left' ELSE 'right' END AS namespace, 'q' || (doc_id % (n // 2)) AS src, 'q' || ((k * doc_id + j) % (n // 2)) AS dst FROM documents, n, (VALUES (7, 0), (11, 1), (13, 2)) t(k, j)),
w AS (SELECT DISTINCT ns AS namespace, 'q' || doc_id AS source, 'q' || doc_id AS path, 0 AS d FROM documents, n, (VALUES ('left'), ('right')) v(ns) WHERE doc_id % 10 = 0 AND doc_id < n // 2),
w1 AS (SELECT DISTINCT w.namespace, source, dst AS path, 1 AS d FROM w JOIN g ON g.namespace = w.namespace AND g.src = w.path), w2 AS (SELECT DISTINCT w1.namespace, source, dst AS path, 2 AS d FROM w1 JOIN g ON g.namespace = w1.namespace AND g.src = w1.path)"""


@query(f"WITH {TWICE} SELECT namespace, source, path, min(d) AS depth FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2) WHERE path <> source GROUP BY ALL")
def neighbors_by_namespace(spark, sf_dir):
    """Walks of two steps in namespaces that share paths: none leaves its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    half = docs.count() // 2
    link = lambda k, j: F.struct(F.when((F.col("doc_id") + j) % 2 == 0, "left").otherwise("right").alias("namespace"), F.concat(F.lit("q"), (F.col("doc_id") % half).cast("string")).alias("src"), F.concat(F.lit("q"), ((F.col("doc_id") * k + j) % half).cast("string")).alias("dst"))
    links = docs.select(F.inline(F.array(link(7, 0), link(11, 1), link(13, 2))))
    starts = docs.where((F.col("doc_id") % 10 == 0) & (F.col("doc_id") < half)).select(F.explode(F.array(F.lit("left"), F.lit("right"))).alias("namespace"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("path"))
    return graph.neighbours(links, starts, 2)


@query(f"WITH {LINKED} SELECT 'node' AS kind, path AS a, '' AS b FROM (SELECT path FROM w UNION SELECT path FROM w1 UNION SELECT path FROM w2) UNION ALL SELECT DISTINCT 'edge', source, path FROM (SELECT * FROM w1 UNION SELECT * FROM w2) WHERE source <> path")
def graph_nodes_edges(spark, sf_dir):
    files = linked(spark, sf_dir)
    nodes, edges = graph.nodes_and_edges(graph.edges(files), sources(files), 2)
    return nodes.select(F.lit("node").alias("kind"), F.col("path").alias("a"), F.lit("").alias("b")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b")))


@query(f"""WITH n AS (SELECT count(*) AS n FROM documents), pid AS (SELECT e.vec_id, d.lang AS namespace, 'p' || d.doc_id AS path, 0::BIGINT AS chunk, d.text, e.embedding::DOUBLE[] AS v FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id), points AS (SELECT * FROM pid), {DENSE}, {MATCH}, {HYBRID.format(where='')},
first AS (SELECT *, row_number() OVER (ORDER BY score DESC, namespace, path, chunk) AS rank FROM (SELECT * FROM f ORDER BY score DESC, namespace, path, chunk LIMIT 10)),
near AS (SELECT DISTINCT 'p' || ((a * CAST(substr(path, 2) AS BIGINT) + b) % n) AS path FROM first, n, (VALUES (7, 3), (11, 5)) t(a, b)),
own AS (SELECT * FROM near WHERE path NOT IN (SELECT path FROM first)),
d2 AS (SELECT namespace, path, chunk, row_number() OVER (ORDER BY score DESC, namespace, path, chunk) AS rank FROM scored WHERE path IN (SELECT path FROM own)),
t2 AS (SELECT namespace, path, chunk, row_number() OVER (ORDER BY namespace, path, chunk) AS rank FROM hits WHERE path IN (SELECT path FROM own)),
f2 AS (SELECT namespace, path, chunk, round(sum(part), 12) AS score FROM (SELECT namespace, path, chunk, 1.0::DOUBLE / (60 + rank) AS part FROM d2 WHERE rank <= 20 UNION ALL SELECT namespace, path, chunk, 1.0::DOUBLE / (60 + rank) FROM t2 WHERE rank <= 20) GROUP BY ALL),
second AS (SELECT *, row_number() OVER (ORDER BY score DESC, namespace, path, chunk) AS rank FROM (SELECT * FROM f2 ORDER BY score DESC, namespace, path, chunk LIMIT 10))
SELECT namespace, path, chunk, round(sum(part), 12) AS score FROM (SELECT namespace, path, chunk, 1.0::DOUBLE / (60 + rank) AS part FROM first UNION ALL SELECT namespace, path, chunk, 0.7::DOUBLE / (60 + rank) FROM second) GROUP BY ALL ORDER BY score DESC, namespace, path, chunk LIMIT 10""")
def graph_expand_search(spark, sf_dir):
    own = points(spark, sf_dir).withColumn("path", F.concat(F.lit("p"), F.col("vec_id").cast("string")))
    vector = asked(spark, sf_dir)
    first = S.ranked(S.hybrid_search(own, vector, WORDS), 10, [F.desc("score"), *map(F.col, S.KEY)])
    return graph.expand(own, edge_table(spark, sf_dir), first, vector, WORDS, bound=False)


@query(f"""WITH n AS (SELECT count(*) AS n FROM documents), pid AS (SELECT e.vec_id, d.lang AS namespace, 'p' || d.doc_id AS path, 0::BIGINT AS chunk, d.text, e.embedding::DOUBLE[] AS v FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id), points AS (SELECT * FROM pid), {DENSE}, {MATCH}, {HYBRID.format(where='')},
first AS (SELECT *, row_number() OVER (ORDER BY score DESC, namespace, path, chunk) AS rank FROM (SELECT * FROM f ORDER BY score DESC, namespace, path, chunk LIMIT 10)),
near AS (SELECT DISTINCT namespace, 'p' || ((a * CAST(substr(path, 2) AS BIGINT) + b) % n) AS path FROM first, n, (VALUES (7, 3), (11, 5)) t(a, b)),
own AS (SELECT * FROM near WHERE (namespace, path) NOT IN (SELECT (namespace, path) FROM first)),
d2 AS (SELECT namespace, path, chunk, row_number() OVER (ORDER BY score DESC, namespace, path, chunk) AS rank FROM scored WHERE (namespace, path) IN (SELECT (namespace, path) FROM own)),
t2 AS (SELECT namespace, path, chunk, row_number() OVER (ORDER BY namespace, path, chunk) AS rank FROM hits WHERE (namespace, path) IN (SELECT (namespace, path) FROM own)),
f2 AS (SELECT namespace, path, chunk, round(sum(part), 12) AS score FROM (SELECT namespace, path, chunk, 1.0::DOUBLE / (60 + rank) AS part FROM d2 WHERE rank <= 20 UNION ALL SELECT namespace, path, chunk, 1.0::DOUBLE / (60 + rank) FROM t2 WHERE rank <= 20) GROUP BY ALL),
second AS (SELECT *, row_number() OVER (ORDER BY score DESC, namespace, path, chunk) AS rank FROM (SELECT * FROM f2 ORDER BY score DESC, namespace, path, chunk LIMIT 10))
SELECT namespace, path, chunk, round(sum(part), 12) AS score FROM (SELECT namespace, path, chunk, 1.0::DOUBLE / (60 + rank) AS part FROM first UNION ALL SELECT namespace, path, chunk, 0.7::DOUBLE / (60 + rank) FROM second) GROUP BY ALL ORDER BY score DESC, namespace, path, chunk LIMIT 10""")
def graph_expand_bound(spark, sf_dir):
    """As ``graph_expand_search``, neighbours and the points searched kept to the namespace of the file they come from."""
    own = points(spark, sf_dir).withColumn("path", F.concat(F.lit("p"), F.col("vec_id").cast("string")))
    vector = asked(spark, sf_dir)
    first = S.ranked(S.hybrid_search(own, vector, WORDS), 10, [F.desc("score"), *map(F.col, S.KEY)])
    return graph.expand(own, edge_table(spark, sf_dir), first, vector, WORDS)


@query(f"""WITH {POINTS}, a AS (SELECT vec_id::VARCHAR AS point_id, round(list_cosine_similarity(p.v, q.v), 9) AS score FROM points p, (SELECT v FROM points WHERE vec_id = 7) q),
b AS (SELECT vec_id::VARCHAR AS point_id, round(list_cosine_similarity(p.v, q.v), 9) AS score FROM points p, (SELECT v FROM points WHERE vec_id = 11) q)
SELECT point_id, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL ORDER BY score DESC, point_id LIMIT 20""")
def agentic_merge(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == 11).first()["embedding"]
    own = points(spark, sf_dir).withColumn("point_id", F.col("vec_id").cast("string"))
    return rag.merge(S.scored(own, asked(spark, sf_dir)), S.scored(own, e))


# look-ups of a file and of what it leads to
@query(f"WITH {POINTS} SELECT namespace, path, chunk, md5(text) AS digest FROM points WHERE vec_id = {ASKED}")
def file_lookup(spark, sf_dir):
    own = points(spark, sf_dir)
    path = own.where(F.col("vec_id") == ASKED).first()["path"]
    return index.file_text(own, path).select("namespace", "path", "chunk", F.md5("text").alias("digest"))


@query(f"WITH {LINKED} SELECT lang AS namespace, kind, value, CAST(place AS INT) AS place FROM (SELECT lang, unnest(['leads_to', 'leads_to']) AS kind, unnest(['p' || ((7 * doc_id + 3) % n), 'p' || ((11 * doc_id + 5) % n)]) AS value, unnest([0, 1]) AS place FROM documents, n WHERE doc_id = {ASKED})")
def file_relations_lookup(spark, sf_dir):
    return graph.file_relations(linked(spark, sf_dir), f"p{ASKED}")


@query(f"WITH {POINTS}, {DENSE}, {FAN}, l AS (SELECT namespace, path, chunk, rank FROM d WHERE namespace <> 'fr'), o AS ({ACROSS}) SELECT *, 'de,en,es' AS answered, 'fr' AS failed FROM o")
def fanout_partial(spark, sf_dir):
    """Namespaces as tables of their own, one of which can't be read."""
    own, vector = points(spark, sf_dir), asked(spark, sf_dir)
    opened = {n: (lambda n=n: own.where(F.col("namespace") == n)) for n in ("de", "en", "es")}
    opened["fr"] = lambda: spark.read.parquet(f"{work_dir(spark)}/not-there")
    found, answered, failed = S.each_namespace(spark, opened, lambda p: S.scored(p, vector))
    return found.withColumn("answered", F.lit(",".join(sorted(answered)))).withColumn("failed", F.lit(",".join(failed)))


@query(f"""WITH {POINTS}, q(r, id) AS (VALUES (0, {ASKED}), (1, 11), (2, 13)), s AS (SELECT q.r, p.vec_id::VARCHAR AS point_id, round(list_cosine_similarity(p.v, o.v), 9) AS score FROM q JOIN points o ON o.vec_id = q.id, points p),
t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, point_id) AS n FROM s),
a AS (SELECT point_id, max(score) AS score FROM t WHERE r = 0 AND n <= 20 OR r > 0 AND n <= 5 GROUP BY ALL ORDER BY score DESC, point_id LIMIT 20) SELECT point_id, score, 3 AS rounds FROM a""")
def agentic_rounds(spark, sf_dir):
    """A loop of three rounds, in which a stand-in for the model asks for the neighbours of two more points."""
    own = points(spark, sf_dir).withColumn("point_id", F.col("vec_id").cast("string"))
    vectors = {r["vec_id"]: r["vector"] for r in own.where(F.col("vec_id").isin(ASKED, 11, 13)).collect()}
    near = lambda i: S.scored(own, vectors[i]).select("point_id", "score", "text").orderBy(F.desc("score"), "point_id")
    follow = iter((["11"], ["13"], []))
    found, rounds = rag.agentic_search(spark, "what", near(ASKED), lambda q: near(int(q)), lambda q, rows: {"confidence": 0.1, "follow_up_queries": next(follow)}, rounds=3)
    return found.select("point_id", "score", F.lit(rounds).alias("rounds"))


@query("SELECT label, list(m ORDER BY pos) AS centroid FROM (SELECT label, pos, round(avg(x::DOUBLE), 9) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label")
def centroids(spark, sf_dir):
    found = V.mean_by(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return found.select("label", F.transform("centroid", lambda x: F.round(x, 9)).alias("centroid"))


@query("""WITH q AS (SELECT vec_id AS query_id, label AS ql, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, ql, label, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 9) DESC, vec_id) AS rank FROM embeddings e, q WHERE vec_id <> query_id)
SELECT ql AS label, count(*) AS n, round(avg(CAST(label = ql AS INT)), 9) AS purity FROM s WHERE rank <= 10 GROUP BY ql""")
def label_purity_knn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    found = S.batch_search(spark, e, e.where(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id"), 10)
    labels = e.select(F.col("vec_id").alias("id"), F.col("label").alias("found"))
    own = e.select(F.col("vec_id").alias("query_id"), "label")
    return found.join(labels, "id").join(own, "query_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("found") == F.col("label")).cast("int")), 9).alias("purity"))


@query(f"WITH {POINTS} SELECT namespace, count(*) AS n FROM points WHERE list_sum(list_transform(v, lambda x: CAST(x <> 0 AS INT))) > 0 GROUP BY namespace")
def nonzero_points(spark, sf_dir):
    return points(spark, sf_dir).where(~V.is_zero(F.col("vector"))).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {POINTS}, {DENSE}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, namespace, path, chunk) AS rank FROM scored) SELECT path, round(score, 4) AS score, left(text, 100) || '...' AS preview FROM r WHERE rank <= 10")
def result_preview(spark, sf_dir):
    best = S.vector_search(points(spark, sf_dir), asked(spark, sf_dir))
    return best.select("path", F.round("score", 4).alias("score"), T.preview(F.col("path"), F.col("text")).alias("preview"))


@query(f"WITH {POINTS}, {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY score DESC, path, chunk) AS rank FROM scored) SELECT namespace, string_agg('[Source: ' || namespace || '/' || path || ']' || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 5 AND text <> '' GROUP BY namespace")
def build_context(spark, sf_dir):
    best = S.ranked(S.scored(points(spark, sf_dir), asked(spark, sf_dir)), 5, [F.desc("score"), *map(F.col, S.KEY)], ("namespace",))
    return rag.build_context(best, ["namespace"])


@query(f"WITH {POINTS}, {DENSE}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, namespace, path, chunk) AS rank FROM scored), s AS (SELECT split_part(path, '/', 2) AS source, min(rank) AS rank FROM r WHERE rank <= 50 GROUP BY ALL) SELECT source, rank, row_number() OVER (ORDER BY rank, source) AS place FROM s")
def unique_sources(spark, sf_dir):
    from ..operators import delta

    best = S.ranked(S.scored(points(spark, sf_dir), asked(spark, sf_dir)), 50, [F.desc("score"), *map(F.col, S.KEY)])
    return delta.first_seen(best.select(F.split_part("path", F.lit("/"), F.lit(2)).alias("source"), "rank"), "source", "rank")


