"""Queries of the retrieval operators over whole tables."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksight.functions import text as T
from ranksight.operators import bm25 as B
from ranksight.operators import fusion, knn
from ranksight.operators.search import SearchCorpus, search
from ranksight.operators.versions import Folder
from ranksight.plans.catalogue import query
from ranksight.runtime import file_status, load, shared_dir, table_dir

QUESTION = "durable session alias reject the signed margins"
RUSSIAN = "память агента и журнал снимок"
OTHERS = ("lang", "source")

# Marks are dropped on Latin letters only, one letter at a time; combining marks go.
_FOLD = "array_to_string(list_transform(string_split(regexp_replace(lower({0}), '[\\x{{0300}}-\\x{{036f}}]', '', 'g'), ''), lambda c: CASE WHEN regexp_matches(c, '\\p{{Latin}}') THEN strip_accents(c) ELSE c END), '')"


def _terms(c: str) -> str:
    return "regexp_extract_all(" + _FOLD.format(c) + r", '[\p{L}\p{N}]+')"


def _bm25_sql(queries: str, k: int, allowed: str = "true", score: str = "s", order: str = "s DESC", out: str = "query_id, doc_id, round(score, 4) AS score, rank") -> str:
    return f"""
WITH q AS ({queries}), qt AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]{{{{2,}}}}')) AS t FROM q),
tok AS (SELECT doc_id, unnest({_terms("text")}) AS t FROM documents),
len AS (SELECT doc_id, coalesce(len({_terms("text")}), 0) + coalesce(len({_terms("lang")}), 0) + coalesce(len({_terms("source")}), 0) AS dl FROM documents),
st AS (SELECT count(*) AS nd, avg(dl) AS av FROM len),
tf AS (SELECT t, doc_id, count(*) AS tf FROM tok WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
df AS (SELECT t, count(*) AS n FROM tf GROUP BY t),
idf AS (SELECT t, CASE WHEN ln((nd - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((nd - n + 0.5) / (n + 0.5)) END AS idf FROM df, st),
sc AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 10) AS s FROM qt JOIN tf USING (t) JOIN idf USING (t) JOIN len USING (doc_id), st GROUP BY ALL),
hits AS (SELECT query_id, doc_id, {score} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {order}, doc_id) AS rank FROM sc WHERE doc_id IN (SELECT doc_id FROM documents WHERE {allowed}))
SELECT {out} FROM hits WHERE rank <= {k}""".replace("{{2,}}", "{2,}")


def _index(spark: SparkSession, sf_dir: str) -> B.InvertedIndex:
    """The stored index of the documents: made by the first query that needs it, read by the others as long as the table
    stays as it is (name, size and time of its files)."""
    docs = load(spark, sf_dir, "documents")
    mark = repr([(f, *file_status(spark, f)) for f in sorted(docs.inputFiles())])
    path = f"{shared_dir(spark)}/inverted/{hashlib.sha256(mark.encode()).hexdigest()[:16]}"
    if not Folder(spark, path).exists("lengths/_SUCCESS"):
        B.InvertedIndex.build(docs, "doc_id", F.col("text"), OTHERS).save(path)
    return B.InvertedIndex.load(spark, path)


@query("SELECT (SELECT count(*) FROM documents) AS n_docs")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of the inverted index that the queries below share, built anew."""
    path = f"{table_dir(spark)}/inverted-{uuid.uuid4().hex}"
    B.InvertedIndex.build(load(spark, sf_dir, "documents"), "doc_id", F.col("text"), OTHERS).save(path)
    return B.InvertedIndex.load(spark, path).stats.select("n_docs")


def _ask(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("id").alias("doc_id"), F.round("score", 4).alias("score"), "rank")


def _sql_ask(*texts: str) -> str:
    return " UNION ALL ".join(f"SELECT {i}::INT AS query_id, '{t}' AS query" for i, t in enumerate(texts))


@query(f"SELECT t AS term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_terms('text')}) AS t FROM documents) GROUP BY t")
def tokenize_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = load(spark, sf_dir, "documents").select("doc_id", F.explode(T.terms(F.col("text"))).alias("term"))
    per_doc = words.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query(_bm25_sql(_sql_ask(QUESTION, RUSSIAN), 10))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(B.bm25(_index(spark, sf_dir), B.query_terms(_ask(spark, QUESTION, RUSSIAN)), 10))


@query(_bm25_sql(_sql_ask(QUESTION, RUSSIAN), 10, allowed="lang = 'ru'"))
def bm25_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = load(spark, sf_dir, "documents").where("lang = 'ru'").select(F.col("doc_id").alias("id"))
    return _shown(B.bm25(_index(spark, sf_dir), B.query_terms(_ask(spark, QUESTION, RUSSIAN)), 10, allowed))


@query(_bm25_sql("SELECT item_id AS query_id, replace(text, '_', ' ') AS query FROM eval_items", 10))
def bm25_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), F.translate("text", "_", " ").alias("query"))
    return _shown(B.bm25(_index(spark, sf_dir), B.query_terms(items), 10))


@query(_bm25_sql(_sql_ask("session session alias", "the the"), 10))
def bm25_repeated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(B.bm25(_index(spark, sf_dir), B.query_terms(_ask(spark, "session session alias", "the the")), 10))


@query(_bm25_sql(_sql_ask(QUESTION), 10, score="1 / (1 + abs(s))", order="1 / (1 + abs(s)) DESC"))
def bm25_inverse_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(B.bm25(_index(spark, sf_dir), B.query_terms(_ask(spark, QUESTION)), 10, inverse=True))


@query(
    rf"""
WITH t AS (SELECT doc_id, {_terms("text")} AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM t)
SELECT doc_id, count(*) AS tf FROM p WHERE w[i] = 'the' AND w[i + 1] = 'session' GROUP BY doc_id"""
)
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term with ``_`` is a phrase of its parts."""
    return B.match_counts(_index(spark, sf_dir), B.query_terms(_ask(spark, "the_session"))).select(F.col("id").alias("doc_id"), "tf")


def _knn_sql(queries: str, where: str = "true", k: int = 10, skip: str = "true") -> str:
    return f"""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {queries}),
s AS (SELECT query_id, vec_id, 1 - list_distance(e, embedding::DOUBLE[]) / 2 AS s FROM q, embeddings WHERE {where} AND {skip}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(s, 4) AS score, rank FROM r WHERE rank <= {k}"""


def _near(spark: SparkSession, sf_dir: str, queries: str, where: str = "true", k: int = 10, skip_self: bool = False) -> DataFrame:
    v = load(spark, sf_dir, "embeddings")
    q = v.where(queries).select(F.col("vec_id").alias("query_id"), "embedding")
    return knn.nearest(v.where(where), q, k, skip_self=skip_self)


def _near_shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("id").alias("vec_id"), F.round("score", 4).alias("score"), "rank")


@query(_knn_sql("vec_id = (SELECT min(vec_id) FROM embeddings)"))
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = load(spark, sf_dir, "embeddings").agg(F.min("vec_id")).first()[0]
    return _near_shown(_near(spark, sf_dir, f"vec_id = {first}"))


@query(_knn_sql("vec_id = (SELECT min(vec_id) FROM embeddings)", "label <= 3"))
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = load(spark, sf_dir, "embeddings").agg(F.min("vec_id")).first()[0]
    return _near_shown(_near(spark, sf_dir, f"vec_id = {first}", "label <= 3"))


@query(_knn_sql("vec_id % 20 = 0", skip="vec_id <> query_id"))
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_shown(_near(spark, sf_dir, "vec_id % 20 = 0", skip_self=True))


_TWO_BRANCHES = f"""
b AS (SELECT query_id, doc_id AS id, score, 'bm25' AS source FROM ({_bm25_sql(_sql_ask(QUESTION), 30, out="0 AS query_id, doc_id, score, rank")})),
qv AS (SELECT embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 1),
v AS (SELECT 0 AS query_id, vec_id AS id, 1 - list_distance(e, embedding::DOUBLE[]) / 2 AS score, 'vector' AS source FROM qv, embeddings QUALIFY row_number() OVER (ORDER BY score DESC, vec_id) <= 30),
h AS (SELECT * FROM b UNION ALL SELECT * FROM v)"""


def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.bm25(_index(spark, sf_dir), B.query_terms(_ask(spark, QUESTION)), 30).select("query_id", "id", "score", F.lit("bm25").alias("source"))
    v = load(spark, sf_dir, "embeddings")
    first = v.orderBy("vec_id").limit(1).select(F.lit(0).alias("query_id"), "embedding")
    return b.unionByName(knn.nearest(v, first, 30).select(F.col("query_id").cast("int").alias("query_id"), "id", "score", F.lit("vector").alias("source")))


@query(
    f"""WITH {_TWO_BRANCHES},
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS place FROM h),
f AS (SELECT query_id, id, sum(1 / (60.0 + place)) AS score FROM p GROUP BY ALL)
SELECT id, round(score, 6) AS score FROM f"""
)
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.reciprocal_ranks(_branches(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_TWO_BRANCHES} SELECT id, round(max(score), 4) AS score FROM h GROUP BY id")
def best_score_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.best_scores(_branches(spark, sf_dir)).select("id", F.round("score", 4).alias("score"))


@query(
    """
WITH s AS (SELECT q.vec_id AS query_id, max(1 - list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / 2) AS best
           FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id GROUP BY q.vec_id)
SELECT query_id, round(best, 4) AS similarity, best < 0.518 AS absent FROM s"""
)
def abstain_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _near(spark, sf_dir, "vec_id % 20 = 0", k=1, skip_self=True)
    return best.select("query_id", F.round("score", 4).alias("similarity"), fusion.absent_by_similarity(F.col("score")).alias("absent"))


@query(
    f"""WITH h AS ({_bm25_sql("SELECT item_id AS query_id, replace(text, '_', ' ') AS query FROM eval_items", 2, out="query_id, score, rank")}),
t AS (SELECT query_id, max(score) FILTER (rank = 1) AS a, max(score) FILTER (rank = 2) AS b FROM h GROUP BY query_id)
SELECT item_id AS query_id, CASE WHEN a IS NULL OR a < 0.90 THEN true ELSE coalesce(a - b < 0.0, false) END AS low_confidence FROM eval_items LEFT JOIN t ON query_id = item_id"""
)
def abstain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), F.translate("text", "_", " ").alias("query"))
    return fusion.confidence(B.bm25(_index(spark, sf_dir), B.query_terms(items), 2), items)


@query(
    f"""WITH h AS (SELECT x.*, CASE WHEN d.source = 'session_log' THEN 'project' ELSE 'global' END AS origin
  FROM ({_bm25_sql(_sql_ask(QUESTION), 200, out="query_id, doc_id, score")}) x JOIN documents d USING (doc_id)),
n AS (SELECT *, CASE WHEN max(score) OVER (PARTITION BY origin) > 0 THEN score / max(score) OVER (PARTITION BY origin) ELSE 0 END AS s FROM h),
r AS (SELECT *, row_number() OVER (ORDER BY s DESC, (origin <> 'project')::INT, origin, doc_id) AS rank FROM n)
SELECT doc_id, origin, round(s, 4) AS score, rank FROM r WHERE rank <= 20"""
)
def merge_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = B.bm25(_index(spark, sf_dir), B.query_terms(_ask(spark, QUESTION)), 200).drop("rank")
    source = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("source") == "session_log", "project").otherwise("global").alias("origin"))
    return fusion.merge_origins(hits.join(source, "id"), 20).select(F.col("id").alias("doc_id"), "origin", F.round("score", 4).alias("score"), "rank")


@query(
    f"""WITH h AS ({_bm25_sql(_sql_ask(QUESTION, RUSSIAN), 10, out="query_id, doc_id, score, rank")})
SELECT query_id, rank, doc_id AS id, round(score, 4) AS score, replace(substring(text, 1, 300), chr(10), ' ') AS snippet, score < 0.9 AND rank = 0 AS unused, lang, source
FROM h JOIN documents USING (doc_id)""".replace(", score < 0.9 AND rank = 0 AS unused", "")
)
def search_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search with result rows: snippet and the chunk's other columns."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    corpus = SearchCorpus(docs, _index(spark, sf_dir))
    return search(corpus, _ask(spark, QUESTION, RUSSIAN), 10, "keyword").drop("low_confidence")


@query(
    f"""WITH b AS (SELECT query_id, doc_id AS id, score, 'bm25' AS source FROM ({_bm25_sql(_sql_ask(QUESTION, RUSSIAN), 30)})),
qv AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INT AS query_id, embedding::DOUBLE[] AS e FROM embeddings QUALIFY row_number() OVER (ORDER BY vec_id) <= 2),
s AS (SELECT query_id, vec_id AS id, 1 - list_distance(e, embedding::DOUBLE[]) / 2 AS score FROM qv, embeddings),
h AS (SELECT * FROM b UNION ALL (SELECT *, 'vector' AS source FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 30)),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) AS place FROM h),
f AS (SELECT query_id, id, sum(1 / (60.0 + place)) AS score FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM f QUALIFY rank <= 10),
best AS (SELECT query_id, max(score) AS similarity FROM s GROUP BY query_id)
SELECT query_id, rank, id, round(r.score, 4) AS score, replace(substring(text, 1, 300), chr(10), ' ') AS snippet, similarity < 0.518 AS low_confidence, lang, d.source FROM r JOIN best USING (query_id) LEFT JOIN documents d ON doc_id = id"""
)
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both branches, fusion and abstention; the vectors of the first documents stand for the queries' own."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = _ask(spark, QUESTION, RUSSIAN)
    own = [(i, r["embedding"]) for i, r in enumerate(vectors.orderBy("id").limit(2).collect())]
    q = asked.join(F.broadcast(spark.createDataFrame(own, "query_id int, embedding array<float>")), "query_id")  # two rows
    return search(SearchCorpus(docs, _index(spark, sf_dir), vectors), q, 10)


@query(
    """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, 1 - list_distance(a.v, b.v) / 2 AS s FROM e a JOIN e b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE 1 - list_distance(a.v, b.v) / 2 > 0.45),
m AS (SELECT a, b, s, a AS id, b AS o FROM p UNION ALL SELECT a, b, s, b, a FROM p)
SELECT DISTINCT a, b, round(s, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, o) AS k FROM m) WHERE k <= 3"""
)
def semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every vector its three most similar ones of another owner; the stock threshold finds no pair in this table."""
    v = load(spark, sf_dir, "embeddings").withColumn("owner", F.col("label").cast("string"))
    return knn.semantic_duplicates(v, 0.45, 3).withColumn("score", F.round("score", 4))


@query(
    """
WITH e AS (SELECT chunk_id AS id, min(lower(trim(skill_name))) AS g FROM chunks WHERE skill_name IS NOT NULL GROUP BY chunk_id),
v AS (SELECT DISTINCT ON (chunk_id) chunk_id AS id, g, embedding::DOUBLE[] AS v FROM chunks_vec JOIN e ON e.id = chunk_id WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.id AS i, b.id AS o, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.g <> b.g WHERE list_cosine_similarity(a.v, b.v) > 0.9872),
t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(s, 12) DESC, o) <= 3)
SELECT least(i, o) AS a, greatest(i, o) AS b, round(max(s), 4) AS score FROM t GROUP BY ALL"""
)
def semantic_dedup_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of other skills with nearly the same vector, at the cosine that the stock threshold means for unit vectors."""
    owner = load(spark, sf_dir, "chunks").where("skill_name is not null").groupBy("chunk_id").agg(F.min(F.lower(F.trim("skill_name"))).alias("owner"))
    v = load(spark, sf_dir, "chunks_vec").join(owner, "chunk_id").withColumnRenamed("chunk_id", "vec_id")
    return knn.semantic_duplicates(v, 0.9872, 3, metric="cosine").withColumn("score", F.round("score", 4))
