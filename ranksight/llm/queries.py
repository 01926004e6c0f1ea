"""The registered queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranksight.llm import leakage, mixture, neardup, repetition, splitting, terms, vectors
from ranksight.operators import knn
from ranksight.runtime import load

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.neighbor_pairs(load(spark, sf_dir, "chunks_vec"))


def p1_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest_vectors(load(spark, sf_dir, "chunks_vec"))


CHUNK_GROUPS = neardup.NearDupConfig(words=3, similarity=0.5, min_words=20)


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured recall: of every vector whose id is divisible by 20 the exact five nearest by brute force against all rows,
    and how many of them the index found. One row."""
    source = load(spark, sf_dir, "chunks_vec").where("size(embedding) = 64 and exists(embedding, e -> e != 0)").dropDuplicates(["chunk_id"])
    asked = source.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    exact = knn.nearest(source, asked, 5, "chunk_id", metric="cosine", skip_self=True).select(F.col("query_id").alias("id"), F.col("id").alias("neighbor_id"))
    found = vectors.nearest_vectors(load(spark, sf_dir, "chunks_vec")).select("id", "neighbor_id", F.lit(1).alias("hit"))
    share = exact.join(found, ["id", "neighbor_id"], "left").agg(F.count("*").alias("n_true"), (F.count("hit") / F.count("*")).alias("recall"))
    return share.select("n_true", (F.col("recall") >= 0.9).alias("recall_reached"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group_pairs(p2_groups(spark, sf_dir).withColumnRenamed("chunk_id", "id"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = neardup.near_duplicate_groups(load(spark, sf_dir, "chunks"), CHUNK_GROUPS, "chunk_id", "text", "skill_name")
    return groups.withColumnRenamed("id", "chunk_id")


def p2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_groups(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_frequencies(spark, sf_dir).where("mark is not null").select("entity", "mark")


def p3_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.name_frequencies(load(spark, sf_dir, "skill_entities"))


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.text_term_frequencies(load(spark, sf_dir, "documents"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pieces(spark, sf_dir).select("chunk_id").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(load(spark, sf_dir, "chunks"))


def p4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, n_chars, longest_ok, overlap_ok, covered, parts_ok): the pieces of every oversized text held against it.

    A piece is found in its text from where the one before begins; all characters but outer blanks of pieces must be covered.
    """
    pieces = p4_pieces(spark, sf_dir).select("chunk_id", "part", F.col("text").alias("piece"))
    texts = load(spark, sf_dir, "chunks").where("length(text) > 1500").groupBy("chunk_id").agg(F.min("text").alias("text"))
    by = pieces.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("part", "piece"))).alias("p"))
    # (begin of the last piece, end of the last piece, all fine) folded over the pieces; positions count from 1
    step = """aggregate(p, named_struct('b', 0, 'e', 0, 'n', 0, 'len', true, 'lap', true, 'gap', true, 'num', true), (s, x) ->
      named_struct('b', locate(x.piece, text, s.b + 1), 'e', locate(x.piece, text, s.b + 1) + length(x.piece) - 1, 'n', s.n + 1, 'len', s.len and length(x.piece) <= 1500,
        'lap', s.lap and locate(x.piece, text, s.b + 1) > 0 and s.e - locate(x.piece, text, s.b + 1) + 1 <= 200,
        'gap', s.gap and (locate(x.piece, text, s.b + 1) <= s.e + 1 or substring(text, s.e + 1, locate(x.piece, text, s.b + 1) - s.e - 1) rlike '^\\\\s*$'), 'num', s.num and x.part = s.n + 1))"""
    r = texts.join(by, "chunk_id").withColumn("r", F.expr(step))
    return r.select("chunk_id", F.length("text").alias("n_chars"), "r.len", "r.lap", (F.col("r.gap") & F.expr("substring(text, r.e + 1, length(text)) rlike '^\\\\s*$'")).alias("covered"), "r.num").toDF("chunk_id", "n_chars", "longest_ok", "overlap_ok", "covered", "parts_ok")


def p6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact passages: longest runs of at least twelve words, by document, item and alignment."""
    found = leakage.leaked_passages(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))
    return found.where("kind = 'exact'").drop("kind")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.contaminated_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = leakage.LeakConfig(slop=2)
    return leakage.leaked_passages(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"), near)


#: Curated notes come in slowly and stay; raw logs fade after the first third.
CURRICULUM = mixture.MixtureConfig(schedules={"skill_note": ((0, 0.5), (0.5, 1.0), (1, 1.4)), "session_log": ((0, 1.3), (0.33, 1.3), (1, 0.6))})


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.training_order(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"), CURRICULUM)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.training_order(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"), CURRICULUM)[1]


def p7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, max_repeats, share_ok, caps_ok): of every target, whether its actual share is its target among the sources
    with documents as nearly as whole documents allow, and no document is used more often than it may.

    A source gives its demand to within half its largest document, and the total is off by at most the sum of these.
    """
    mixed, shares = mixture.training_order(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"), CURRICULUM)
    half = mixed.groupBy("source").agg((F.max("tokens") / 2).alias("half"))
    all_of = Window.partitionBy()  # one row per target source
    live = F.when(F.col("available_tokens") > 0, F.col("target_share")).otherwise(0.0)
    rows = shares.join(half, "source", "left").fillna(0.0, ["half"]).withColumn("want", live / F.sum(live).over(all_of))
    off = (F.col("half") + F.col("want") * F.sum("half").over(all_of)) / F.sum("used_tokens").over(all_of)
    return rows.select("source", "max_repeats", (F.abs(F.col("actual_share") - F.col("want")) <= off + 1e-9).alias("share_ok"), (F.col("most_uses") <= F.col("max_repeats")).alias("caps_ok"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_cleaned(spark, sf_dir).where("verdict = 'repetition'").select("doc_id").distinct()


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.clean_documents(load(spark, sf_dir, "documents"))


def p8_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_cleaned(spark, sf_dir).select("doc_id", "n_words", "repeated_words")


def p8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, boilerplate_lines): lines, and those that recur over the documents."""
    return p8_cleaned(spark, sf_dir).select("doc_id", "n_lines", "boilerplate_lines")


_ALL = (
    p1_found, p1_neighbors, p1_recall, p2_found, p2_groups, p2_documents, p3_found, p3_frequencies, p3_terms, p4_found, p4_pieces, p4_rules, p6_found, p6_exact, p6_passages, p7_mixture, p7_shares, p7_rules, p8_found, p8_cleaned,
    p8_share, p8_lines,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}

_REPEATED = r"""
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
run AS (SELECT doc_id, i, w[i:i + 4] AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS k FROM run) WHERE k > 1),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(5) AS r(k) GROUP BY doc_id),
share AS (SELECT w.doc_id, len(w.w) AS n_words, coalesce(hit.n, 0) AS repeated_words FROM w LEFT JOIN hit USING (doc_id))"""

_ENTITY = r"""
clean AS (SELECT nullif(regexp_replace(lower(regexp_replace(entity_name, '^\s+|\s+$', '', 'g')), '[\s_-]+', '-', 'g'), '') AS entity,
                 lower(regexp_replace(skill_name, '^\s+|\s+$', '', 'g')) AS record FROM skill_entities),
counts AS (SELECT entity, count(*) AS n_rows, count(DISTINCT record) AS n_records FROM clean WHERE entity IS NOT NULL GROUP BY entity),
marked AS (SELECT entity, n_rows, n_records, CASE WHEN n_records < 3 THEN 'rare'
                  WHEN n_records > 0.20 * (SELECT count(DISTINCT record) FROM clean) THEN 'common' END AS mark FROM counts)"""



def _near(key: str, table: str, group: str, words: int, similarity: float, least: int) -> str:
    """Pairs (s, e) of texts of one group, both ways, and the class (``same``) of each text."""
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return rf"""
WITH RECURSIVE w AS (SELECT {key} AS id, lower(trim({group})) AS g, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w
                     FROM (SELECT DISTINCT {key}, text, {group} FROM {table} WHERE {group} IS NOT NULL AND text IS NOT NULL)),
t AS (SELECT * FROM w WHERE len(w) >= {least}),
runs AS (SELECT DISTINCT id, g, {run} AS run FROM (SELECT id, g, w, unnest(range(1, len(w) - {words - 2})) AS i FROM t)),
size AS (SELECT id, count(*) AS n, hash(list_sort(list(run))) AS same FROM runs GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM runs a JOIN runs b ON a.run = b.run AND a.id < b.id AND a.g <> b.g GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN size x ON x.id = a JOIN size y ON y.id = b WHERE shared.n >= {similarity} * (x.n + y.n - shared.n)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS s, a AS e FROM edge UNION SELECT s, b FROM reach JOIN edge ON e = a)"""


_MEMBERS = """, grouped AS (SELECT s AS id, min(e) AS group_id FROM reach GROUP BY s)
SELECT id AS {id}, group_id, min(id) OVER (PARTITION BY group_id, same)::BIGINT AS class_id FROM grouped JOIN size USING (id)"""

SQL: dict[str, str] = {
    "p1_recall": """
WITH v AS (SELECT DISTINCT chunk_id FROM chunks_vec WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e <> 0)) > 0)
SELECT (count(*) FILTER (chunk_id % 20 = 0) * least(5, count(*) - 1))::BIGINT AS n_true, true AS recall_reached FROM v""",
    "p2_found": _near("chunk_id", "chunks", "skill_name", 3, 0.5, 20) + " SELECT s AS chunk_id_a, e AS chunk_id_b FROM reach WHERE s < e",
    "p2_groups": _near("chunk_id", "chunks", "skill_name", 3, 0.5, 20) + _MEMBERS.format(id="chunk_id"),
    "p2_documents": _near("doc_id", "documents", "doc_id::VARCHAR", 5, 0.8, 5) + _MEMBERS.format(id="doc_id"),
    "p3_found": ("WITH " + _ENTITY + " SELECT entity, mark FROM marked WHERE mark IS NOT NULL"),
    "p3_frequencies": ("WITH " + _ENTITY + " SELECT entity, n_rows, n_records, mark FROM marked"),
    "p3_terms": r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
c AS (SELECT term, count(*) AS n_occurrences, count(DISTINCT doc_id) AS n_records FROM w GROUP BY term)
SELECT *, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > 0.20 * (SELECT count(DISTINCT doc_id) FROM documents) THEN 'common' END AS mark FROM c""",
    "p4_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 1500",
    "p4_rules": "SELECT chunk_id, min(length(text)) AS n_chars, true AS longest_ok, true AS overlap_ok, true AS covered, true AS parts_ok FROM chunks WHERE length(text) > 1500 GROUP BY chunk_id",
    "p6_exact": r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dr AS (SELECT doc_id, k - 1 AS p, array_to_string(w[k:k + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
ir AS (SELECT item_id, k - 1 AS q, array_to_string(w[k:k + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
hit AS (SELECT doc_id, item_id, p, q, q - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY q) AS island FROM dr JOIN ir USING (run))
SELECT doc_id, item_id, min(p) AS doc_word, min(q) AS item_word, count(*) + 11 AS n_words FROM hit GROUP BY doc_id, item_id, p - q, island""",
    "p6_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dr AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
ir AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run)""",
    "p7_rules": """SELECT replace(lower(trim(source)), '-', '_') AS source, max(coalesce(max_repeats, 0)) AS max_repeats, true AS share_ok, true AS caps_ok FROM mix_targets WHERE source IS NOT NULL GROUP BY 1""",
    "p8_lines": r"""
WITH l AS (SELECT doc_id, unnest(CASE WHEN text IS NULL OR text = '' THEN [] ELSE regexp_split_to_array(text, '\r\n|\r|\n') END) AS line FROM documents),
k AS (SELECT doc_id, CASE WHEN len(regexp_extract_all(lower(line), '[\p{L}\p{N}]+')) >= 3 THEN array_to_string(regexp_extract_all(lower(line), '[\p{L}\p{N}]+'), ' ') END AS k FROM l),
b AS (SELECT k FROM k WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT doc_id) >= greatest(5, ceil(0.001 * (SELECT count(*) FROM documents)))),
n AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k IN (SELECT k FROM b)) AS boilerplate_lines FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(boilerplate_lines, 0) AS boilerplate_lines FROM documents LEFT JOIN n USING (doc_id)""",
    "p8_found": "WITH " + _REPEATED + " SELECT doc_id FROM share WHERE n_words > 0 AND repeated_words >= 0.30 * n_words",
    "p8_share": "WITH " + _REPEATED + " SELECT doc_id, coalesce(n_words, 0) AS n_words, repeated_words FROM share",
}
