"""Queries of text functions, chunking, sessions, graph, checks and counts over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranksight.functions import text as T
from ranksight.functions.comments import chunk_sources
from ranksight.functions.markdown import chunk_files
from ranksight.functions.stem import stem_column
from ranksight.operators import filters, graph, lifecycle, quality, tasks
from ranksight.plans.catalogue import query
from ranksight.runtime import load, spread
from ranksight.settings import AGENTS
from ranksight.sources import sessions
from ranksight.streaming import incremental

_CLEAN = r"trim(regexp_replace({0}, '[\s\p{{Z}}\x1c-\x1f\x85]+', ' ', 'g'))"


def _clean(c: str) -> str:
    return _CLEAN.format(c)


@query(f"SELECT doc_id, {_clean('text')} AS text FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text")).alias("text"))


_JUNK = "(length(trim(coalesce({0}, ''))) < 30 OR regexp_matches(ltrim(coalesce({0}, '')), '^<(system|skill-loaded|cron-fire)') OR contains(lower(coalesce({0}, '')), 'context has been compacted'))"


@query(f"SELECT doc_id, {_JUNK.format('text')} AS junk FROM documents")
def junk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.is_junk(F.col("text")).alias("junk"))


@query(
    f"""
WITH c AS (SELECT doc_id, {_clean('text')} AS t FROM documents), k AS (SELECT * FROM c WHERE NOT {_JUNK.format('t')}),
w AS (SELECT doc_id, t, unnest(CASE WHEN length(t) <= 1500 THEN [0] ELSE range(0, length(t), 1300) END) AS i FROM k),
p AS (SELECT doc_id, i, trim(substring(t, i + 1, 1500)) AS text FROM w)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, text FROM p WHERE length(text) >= 20"""
)
def sliding_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.window_chunks(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"], ["doc_id"])


@query("SELECT doc_id, substring(sha256(text), 1, 16) AS hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query("SELECT doc_id, length(regexp_replace(text, '[^Ѐ-ӿ]', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS cyrillic FROM documents")
def script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.is_cyrillic(F.col("text")).alias("cyrillic"))


_OWNER = """CASE WHEN NOT contains(file_path, '/') THEN '(root)' WHEN split_part(file_path, '/', 1) = 'tools' THEN 'skills-tools'
 WHEN split_part(file_path, '/', 1) = 'streams' AND len(string_split(file_path, '/')) > 2 THEN 'streams/' || split_part(file_path, '/', 2) ELSE split_part(file_path, '/', 1) END"""


@query(f"SELECT DISTINCT file_path, {_OWNER} AS owner FROM chunks WHERE file_path IS NOT NULL")
def owner_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "chunks").where("file_path is not null").select("file_path", T.owner_of(F.col("file_path")).alias("owner")).distinct()


@query("SELECT chunk_id, replace(substring(text, 1, 300), chr(10), ' ') AS snippet FROM chunks")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "chunks").select("chunk_id", T.snippet(F.col("text")).alias("snippet"))


@query(
    r"""SELECT p.plane, count(*) AS n FROM chunks, (SELECT unnest(['knowledge', 'skills', 'streams', 'tasks', 'all']) AS plane) p
WHERE CASE p.plane WHEN 'all' THEN true
  WHEN 'tasks' THEN file_path GLOB 'tasks/[0-9]*.md' OR file_path GLOB 'tasks/archive/*' OR file_path = 'tasks/reviews.md'
  WHEN 'streams' THEN file_path GLOB 'streams/*'
  WHEN 'skills' THEN NOT (file_path GLOB 'streams/*' OR file_path GLOB 'tasks/[0-9]*.md' OR file_path GLOB 'tasks/archive/*' OR file_path = 'tasks/reviews.md')
  ELSE NOT (file_path GLOB 'tasks/[0-9]*.md' OR file_path GLOB 'tasks/archive/*' OR file_path = 'tasks/reviews.md') END GROUP BY p.plane"""
)
def plane_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = ("knowledge", "skills", "streams", "tasks", "all")
    hit = [F.when(filters.in_plane(F.col("file_path"), p), F.lit(p)) for p in planes]
    chunks = load(spark, sf_dir, "chunks")
    return chunks.select(F.explode(F.array_compact(F.array(*hit))).alias("plane")).groupBy("plane").agg(F.count("*").alias("n"))


@query("SELECT source_key, agent, chunk_count FROM sources WHERE agent = 'claude' AND epoch(indexed_at) >= epoch(TIMESTAMP '2026-03-10') AND contains(lower(src_path), 'transcripts')")
def session_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "sources").withColumn("ts", F.unix_micros(F.col("indexed_at").cast("timestamp")) / 1e6)
    return s.where(filters.session_filter("claude", "2026-03-10", "Transcripts", folder="src_path")).select("source_key", "agent", "chunk_count")


@query("SELECT user_id, count(*) AS msg_count, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(event_type, event_id) AS first_type FROM events GROUP BY user_id")
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("msg_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("event_type", "event_id").alias("first_type"))


@query("SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events QUALIFY back <= 20")
def session_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty events of every user: a report of the newest rows."""
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", back.alias("back")).where("back <= 20")


@query("SELECT agent, source_key, src_path, chunk_count FROM sources WHERE chunk_count = 0")
def empty_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "sources").where("chunk_count = 0").select("agent", "source_key", "src_path", "chunk_count")


@query(
    """SELECT (SELECT count(*) FROM chunks) AS chunk_rows, (SELECT count(DISTINCT chunk_id) FROM chunks) AS chunks, (SELECT count(DISTINCT file_path) FROM chunks) AS files,
(SELECT count(DISTINCT chunk_id) FROM chunks_vec WHERE embedding IS NOT NULL) AS vectors, (SELECT coalesce(sum(chunk_count), 0)::BIGINT FROM sources) AS session_chunks"""
)
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "chunks").agg(F.count("*").alias("chunk_rows"), F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("file_path").alias("files"))
    b = load(spark, sf_dir, "chunks_vec").where("embedding is not null").agg(F.countDistinct("chunk_id").alias("vectors"))
    c = load(spark, sf_dir, "sources").agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("session_chunks"))
    return a.crossJoin(b).crossJoin(c)  # one row each


@query("SELECT lower(trim(skill_name)) AS skill, count(DISTINCT chunk_id) AS n FROM chunks WHERE skill_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, skill LIMIT 10")
def top_owner_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "chunks").where("skill_name is not null").select(F.lower(F.trim("skill_name")).alias("skill"), "chunk_id")
    return c.groupBy("skill").agg(F.countDistinct("chunk_id").alias("n")).orderBy(F.desc("n"), "skill").limit(10)


@query("WITH k AS (SELECT unnest(['kimi-code', 'kimi-cli', 'claude', 'omp', 'none']) AS agent), n AS (SELECT agent, count(*) AS n FROM sources GROUP BY agent) SELECT agent, coalesce(n, 0) AS n FROM k FULL JOIN n USING (agent)")
def zero_filled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.zero_filled(load(spark, sf_dir, "sources"), "agent", (*AGENTS, "none"))


_EDGES = "e AS (SELECT DISTINCT 'p' || l_partkey AS source, 's' || l_suppkey AS target FROM lineitem)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target")).distinct()


@query(f"WITH {_EDGES} SELECT name, count(*) AS n FROM (SELECT source AS name FROM e UNION ALL SELECT target FROM e) GROUP BY name")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    entities = edges.select(F.col("source").alias("name")).union(edges.select("target")).distinct().withColumn("type", F.lit(None).cast("string"))
    return graph.degrees(entities, edges).select("name", "n")


@query(
    """
WITH e AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target FROM nation UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)
SELECT DISTINCT a.source AS name, 'out' AS direction, a.target AS via, b.target AS other FROM e a JOIN e b ON a.target = b.source WHERE a.source <> b.target
UNION SELECT DISTINCT a.target, 'in', a.source, b.source FROM e a JOIN e b ON a.source = b.target WHERE a.target <> b.source"""
)
def graph_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda t, a, ka, b, kb: load(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("source"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("target"))
    edges = pair("nation", "n", "n_nationkey", "r", "n_regionkey").unionByName(pair("supplier", "s", "s_suppkey", "n", "s_nationkey")).unionByName(pair("customer", "c", "c_custkey", "n", "c_nationkey"))
    ends = edges.select(F.col("source").alias("name")).union(edges.select("target")).distinct()
    return graph.two_hops(edges, ends)


@query(
    r"""
WITH m AS (SELECT DISTINCT lower(trim(skill_name)) AS skill_name, trim(entity_name) AS entity_name FROM skill_entities WHERE skill_name IS NOT NULL AND trim(entity_name) <> ''),
c AS (SELECT entity_name, count(*) AS n FROM m GROUP BY entity_name HAVING count(*) >= 3)
SELECT entity_name, n FROM c WHERE length(entity_name) >= 3 AND NOT (entity_name = upper(entity_name) AND regexp_matches(entity_name, '[Ѐ-ӿ]') AND length(entity_name) <= 6) AND lower(entity_name) NOT IN ('report', 'python', 'docker', 'kubernetes', 'k8s')
 AND 'entity-' || replace(lower(entity_name), ' ', '-') NOT IN (SELECT skill_name FROM m)"""
)
def uncovered_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "skill_entities").select(F.lower(F.trim("skill_name")).alias("skill_name"), F.trim("entity_name").alias("entity_name")).where("entity_name != ''")
    names = m.where("skill_name is not null").select(F.col("skill_name").alias("name")).distinct()
    return graph.uncovered_entities(m, names).select("entity_name", "n")


@query(
    """
SELECT 'no_heading' AS rule, chunk_id::VARCHAR AS subject, NULL::VARCHAR AS detail FROM chunks WHERE length(trim(coalesce(heading, ''))) = 0
UNION ALL SELECT 'no_skill', chunk_id::VARCHAR, NULL FROM chunks WHERE length(trim(coalesce(skill_name, ''))) = 0
UNION ALL SELECT DISTINCT 'index_drift', file_path, 'not indexed' FROM chunks WHERE file_path NOT IN (SELECT path FROM files WHERE path IS NOT NULL)
UNION ALL SELECT DISTINCT 'index_drift', path, 'no file' FROM files WHERE path NOT IN (SELECT file_path FROM chunks WHERE file_path IS NOT NULL)
UNION ALL SELECT 'stream_no_readme', s, NULL FROM (SELECT 'streams/' || split_part(file_path, '/', 2) AS s, max((split_part(file_path, '/', 3) = 'README.md')::INT) AS r
  FROM chunks WHERE starts_with(file_path, 'streams/') AND len(string_split(file_path, '/')) > 2 GROUP BY 1) WHERE r = 0"""
)
def lint_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = load(spark, sf_dir, "chunks"), load(spark, sf_dir, "files").where("path is not null")
    paths = c.where("file_path is not null").select(F.col("file_path").alias("path"))
    return (
        quality.missing(c, "no_heading", "chunk_id", "heading").unionByName(quality.missing(c, "no_skill", "chunk_id", "skill_name"))
        .unionByName(quality.index_drift(paths, f)).unionByName(quality.streams_without_readme(paths))
    )


@query(
    """SELECT o_orderkey AS id, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END, strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) AS place FROM orders"""
)
def task_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every row in the order of priority, date and id, counted over a range-sorted table."""

    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("deadline"))
    keys = tasks.order("priority", ("1-URGENT", "2-HIGH", "3-MEDIUM"))
    return lifecycle.places(o, keys).select("id", "place")


@query("SELECT field, value, count(*) AS n FROM (SELECT 'status' AS field, o_orderstatus AS value FROM orders UNION ALL SELECT 'priority', o_orderpriority FROM orders) GROUP BY ALL")
def task_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return tasks.group_counts(o, ("status", "priority"))


@query(
    """WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS s, date_diff('day', o_orderdate::DATE, DATE '1998-08-02') AS days FROM orders)
SELECT id, 'overdue' AS problem, days FROM a WHERE s = 'O' AND days >= 700 UNION ALL SELECT id, 'soon', days FROM a WHERE days BETWEEN 0 AND 7"""
)
def task_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    rules = {"overdue": (F.col("status") == "O", "date", 700, None), "soon": (F.lit(True), "date", 0, 7)}
    return tasks.date_problems(o, F.lit("1998-08-02").cast("date"), rules).withColumn("days", F.col("days").cast("long"))


@query("SELECT coalesce(max(o_orderkey), 0) + 1 AS next_id FROM orders")
def task_next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.next_id(load(spark, sf_dir, "orders"), F.col("o_orderkey"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.event_windows(load(spark, sf_dir, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS with_k FROM events GROUP BY user_id")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").alias("k"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count("k").alias("with_k"))


@query()
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    return chunk_files(spread(docs))


@query()
def comment_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = load(spark, sf_dir, "documents").select(F.concat(F.lit("code/"), F.col("doc_id").cast("string"), F.lit(".sql")).alias("path"), F.col("text").alias("content"), "source")
    return chunk_sources(code.where(F.lower(F.trim("source")).rlike("^code[-_]comments$")))


@query()
def stemmed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", stem_column(F.col("text")).alias("stemmed"))
