"""Queries on the state of the index."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksight.operators import incremental, lifecycle
from ranksight.operators.versions import VersionedTable
from ranksight.plans.catalogue import query
from ranksight.runtime import load, materialize, shared_dir, table_dir


def _due_sql(until: str = "2999-01-01") -> str:
    """Items that are due by what was loaded, indexed and started before a time."""
    return rf"""
WITH runs AS (SELECT * FROM index_runs WHERE started_at < TIMESTAMP '{until}'),
rows AS (
  SELECT 'file' AS item_kind, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS item_key, lower(substring(content_hash, 1, 16)) AS mark, indexed_at FROM files
  UNION ALL SELECT 'source', source_key, fingerprint, indexed_at FROM sources),
valid AS (
  SELECT r.* FROM rows r WHERE indexed_at < TIMESTAMP '{until}' AND item_key IS NOT NULL AND
    (SELECT arg_max(coalesce(outcome, ''), (started_at, run_id)) FROM runs u WHERE u.item_kind = r.item_kind AND u.started_at <= r.indexed_at) = 'ok'),
held AS (SELECT item_kind, item_key, mark FROM valid QUALIFY row_number() OVER (PARTITION BY item_kind, item_key ORDER BY indexed_at DESC, mark DESC) = 1),
log AS (
  SELECT item_kind, CASE WHEN item_kind = 'file' THEN regexp_replace(replace(item_key, '\', '/'), '^(\./)+', '') ELSE item_key END AS item_key,
         CASE WHEN item_kind = 'file' THEN lower(substring(seen_mark, 1, 16)) ELSE seen_mark END AS mark, seen_at
  FROM scan_log WHERE item_key IS NOT NULL AND item_kind IS NOT NULL AND coalesce(loaded_at, TIMESTAMP '1970-01-01') < TIMESTAMP '{until}'),
seen AS (SELECT item_kind, item_key, mark FROM log QUALIFY row_number() OVER (PARTITION BY item_kind, item_key ORDER BY mark IS NULL, seen_at DESC NULLS LAST, mark DESC) = 1)
SELECT s.item_kind, s.item_key FROM seen s LEFT JOIN held h ON h.item_kind = s.item_kind AND h.item_key = s.item_key
WHERE h.item_key IS NULL OR (s.mark IS NOT NULL AND s.mark IS DISTINCT FROM h.mark)"""


def _marks(spark: SparkSession, sf_dir: str, until: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(present marks, index marks) by what was loaded, indexed and started before a time."""
    log, files, sources, runs = (load(spark, sf_dir, t) for t in ("scan_log", "files", "sources", "index_runs"))
    if until:
        at = f"< timestamp_ntz'{until}'"
        log = log.where(f"loaded_at is null or loaded_at {at}")
        files, sources, runs = files.where(f"indexed_at {at}"), sources.where(f"indexed_at {at}"), runs.where(f"started_at {at}")
    return incremental.present_marks(log), incremental.index_marks(files, sources, runs)


@query(_due_sql())
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of a data folder stays in the shared folder: a later call writes and judges what has changed since."""
    folder = f"{shared_dir(spark)}/index-plan/{hashlib.sha256(os.path.abspath(sf_dir).encode()).hexdigest()[:16]}"
    return incremental.items_to_index(*(load(spark, sf_dir, t) for t in ("scan_log", "files", "sources", "index_runs")), path=folder)


@query(f"SELECT 1 AS round, item_kind, item_key FROM ({_due_sql('2026-03-12')}) UNION ALL SELECT 3, item_kind, item_key FROM ({_due_sql()})")
def p5_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs on one plan: as of 12 March; as of 20 March, a run that dies before its output is committed; and now."""
    folder = f"{table_dir(spark)}/rounds-{uuid.uuid4().hex}"

    def run(until: str | None, dies: bool = False) -> DataFrame | None:
        plan = incremental.IndexPlan(spark, folder)  # a new process each time
        seen, held = _marks(spark, sf_dir, until)
        plan.see(seen)
        plan.hold(held)
        if dies:
            plan.waiting.write(seen)  # files without a manifest
            return None
        return plan.due()

    first = materialize(run("2026-03-12"), "first_round")
    run("2026-03-20", dies=True)
    last = run(None)
    return first.select(F.lit(1).alias("round"), "*").unionByName(last.select(F.lit(3).alias("round"), "*"))


_FILES = r"SELECT regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS path, max(struct_pack(at := indexed_at, mark := lower(substring(content_hash, 1, 16)))) AS last FROM files WHERE path IS NOT NULL"


def _file_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Marks of files as the index had them up to mid-March, and as it has them now."""
    f = load(spark, sf_dir, "files").where("path is not null").select(incremental.file_key(F.col("path")).alias("path"), F.struct("indexed_at", incremental.file_mark(F.col("content_hash")).alias("mark")).alias("last"))
    newest = lambda rows: rows.groupBy("path").agg(F.max("last").alias("last")).select("path", "last.mark")
    return newest(f.where("last.indexed_at < timestamp_ntz'2026-03-15'")), newest(f)


@query(
    f"""WITH a AS ({_FILES} GROUP BY 1), b AS ({_FILES} AND indexed_at < TIMESTAMP '2026-03-15' GROUP BY 1)
SELECT path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'removed' WHEN a.last.mark IS NOT DISTINCT FROM b.last.mark THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b USING (path)""".replace("b.path IS NULL", "b.last IS NULL").replace("a.path IS NULL", "a.last IS NULL")
)
def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, now = _file_states(spark, sf_dir)
    return lifecycle.diff(now, stored, ["path"], "mark")


@query(
    f"""WITH a AS ({_FILES} GROUP BY 1), b AS ({_FILES} AND indexed_at < TIMESTAMP '2026-03-15' GROUP BY 1)
SELECT count(*) FILTER (b.last IS NULL) AS new, count(*) FILTER (a.last IS NOT NULL AND b.last IS NOT NULL AND a.last.mark IS DISTINCT FROM b.last.mark) AS changed,
 count(*) FILTER (a.last IS NULL) AS removed, count(*) FILTER (a.last.mark IS NOT DISTINCT FROM b.last.mark AND a.last IS NOT NULL AND b.last IS NOT NULL) AS same FROM a FULL JOIN b USING (path)"""
)
def index_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, now = _file_states(spark, sf_dir)
    return lifecycle.freshness(now, stored, ["path"], "mark")


@query("SELECT chunk_id, file_path FROM chunks WHERE file_path IN (SELECT path FROM files)")
def collect_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "files").select(F.col("path").alias("file_path"))
    return lifecycle.collect_garbage(load(spark, sf_dir, "chunks").select("chunk_id", "file_path"), files, ["file_path"])


@query("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY updated_at DESC NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 200000")
def budget_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars", "updated_at")
    return lifecycle.soft_budget(docs, "n_chars", [F.desc_nulls_last("updated_at"), F.col("doc_id")], 200_000).select("doc_id", "n_chars")


@query(
    """WITH RECURSIVE o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY updated_at DESC NULLS LAST, doc_id) AS i FROM documents),
fit AS (SELECT i, doc_id, n_chars, 20000 - n_chars AS rest, true AS taken FROM o WHERE i = 1
  UNION ALL SELECT o.i, o.doc_id, o.n_chars, CASE WHEN o.n_chars <= rest THEN rest - o.n_chars ELSE rest END, o.n_chars <= rest AND rest > 0 FROM fit JOIN o ON o.i = fit.i + 1)
SELECT doc_id, n_chars FROM fit WHERE taken"""
)
def budget_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars", "updated_at")
    return lifecycle.hard_budget(docs, "n_chars", [F.desc_nulls_last("updated_at"), F.col("doc_id")], 20_000).select("doc_id", "n_chars")


@query("SELECT DISTINCT chunk_id, content_hash FROM chunks WHERE content_hash IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE length(trim(coalesce(heading, ''))) = 0)")
def replaced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live rows of a versioned table after a commit that dropped the chunks without a heading."""
    chunks = load(spark, sf_dir, "chunks")
    rows = chunks.where("content_hash is not null").select("chunk_id", "content_hash").distinct()
    table = VersionedTable(spark, f"{table_dir(spark)}/chunks-{uuid.uuid4().hex}", "chunk_id bigint, content_hash string")
    table.commit(rows)
    lifecycle.replace_chunks(table, chunks.where("length(trim(coalesce(heading, ''))) = 0"), rows.limit(0), ["chunk_id"])
    return table.snapshot()
