"""The three indexes of the engine behind one interface: knowledge base, project tree, session logs.

An index is a store of versioned tables: chunks, their postings and lengths (the inverted index), and the files or
sources they come from. An index run reads the files, diffs their marks against the store and publishes the rows of new
and changed files together with the removal of old ones in one commit. Searches read the postings of the newest version.
"""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranksight.functions.comments import chunk_sources
from ranksight.functions.markdown import chunk_files
from ranksight.functions.stem import stem_column
from ranksight.functions.text import display_name, is_junk
from ranksight.operators import filters, fusion, lifecycle
from ranksight.operators.bm25 import InvertedIndex, index_tables, postings_of
from ranksight.operators.search import Embedder, SearchCorpus, embed, search
from ranksight.operators.versions import Store, VersionedTable
from ranksight.runtime import materialize, ship
from ranksight.settings import AGENTS, KB, KINDS, MODES, PLANES, PROJECT, SESSIONS, SearchProfile
from ranksight.sources import sessions as logs
from ranksight.sources import trees

_CHUNKS = "id long, path string, mark string, kind string, line int, skill string, heading string, heading_chain array<string>, part int, text string, stemmed string, embedding array<float>"
_FILES = "path string, mark string, chunks long"
_INVERTED = {"postings": "term string, id long, tf long, positions array<int>", "lengths": "id long, dl int"}


def _rows_of(table: VersionedTable, keys: DataFrame, on: str) -> DataFrame:
    """Places of the rows of a table that have one of the keys."""
    return table.snapshot(positions=True).join(keys, on, "left_semi").select("_file", "_row")


def _inverted(store: Store, added: DataFrame, gone: DataFrame, others: tuple[str, ...]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """What a change of chunks does to the inverted index; ``gone`` (id) are the chunks that go."""
    lengths, words = index_tables(added, "id", F.col("stemmed"), others)
    return {"postings": (postings_of(words), _rows_of(store["postings"], gone, "id")), "lengths": (lengths, _rows_of(store["lengths"], gone, "id"))}


def _index_of(store: Store) -> InvertedIndex:
    return InvertedIndex.stored(store["lengths"].snapshot(), store["postings"].snapshot())


def _asked(spark: SparkSession, queries: list[str], embedder: Embedder | None, mode: str, chunks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Queries and, where there is an embedder and the mode wants them, their vectors and those of the chunks."""
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    if not embedder or mode == "keyword":
        return asked, None
    return embed(asked, embedder, "query"), chunks.where("embedding is not null").select("id", "embedding")


class TextIndex:
    """Chunks and files of one corpus below ``path``. ``embedder`` None means keyword search only."""

    profile: SearchProfile = KB

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None) -> None:
        ship(spark)
        self.spark, self.path, self.embedder = spark, path, embedder

    @property
    def store(self) -> Store:
        """The tables of the newest rebuild, or those at ``path`` itself before the first."""
        return Store(self.spark, lifecycle.current(self.spark, self.path) or self.path, {"chunks": _CHUNKS, "files": _FILES, **_INVERTED})

    @property
    def chunks(self) -> VersionedTable:
        return self.store["chunks"]

    @property
    def files(self) -> VersionedTable:
        return self.store["files"]

    def _scan(self, root: str) -> DataFrame:
        """(path, content, mark, kind, modified_ns) of the files to index."""
        return trees.markdown_files(trees.read_tree(self.spark, root, "*.md")).select("path", "content", F.col("content_hash").alias("mark"), F.lit("skill").alias("kind"), "modified_ns")

    def _chunk(self, files: DataFrame) -> DataFrame:
        """Columns of the chunk table but id, stemmed and embedding, and text_for_embedding."""
        made = chunk_files(files, keep=("path", "mark", "kind"))
        return made.withColumn("line", F.lit(None).cast("int")).drop("file_path")

    def index(self, root: str, budget: int | None = None) -> dict[str, int]:
        """Index new and changed files and forget removed ones. With a ``budget`` of chunks, newest files first, first fit.

        Files that lose all their chunks lose their old ones too. Returns counts; a run with nothing to do commits nothing.
        """
        store = self.store
        base = store.version()
        current = self._scan(root)
        stored = store["files"].snapshot(base)
        # files may change while the run goes on: what differs, and the texts to index, are each read once
        state = materialize(lifecycle.diff(current.select("path", F.concat_ws(":", "kind", "mark").alias("mark")), stored.select("path", "mark"), ["path"], "mark"), "file_states")
        fresh = materialize(current.join(state.where("state in ('new', 'changed')"), "path", "left_semi"), "fresh_files")
        chunks = materialize(self._chunk(fresh), "fresh_chunks")
        counted = fresh.select("path", "kind", "mark", "modified_ns").join(chunks.groupBy("path").agg(F.count("*").alias("chunks")), "path", "left").fillna(0, ["chunks"])
        remaining = 0
        if budget is not None:
            taken = lifecycle.hard_budget(counted, "chunks", [F.desc("modified_ns"), F.col("path")], budget)
            remaining = counted.join(taken.select("path"), "path", "left_anti").agg(F.coalesce(F.sum("chunks"), F.lit(0))).first()[0]
            counted, chunks = taken, chunks.join(taken.select("path"), "path", "left_semi")
        rows = {r["state"]: r["n"] for r in state.groupBy("state").agg(F.count("*").alias("n")).collect()}  # four states
        out = {"new": rows.get("new", 0), "changed": rows.get("changed", 0), "removed": rows.get("removed", 0), "remaining_chunks": remaining}
        if not out["new"] + out["changed"] + out["removed"]:
            return out
        place = F.row_number().over(Window.partitionBy("path").orderBy("line", "part", "heading", "text"))  # the same in every run
        stored_chunks = chunks.withColumn("id", F.xxhash64("path", "mark", place)).withColumn("stemmed", stem_column(F.col("text"), self.profile.analyzer == "identifiers"))
        stored_chunks = embed(stored_chunks, self.embedder, "text_for_embedding") if self.embedder else stored_chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
        stored_chunks = materialize(stored_chunks, "stored_chunks")  # vectors are made once for all tables
        touched = materialize(state.where("state = 'removed'").select("path").unionByName(counted.select("path")), "touched")
        old = store["chunks"].snapshot(base, positions=True).join(touched, "path", "left_semi")
        done = counted.select("path", F.concat_ws(":", "kind", "mark").alias("mark"), "chunks")
        store.commit(
            {
                "chunks": (stored_chunks, old.select("_file", "_row")),
                "files": (done, _rows_of(store["files"], touched, "path")),
                **_inverted(store, stored_chunks, materialize(old.select("id"), "gone"), ("skill", "heading")),
            },
            base=base,
        )
        return out

    def status(self, root: str) -> DataFrame:
        """One row: files, chunks, vectors, and how many files are new, changed, removed and same."""
        c = self.chunks.snapshot().agg(F.count("*").alias("chunks"), F.countDistinct("path").alias("files"), F.count("embedding").alias("vectors"))
        now = self._scan(root).select("path", F.concat_ws(":", "kind", "mark").alias("mark"))
        return c.crossJoin(lifecycle.freshness(now, self.files.snapshot(), ["path"], "mark"))  # one row each

    def reindex(self, root: str) -> TextIndex:
        """A full rebuild beside the old version; searches, also of other objects on this path, see it when it is complete."""

        def build(path: str) -> None:
            fresh = copy.copy(self)
            fresh.path = path
            fresh.index(root)

        with lifecycle.RebuildLock(self.spark, self.path):
            lifecycle.publish(self.spark, self.path, build)
        return self

    def _search(self, queries: list[str], k: int, mode: str, allowed: DataFrame | None, scorer: fusion.Scorer | None) -> DataFrame:
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        store = self.store
        c = store["chunks"].snapshot()
        asked, vectors = _asked(self.spark, queries, self.embedder, mode, c)
        return search(SearchCorpus(c.drop("embedding", "stemmed", "mark"), _index_of(store), vectors), asked, k, mode, self.profile, allowed, scorer, stemmed=True)


class KnowledgeBase(TextIndex):
    """Skills, streams and notes in Markdown."""

    def search(self, *queries: str, root: str | None = None, k: int = 10, mode: str = "hybrid", plane: str = "knowledge", scope: str | None = None, category: str | None = None, skill: str | None = None, archived: bool = False, scorer: fusion.Scorer | None = None) -> DataFrame:
        """Result rows of ``operators.search`` with ``name``. Metadata filters read the skills below ``root``."""
        if plane not in PLANES:
            raise ValueError(f"unknown plane {plane!r}")
        skills = trees.skills(trees.read_tree(self.spark, root, "*.md")) if root else None
        if skills is None and (scope or category or skill):
            raise ValueError("metadata filters need the root of the knowledge base")
        c = self.chunks.snapshot()
        unfiltered = plane == "all" and skills is None
        allowed = None if unfiltered else filters.filter_chunks(c, skills, scope, category, skill, archived, plane, self.profile.hide_archived, "path").select("id")
        return self._search(list(queries), k, mode, allowed, scorer).withColumn("name", display_name(F.col("path"), F.col("skill")))


class ProjectIndex(TextIndex):
    """Skills, documents and source comments of a project tree."""

    profile = PROJECT

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, rules: trees.IgnoreRules = trees.IgnoreRules()) -> None:
        super().__init__(spark, path, embedder)
        self.rules = rules

    def _scan(self, root: str) -> DataFrame:
        return trees.project_files(trees.read_tree(self.spark, root), self.rules).select("path", "content", F.col("content_hash").alias("mark"), "kind", "modified_ns")

    def _chunk(self, files: DataFrame) -> DataFrame:
        owner = F.when(F.col("kind") == "skill", F.split("path", "/")[2]).otherwise(F.col("path"))
        text = chunk_files(files.where("kind != 'code'").withColumn("_owner", owner), owner="_owner", keep=("path", "mark", "kind")).withColumn("line", F.lit(None).cast("int")).drop("file_path")
        code = files.where("kind = 'code'")
        made = chunk_sources(code).join(code.select(F.col("path").alias("file_path"), "path", "mark", "kind"), "file_path").drop("file_path")
        # the code a comment belongs to is searched with it
        made = made.withColumn("text", F.concat_ws("\n", "text", F.nullif("sig", F.lit("")))).withColumns({"skill": F.lit(None).cast("string"), "heading_chain": F.array().cast("array<string>"), "part": F.lit(0)}).drop("sig")
        return text.unionByName(made)

    def search(self, *queries: str, k: int = 10, mode: str = "hybrid", kinds: tuple[str, ...] = KINDS, scorer: fusion.Scorer | None = None) -> DataFrame:
        c = self.chunks.snapshot()
        allowed = None if set(kinds) == set(KINDS) else c.where(filters.in_kinds(F.col("kind"), kinds)).select("id")
        return self._search(list(queries), k, mode, allowed, scorer)


def search_origins(k: int, **origins: DataFrame) -> DataFrame:
    """Result rows of several indexes merged on one scale (see ``fusion.merge_origins``)."""
    parts = [rows.withColumn("origin", F.lit(name)) for name, rows in origins.items()]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p, allowMissingColumns=True)
    return fusion.merge_origins(merged.drop("rank"), k)


class SessionIndex:
    """Messages of agents' logs, cut to windows, with their sessions."""

    profile = SESSIONS
    _ADAPTERS = {"kimi-code": logs.kimi_code, "kimi-cli": logs.kimi_cli, "claude": logs.claude}
    _TABLES = {
        "chunks": "id long, source_key string, agent string, src_path string, session_id string, role string, ord int, ts double, text string, stemmed string, embedding array<float>",
        "messages": "source_key string, session_id string, line_no long, sub int, role string, ts double, text string",
        "sources": "source_key string, agent string, src_path string, fingerprint string, chunk_count long",
        "sessions": "source_key string, agent string, session_id string, src_path string, title string, work_dir string, first_ts double, last_ts double, msg_count long, role string",
        **_INVERTED,
    }

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None) -> None:
        ship(spark)
        self.spark, self.path, self.embedder = spark, path, embedder

    @property
    def store(self) -> Store:
        return Store(self.spark, lifecycle.current(self.spark, self.path) or self.path, self._TABLES)

    @property
    def chunks(self) -> VersionedTable:
        return self.store["chunks"]

    @property
    def sources(self) -> VersionedTable:
        return self.store["sources"]

    @property
    def sessions(self) -> VersionedTable:
        return self.store["sessions"]

    def index(self, agent: str, lines: DataFrame, budget: int | None = None) -> int:
        """Index the sources of an agent whose fingerprint is new; returns how many chunks stay for the next run.

        ``lines`` is (src_path, line_no, line, fingerprint) of log files; for ``omp`` the rows of its prompt history
        (id, session_id, prompt, created_at, cwd, src_path), of which every session is a source. With a ``budget``, newest
        sources first, and no further source is begun once it is reached. Sources that are gone are forgotten, with
        their chunks, messages and sessions. A run with nothing to do commits nothing.
        """
        if agent not in AGENTS:
            raise ValueError(f"unknown agent {agent!r}")
        store = self.store
        base = store.version()
        registry = logs.history_registry(lines) if agent == "omp" else logs.source_registry(agent, lines)
        registry = materialize(registry, "registry")
        stored = store["sources"].snapshot(base).where(F.col("agent") == agent)
        state = materialize(lifecycle.diff(registry, stored, ["source_key"], "fingerprint").where("state != 'same'"), "source_states")
        if state.isEmpty():
            return 0
        stale = registry.join(state.where("state in ('new', 'changed')"), "source_key", "left_semi")
        if agent == "omp":
            messages, meta = logs.history(lines)
            messages, meta = (x.join(stale.select("source_key"), "source_key", "left_semi") for x in (messages, meta))
        else:
            todo = lines.join(stale.select("src_path"), "src_path", "left_semi")
            meta = logs.claude_sessions(todo) if agent == "claude" else logs.path_sessions(agent, todo)
            messages = self._ADAPTERS[agent](todo)
            messages, meta = (x.withColumn("source_key", F.concat_ws("::", F.lit(agent), "src_path")) for x in (messages, meta))
        messages = materialize(messages, "messages")
        chunks = materialize(logs.window_chunks(messages, ["source_key"], ["line_no", "sub"]), "session_chunks")
        counted = stale.join(chunks.groupBy("source_key").agg(F.count("*").alias("chunk_count")), "source_key", "left").fillna(0, ["chunk_count"])
        remaining = 0
        if budget is not None:
            newest = F.desc_nulls_last(F.split("fingerprint", r"\|")[0].try_cast("long"))
            taken = lifecycle.soft_budget(counted, "chunk_count", [newest, F.col("source_key")], budget)
            remaining = counted.join(taken.select("source_key"), "source_key", "left_anti").agg(F.coalesce(F.sum("chunk_count"), F.lit(0))).first()[0]
            counted, chunks = taken, chunks.join(taken.select("source_key"), "source_key", "left_semi")
        counted = materialize(counted, "counted")
        touched = materialize(counted.select("source_key").unionByName(state.where("state = 'removed'").select("source_key")), "touched")
        kept = meta.join(counted.select("source_key"), "source_key", "left_semi")
        rows = chunks.drop("session_id", "src_path").join(meta.select("source_key", "session_id", "src_path"), "source_key").withColumn("agent", F.lit(agent))
        rows = rows.withColumn("id", F.xxhash64("source_key", "ord", "text")).withColumn("stemmed", stem_column(F.col("text"))).withColumn("ord", F.col("ord").cast("int"))
        rows = embed(rows, self.embedder) if self.embedder else rows.withColumn("embedding", F.lit(None).cast("array<float>"))
        rows = materialize(rows.select(*store["chunks"].schema.names), "stored_chunks")
        said = messages.drop("session_id").join(kept.select("source_key", "session_id"), "source_key").where(~is_junk(F.col("text")))
        old = store["chunks"].snapshot(base, positions=True).join(touched, "source_key", "left_semi")
        gone = lambda t: _rows_of(store[t], touched, "source_key")
        store.commit(
            {
                "chunks": (rows, old.select("_file", "_row")), "messages": (said, gone("messages")), "sessions": (logs.session_rows(agent, messages, kept), gone("sessions")), "sources": (counted, gone("sources")),
                **_inverted(store, rows, materialize(old.select("id"), "gone"), ("agent", "session_id")),
            },
            base=base,
        )
        return int(remaining)

    def reindex(self, logs_of: dict[str, DataFrame]) -> SessionIndex:
        """A full rebuild from the logs of all agents, seen by searches when it is complete."""

        def build(path: str) -> None:
            fresh = copy.copy(self)
            fresh.path = path
            for agent, lines in logs_of.items():
                fresh.index(agent, lines)

        with lifecycle.RebuildLock(self.spark, self.path):
            lifecycle.publish(self.spark, self.path, build)
        return self

    def search(self, *queries: str, k: int = 10, mode: str = "hybrid", agent: str | None = None, since: str | None = None, work_dir: str | None = None, scorer: fusion.Scorer | None = None) -> DataFrame:
        """Result rows with the session's title, folder and times. Filters apply before the cut."""
        store = self.store
        c = store["chunks"].snapshot()
        s = store["sessions"].snapshot().select("source_key", "title", "work_dir", "first_ts", "last_ts", F.col("role").alias("session_role"))
        full = c.join(s, "source_key", "left")
        filtered = bool(agent or since or work_dir)
        allowed = full.where(filters.session_filter(agent, since, work_dir)).select("id") if filtered else None
        asked, vectors = _asked(self.spark, list(queries), self.embedder, mode, c)
        return search(SearchCorpus(full.drop("embedding", "stemmed"), _index_of(store), vectors), asked, k, mode, self.profile, allowed, scorer, stemmed=True)

    def list(self, agent: str | None = None) -> DataFrame:
        rows = self.sessions.snapshot()
        return (rows.where(F.col("agent") == agent) if agent else rows).orderBy("agent", F.desc_nulls_last("last_ts"), "session_id")

    def tail(self, session_id: str, n: int = 20) -> DataFrame:
        """The last messages of a session, 1 to 50 of them, oldest first."""
        return logs.tail(self.store["messages"].snapshot(), session_id, ["session_id"], ["line_no", "sub"], min(max(1, n), 50))

    def status(self) -> DataFrame:
        """(agent, sources, empty, stated_chunks, chunks) by agent: the last two differ if an index run was cut off."""
        store = self.store
        a = store["sources"].snapshot().groupBy("agent").agg(F.count("*").alias("sources"), F.sum((F.col("chunk_count") == 0).cast("long")).alias("empty"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("stated_chunks"))
        return a.join(store["chunks"].snapshot().groupBy("agent").agg(F.count("*").alias("chunks")), "agent", "left").fillna(0, ["chunks"])
