"""Session logs of four agents as one table of messages, chunks and session rows.

Each adapter takes log lines (src_path, line_no, line) and returns messages (src_path, line_no, sub, role, ts, text). Streamed
parts of an answer are joined per *island*: a running count of flushing records within a file numbers the islands, and a
grouped aggregation joins their parts. Lines that aren't JSON and blank lines are skipped; times are seconds since 1970.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranksight.functions.text import clean, epoch_seconds, is_junk, is_synthetic, iso_seconds
from ranksight.runtime import materialize
from ranksight.settings import SessionLimits

MESSAGE = ("src_path", "line_no", "sub", "role", "ts", "text")
_BLOCK = "struct<type: string, text: string, name: string>"


def read_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """(src_path, line_no, line, fingerprint) of all matching files below a folder; the fingerprint is ``mtime_ns|size``.

    A large log is read in splits. A line's number is its place in its split plus the lines of the splits before.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    mark = F.concat_ws("|", F.unix_micros(meta["file_modification_time"]) * 1000, meta["file_size"])
    named = files.select(F.regexp_replace(meta["file_path"], r"^file:(?://)?", "").alias("src_path"), mark.alias("fingerprint"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    rows = materialize(named, "log_lines")  # numbers given while reading must not be given anew
    splits = rows.groupBy("src_path", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("src_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.join(splits.select("src_path", "split", (before - F.col("first")).alias("shift")), ["src_path", "split"])
    return numbered.select("src_path", "fingerprint", (F.col("at") + F.col("shift")).alias("line_no"), "line")


def _records(lines: DataFrame, schema: str) -> DataFrame:
    parsed = lines.select("src_path", "line_no", F.from_json(F.trim("line"), schema).alias("r"))
    return parsed.where("r is not null")


def _joined(blocks: Column, test) -> Column:
    """Cleaned text of the blocks that pass, one per line; null if nothing is left."""
    texts = F.transform(F.filter(blocks, test), lambda b: F.coalesce(b["text"], F.lit("")))
    return F.nullif(clean(F.array_join(texts, "\n")), F.lit(""))


def _islands(parts: DataFrame, flush: str, is_part: str) -> DataFrame:
    """One assistant message for the parts between two flushing records, at the line of its last part."""
    order = Window.partitionBy("src_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = parts.withColumn("island", F.sum(F.expr(flush).cast("int")).over(order)).where(is_part)
    whole = numbered.groupBy("src_path", "island").agg(
        F.max("line_no").alias("line_no"),
        F.max(F.when(F.col("ts") != 0, F.struct("line_no", "ts"))).alias("at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part"))), lambda x: x["part"]), "\n").alias("joined"),
    )
    text = F.nullif(clean(F.col("joined")), F.lit(""))
    return whole.select("src_path", "line_no", F.lit(0).alias("sub"), F.lit("assistant").alias("role"), F.col("at.ts").alias("ts"), text.alias("text")).where("text is not null")


def kimi_code(lines: DataFrame) -> DataFrame:
    """User and assistant messages, streamed answers joined up to the next message or tool event, and tool names."""
    schema = f"type string, time string, message struct<role: string, content: array<{_BLOCK}>>, event struct<type: string, name: string, part: struct<type: string, text: string>>"
    r = _records(lines, schema).select("src_path", "line_no", "r.*").withColumn("ts", epoch_seconds(F.col("time")))
    message, event = F.col("type") == "context.append_message", F.col("type") == "context.append_loop_event"
    text = _joined(F.col("message.content"), lambda b: b["type"] == "text")
    spoken = r.where(message & F.col("message.role").isin("user", "assistant")).select("src_path", "line_no", F.lit(0).alias("sub"), F.col("message.role").alias("role"), "ts", text.alias("text"))
    spoken = spoken.where(F.col("text").isNotNull() & ((F.col("role") != "user") | ~is_synthetic(F.col("text"))))
    tools = r.where(event & (F.col("event.type") == "tool.call")).select("src_path", "line_no", F.lit(0).alias("sub"), F.lit("tool").alias("role"), "ts", F.concat(F.lit("tool: "), F.coalesce("event.name", F.lit("?"))).alias("text"))
    parts = r.select(
        "src_path", "line_no", "ts", F.coalesce("event.part.text", F.lit("")).alias("part"),
        F.coalesce(event & (F.col("event.type") == "content.part") & (F.col("event.part.type") == "text"), F.lit(False)).alias("is_part"),
        F.coalesce(message | event & F.col("event.type").isin("tool.call", "tool.result"), F.lit(False)).alias("flush"),
    )
    return spoken.unionByName(tools).unionByName(_islands(parts, "flush", "is_part"))


def kimi_cli(lines: DataFrame) -> DataFrame:
    """The user's input at the begin of a turn, and one assistant message for all content parts of the turn."""
    schema = f"timestamp string, message struct<type: string, payload: struct<user_input: array<{_BLOCK}>, text: string>>"
    r = _records(lines, schema).select("src_path", "line_no", "r.*").withColumn("ts", epoch_seconds(F.col("timestamp")))
    kind = F.coalesce("message.type", F.lit(""))
    asked = r.where(kind == "TurnBegin").select("src_path", "line_no", F.lit(0).alias("sub"), F.lit("user").alias("role"), "ts", _joined(F.col("message.payload.user_input"), lambda b: b.isNotNull()).alias("text")).where("text is not null")
    part = F.coalesce("message.payload.text", F.lit(""))
    parts = r.select("src_path", "line_no", "ts", part.alias("part"), ((kind == "ContentPart") & (part != "")).alias("is_part"), kind.isin("TurnBegin", "TurnEnd").alias("flush"))
    return asked.unionByName(_islands(parts, "flush", "is_part"))


_CLAUDE = f"type string, timestamp string, cwd string, sessionId string, summary string, message struct<content: array<{_BLOCK}>>"


def claude(lines: DataFrame) -> DataFrame:
    """Text of user and assistant records, names of used tools behind an answer, and summaries."""
    r = _records(lines, _CLAUDE).select("src_path", "line_no", "r.*").withColumn("ts", iso_seconds(F.col("timestamp")))
    blocks = F.coalesce(F.col("message.content"), F.array().cast(f"array<{_BLOCK}>"))
    text = _joined(blocks, lambda b: (b["type"] == "text") & (F.length(b["text"]) > 0))
    spoken = r.where(F.col("type").isin("user", "assistant")).select("src_path", "line_no", F.lit(0).alias("sub"), F.col("type").alias("role"), "ts", text.alias("text")).where("text is not null")
    named = F.filter(blocks, lambda b: (b["type"] == "tool_use") & (F.length(b["name"]) > 0))
    tools = r.where("type = 'assistant'").select("src_path", "line_no", "ts", F.posexplode(named).alias("sub", "block")).select("src_path", "line_no", (F.col("sub") + 1).alias("sub"), F.lit("tool").alias("role"), "ts", F.concat(F.lit("tool: "), "block.name").alias("text"))
    summary = r.where("type = 'summary' and length(summary) > 0").select("src_path", "line_no", F.lit(0).alias("sub"), F.lit("assistant").alias("role"), "ts", F.concat(F.lit("[summary] "), clean(F.col("summary"))).alias("text"))
    return spoken.unionByName(tools).unionByName(summary)


def claude_sessions(lines: DataFrame) -> DataFrame:
    """(src_path, session_id, title, work_dir, first_ts, last_ts) of transcripts: the last ``sessionId`` (else the file's
    name), the first user text cut to 80 characters, the first ``cwd``, first and last time in order of lines (swapped if inverted)."""
    r = _records(lines, _CLAUDE).select("src_path", "line_no", "r.*").withColumn("ts", iso_seconds(F.col("timestamp")))
    first = lambda value: F.min(F.when(value.isNotNull(), F.struct(F.col("line_no"), value.alias("v"))))["v"]
    last = lambda value: F.max(F.when(value.isNotNull(), F.struct(F.col("line_no"), value.alias("v"))))["v"]
    blocks = F.coalesce(F.col("message.content"), F.array().cast(f"array<{_BLOCK}>"))
    said = F.when(F.col("type") == "user", _joined(blocks, lambda b: (b["type"] == "text") & (F.length(b["text"]) > 0)))
    by = r.groupBy("src_path").agg(
        last(F.nullif("sessionId", F.lit(""))).alias("sid"), F.substring(first(said), 1, 80).alias("title"), first(F.col("cwd")).alias("work_dir"), first(F.nullif("ts", F.lit(0.0))).alias("t0"), last(F.nullif("ts", F.lit(0.0))).alias("t1")
    )
    stem = F.regexp_extract("src_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return by.select("src_path", F.coalesce("sid", stem).alias("session_id"), "title", "work_dir", F.least("t0", "t1").alias("first_ts"), F.greatest("t0", "t1").alias("last_ts"))


def history_registry(rows: DataFrame) -> DataFrame:
    """(source_key, agent, src_path, fingerprint) of a prompt history: every session is a source, marked by its last id and its rows."""
    key, src = F.concat_ws("::", F.lit("omp"), _history_session()), F.col("src_path") if "src_path" in rows.columns else F.lit(None).cast("string")
    by = rows.select(key.alias("source_key"), src.alias("src_path"), "id").groupBy("source_key").agg(F.min("src_path").alias("src_path"), F.max("id").alias("last"), F.count("*").alias("n"))
    return by.select("source_key", F.lit("omp").alias("agent"), "src_path", F.concat_ws("|", "last", "n").alias("fingerprint"))


def _history_session() -> Column:
    return F.coalesce(F.nullif("session_id", F.lit("")), F.lit("?"))


def history(rows: DataFrame, src_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(messages, sessions) of a prompt history (id, session_id, prompt, created_at, cwd), e.g. read over JDBC.

    Rows without a session belong to ``?``; junk prompts are dropped; one source ``omp::session`` for each session.
    ``src_path`` names the history where its rows don't.
    """
    src = F.col("src_path") if src_path is None and "src_path" in rows.columns else F.lit(src_path).cast("string")
    r = rows.select(F.col("id").cast("long").alias("line_no"), src.alias("src_path"), _history_session().alias("session_id"), clean(F.coalesce("prompt", F.lit(""))).alias("text"), epoch_seconds(F.col("created_at").cast("string")).alias("ts"), "cwd")
    r = r.withColumn("source_key", F.concat_ws("::", F.lit("omp"), "session_id"))
    messages = r.where(~is_junk(F.col("text"))).select("source_key", "src_path", "session_id", "line_no", F.lit(0).alias("sub"), F.lit("user").alias("role"), "ts", "text")
    sessions = r.groupBy("source_key", "session_id").agg(F.min("src_path").alias("src_path"), F.min_by("cwd", "line_no").alias("work_dir"), F.min(F.nullif("ts", F.lit(0.0))).alias("first_ts"), F.max(F.nullif("ts", F.lit(0.0))).alias("last_ts"), F.sum((~is_junk(F.col("text"))).cast("int")).alias("msg_count"))
    return messages, sessions.select("source_key", F.lit("omp").alias("agent"), "session_id", "src_path", F.lit(None).cast("string").alias("title"), "work_dir", "first_ts", "last_ts", "msg_count", F.lit("main").alias("role"))


def path_sessions(agent: str, sources: DataFrame, states: DataFrame | None = None, workdirs: DataFrame | None = None) -> DataFrame:
    """(src_path, session_id, role, title, work_dir, first_ts, last_ts) of the sources of an agent, from their paths.

    Subagents are ``<session>/<agent>``. ``states``: (dir, title, work_dir, created, updated) of the folders' state files;
    ``workdirs``: (work_dir), found by the MD5 of the path in the log's path.
    """
    s = sources.select("src_path").distinct()
    if agent == "kimi-code":
        s = s.withColumn("session", F.regexp_extract("src_path", r"/(session_[^/]+)/agents/[^/]+/[^/]+$", 1)).withColumn("who", F.regexp_extract("src_path", r"/agents/([^/]+)/[^/]+$", 1)).withColumn("sub", F.col("who") != "main")
        s = s.withColumn("dir", F.regexp_extract("src_path", r"^(.*)/agents/[^/]+/[^/]+$", 1))
    else:
        s = s.withColumn("who", F.regexp_extract("src_path", r"/subagents/([^/]+)/[^/]+$", 1)).withColumn("sub", F.col("who") != "")
        s = s.withColumn("session", F.when(F.col("sub"), F.regexp_extract("src_path", r"/([^/]+)/subagents/", 1)).otherwise(F.regexp_extract("src_path", r"/([^/]+)/[^/]+$", 1)))
        s = s.withColumn("dir", F.regexp_extract("src_path", r"^(.*)/[^/]+$", 1))
    s = s.withColumn("session_id", F.when(F.col("sub"), F.concat_ws("/", "session", "who")).otherwise(F.col("session"))).withColumn("role", F.when(F.col("sub"), "subagent").otherwise("main"))
    none = F.lit(None).cast("string")
    s = s.join(states, "dir", "left") if states is not None else s.withColumns({c: none for c in ("title", "work_dir", "created", "updated")})
    if workdirs is not None:
        named = workdirs.select(F.col("work_dir").alias("by_hash"), F.md5("work_dir").alias("hash"))
        s = s.withColumn("hash", F.regexp_extract("src_path", r"/([0-9a-f]{32})/", 1)).join(named, "hash", "left").withColumn("work_dir", F.coalesce("work_dir", "by_hash"))
    title = F.when(~F.col("title").startswith("<"), F.col("title")) if agent == "kimi-cli" else F.col("title")
    return s.select("src_path", "session_id", "role", title.alias("title"), "work_dir", epoch_seconds(F.col("created").cast("string")).alias("first_ts"), epoch_seconds(F.col("updated").cast("string")).alias("last_ts"))


def session_rows(agent: str, messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per source (``source_key``, or ``src_path`` where there is none): its session with message count; times from the messages where the log names none."""
    key = "source_key" if "source_key" in messages.columns and "source_key" in sessions.columns else "src_path"
    spoken = messages.groupBy(key).agg(F.min(F.nullif("ts", F.lit(0.0))).alias("t0"), F.max(F.nullif("ts", F.lit(0.0))).alias("t1"), F.count("*").alias("said"))
    s = sessions if "role" in sessions.columns else sessions.withColumn("role", F.lit("main"))
    j = s.join(spoken, key, "left")
    own = [key] if key != "src_path" else []
    return j.select(*own, F.lit(agent).alias("agent"), "session_id", "src_path", "title", "work_dir", F.coalesce("first_ts", "t0").alias("first_ts"), F.coalesce("t1", "last_ts").alias("last_ts"), F.coalesce("said", F.lit(0)).alias("msg_count"), "role")


def window_chunks(messages: DataFrame, keys: list[str], order: list[str], text: str = "text", limits: SessionLimits = SessionLimits()) -> DataFrame:
    """Messages cut to windows of ``size`` characters at steps of ``size - overlap``: the other columns, ``ord`` and ``text``.

    White space is collapsed and junk dropped; pieces of fewer than ``least_piece`` characters are left out; ``ord`` counts
    from 0 within ``keys`` in the ``order`` of messages. A text that fits is one piece. No Python.
    """
    cleaned = messages.withColumn(text, clean(F.col(text))).where(~is_junk(F.col(text), limits))
    step, size = limits.size - limits.overlap, F.length(text)
    starts = F.when(size <= limits.size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), size - 1, F.lit(step)))
    cut = F.filter(F.transform(starts, lambda i: F.struct(i.alias("start"), F.trim(F.substring(F.col(text), i + 1, F.lit(limits.size))).alias("piece"))), lambda x: F.length(x["piece"]) >= limits.least_piece)
    pieces = cleaned.withColumn("_piece", F.explode(cut))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "_piece.start")) - 1
    return pieces.withColumn("ord", n).withColumn(text, F.col("_piece.piece")).drop("_piece")


def tail(messages: DataFrame, session: str, keys: list[str], order: list[str], n: int = 20) -> DataFrame:
    """The last ``n`` (at least 1) user and assistant messages of a session, oldest first, texts cut to 800 characters."""
    last = messages.where((F.concat_ws("/", *keys) == session) & F.col("role").isin("user", "assistant")).orderBy(*[F.desc(c) for c in order]).limit(max(1, n))
    return last.withColumn("text", F.substring("text", 1, 800)).orderBy(*order)


def source_registry(agent: str, lines: DataFrame) -> DataFrame:
    """(source_key, agent, src_path, fingerprint) of the files of an agent: what ``incremental`` compares."""
    return lines.select(F.concat_ws("::", F.lit(agent), "src_path").alias("source_key"), F.lit(agent).alias("agent"), "src_path", "fingerprint").distinct()
