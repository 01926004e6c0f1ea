"""Queries of operators that the test tables have no rows for, on small literal inputs with their known results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksight import api
from ranksight.functions import comments, markdown, stem
from ranksight.functions import text as T
from ranksight.operators import enrich, filters, fusion, graph, quality, tasks
from ranksight.operators.search import hashing_embedder
from ranksight.operators.versions import Folder
from ranksight.plans.catalogue import query
from ranksight.runtime import table_dir
from ranksight.sources import sessions, trees

def _day() -> Column:
    return F.lit("2026-03-01").cast("date")


def _sql(columns: str, *rows: tuple) -> str:
    """The known result as SQL; numbers are BIGINT or DOUBLE."""

    def value(x: object) -> str:
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return {None: "NULL", True: "true", False: "false"}[x] if x is None or isinstance(x, bool) else f"{x}::{'DOUBLE' if isinstance(x, float) else 'BIGINT'}"

    body = ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({columns})"


def _frame(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _joined(c: Column | str) -> Column:
    return F.array_join(c, ",")


# ---- folders

FILES = {
    "a/SKILL.md": "---\nname: A\ncategory: tool\nrelated: [B, Z]\nentities: [K]\nupdated: 2025-01-01\ndescription: long enough to be a description of it\n---\n# A\nred apple\n## More\npie",
    "b/SKILL.md": "---\nname: B\nstatus: archived\nentities: [K]\n---\n# B\ngreen pear",
    "streams/s/log.md": "---\nname: S\n---\nx", "node_modules/x/README.md": "no", "templates/t.md": "no", "src/m.py": "# note about pears\nx = 1", "drafts/d.md": "draft", ".agents/skills/q/SKILL.md": "# Q\nplums",
    "tasks/1-x.md": "---\nid: 1\ntitle: T, one\nstatus: open\npriority: high\ndeadline: 2026-03-04\ncreated: 2026-01-01\ntags: [home]\nrelated: [9]\n---\n## Next\nbody", "tasks/archive/2-y.md": "---\nid: 2\ntitle: Two\nstatus: done\npriority: low\n---\n", "tasks/index.md": "no",
}


def _tree(spark: SparkSession) -> DataFrame:
    rows = [(p, t, 1, len(t)) for p, t in FILES.items()]
    return _frame(spark, "path string, content string, modified_ns long, bytes long", *rows).withColumn("content_hash", T.content_hash(F.col("content")))


@query(_sql("path, kind", ("a/SKILL.md", "kb"), ("b/SKILL.md", "kb"), ("streams/s/log.md", "kb"), ("drafts/d.md", "kb"), (".agents/skills/q/SKILL.md", "kb"), ("tasks/1-x.md", "kb"), ("tasks/archive/2-y.md", "kb"), ("a/SKILL.md", "docs"), ("b/SKILL.md", "docs"), ("streams/s/log.md", "docs"), ("templates/t.md", "docs"), ("src/m.py", "code"), (".agents/skills/q/SKILL.md", "skill"), ("tasks/1-x.md", "docs"), ("tasks/archive/2-y.md", "docs"), ("tasks/index.md", "docs")))
def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-01, S-02, S-05, F-01: what a knowledge base and a project with ignore rules take of a tree."""
    t = _tree(spark)
    project = trees.project_files(t, trees.IgnoreRules.parse("**/drafts/**\n# c\n*.log\n"))
    return trees.markdown_files(t).select("path", F.lit("kb").alias("kind")).unionByName(project.select("path", "kind"))


@query(_sql("name, owner, category, status, related, entities", ("A", "a", "tool", "active", "B,Z", "K"), ("B", "b", None, "archived", "", "K"), ("q", ".agents", None, "active", "", "")))
def tree_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-03, T-01."""
    return trees.skills(_tree(spark)).select("name", "owner", "category", "status", _joined("related").alias("related"), _joined("entities").alias("entities"))


@query(_sql("rule, subject, detail", ("no_related", "B", None), ("no_related", "q", None), ("no_category", "B", None), ("no_category", "q", None), ("broken_ref", "A", "Z"), ("reciprocal_ref", "A", "B"), ("stale", "A", "424"), ("orphan", "q", None), ("empty_description", "B", "0"), ("empty_description", "q", "0"), ("index_drift", "drafts/d.md", "not indexed"), ("stream_no_readme", "streams/s", None)))
def lint_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-01, J-08: all rules over the skills of a tree."""
    t = _tree(spark)
    files = trees.markdown_files(t)
    return quality.lint(trees.skills(t), files, files.where("path != 'drafts/d.md'"), _day())


@query(_sql("path, content", ("a/SKILL.md", FILES["a/SKILL.md"].replace("[B, Z]", "[B]").replace("2025-01-01", "2026-03-01"))))
def lint_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-02, K-08: broken references dropped, everything else byte for byte."""
    t = _tree(spark)
    return quality.fix_references(trees.skills(t).join(t.select("path", "content"), "path"), _day())


@query(_sql("name, stated, actual", ("NONE_SUCH", 1.0, None), ("SIZE", 7.0, 8.0)))
def doc_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-03, T-26."""
    return quality.check_numbers(_frame(spark, "text string", ("LIMIT = 5, SIZE=7, NONE_SUCH = 1",)), _frame(spark, "name string, value double", ("LIMIT", 5.0), ("SIZE", 8.0)))


@query(_sql("name, kind, other", ("A", "skill:tool", None), ("B", "skill:", None), ("q", "skill:", None), ("K", None, None), ("A", "related_to", "B"), ("A", "mentions", "K"), ("B", "mentions", "K")))
def skill_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-01: entities, edges and mentions of the skills of a tree."""
    g = graph.build(trees.skills(_tree(spark)))
    return g.entities.select("name", F.col("type").alias("kind"), F.lit(None).cast("string").alias("other")).unionByName(g.edges.select(F.col("source").alias("name"), F.col("relation").alias("kind"), F.col("target").alias("other"))).unionByName(
        g.mentions.select(F.col("skill_name").alias("name"), F.lit("mentions").alias("kind"), F.col("entity_name").alias("other"))
    )


@query("SELECT DISTINCT entity_name AS name FROM skill_entities WHERE contains(lower(entity_name), 'fe') AND entity_name <> '' AND entity_name IS NOT NULL AND skill_name IS NOT NULL")
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-09, G-02 over the whole table of mentions, built into a graph."""
    from ranksight.runtime import load

    m = load(spark, sf_dir, "skill_entities").where("skill_name is not null")
    skills = m.groupBy(F.col("skill_name").alias("name")).agg(F.collect_set("entity_name").alias("entities")).withColumns({"category": F.lit(None).cast("string"), "related": F.array().cast("array<string>")})
    entities = graph.build(skills).mentions.select(F.col("entity_name").alias("name")).distinct()
    return graph.match_entities(entities, "FE")


@query(_sql("rule, owner", ("none", "a"), ("none", ".agents"), ("archived", "a"), ("archived", "b"), ("archived", ".agents"), ("category", "a"), ("skill", "b")))
def owner_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-04 to F-06."""
    s = trees.skills(_tree(spark))
    picks = {"none": {}, "archived": {"archived": True}, "category": {"category": "tool"}, "skill": {"skill": "B", "archived": True}}
    found = [filters.select_owners(s, **k).select(F.lit(n).alias("rule"), "owner") for n, k in picks.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


# ---- indexes


@query(_sql("step, path, name, rank", ("kb", "a/SKILL.md", "A", 1), ("rebuilt", "a/SKILL.md", "A", 1), ("tasks", "tasks/1-x.md", "tasks/1-x", 1), ("project", "src/m.py", None, 1)))
def index_and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-04, J-01, R-14, R-15, F-02: index a folder, search it, rebuild it, search again through another object; then as a project."""
    import uuid

    root = f"{table_dir(spark)}/tree-{uuid.uuid4().hex}"
    for p, t in FILES.items():
        Folder(spark, root).create(p, t)
    kb = api.KnowledgeBase(spark, f"{root}-kb", hashing_embedder(16))
    kb.index(root)
    show = lambda rows, step: rows.select(F.lit(step).alias("step"), "path", F.col("name") if "name" in rows.columns else F.lit(None).cast("string").alias("name"), F.col("rank").cast("long").alias("rank"))
    first = kb.search("red apples", root=root, mode="keyword")
    kb.reindex(root)
    again = api.KnowledgeBase(spark, f"{root}-kb")
    project = api.ProjectIndex(spark, f"{root}-project")
    project.index(root)
    out = show(first, "kb").unionByName(show(again.search("red apples", root=root, mode="keyword"), "rebuilt"))
    out = out.unionByName(show(again.search("bodies", mode="keyword", plane="tasks"), "tasks"))
    return out.unionByName(show(project.search("pear", mode="keyword", kinds=("code",)), "project"))


@query(_sql("query_id, id, rank", (0, 3, 1), (0, 1, 2), (0, 2, 3), (1, 1, 1), (1, 2, 2)))
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-10: a scorer that counts the letter x; where it fails (query 1) the fused order stays."""

    def scorer(pairs: list[tuple[str, str]]) -> list[float]:
        if any(q == "fails" for q, _ in pairs):
            raise OSError
        return [float(t.count("x")) for _, t in pairs]

    hits = _frame(spark, "query_id int, id int, score double, rank int", (0, 1, 0.9, 1), (0, 2, 0.8, 2), (0, 3, 0.7, 3), (1, 1, 0.9, 1), (1, 2, 0.8, 2))
    texts, queries = _frame(spark, "id int, text string", (1, "ax"), (2, "b"), (3, "xx")), _frame(spark, "query_id int, query string", (0, "q"), (1, "fails"))
    each = [fusion.rerank(hits.where(f"query_id = {i}"), texts, queries, scorer, 3) for i in (0, 1)]
    return each[0].unionByName(each[1]).select(*[F.col(c).cast("long").alias(c) for c in ("query_id", "id", "rank")])


# ---- logs


def _lines(spark: SparkSession, path: str, *records: object) -> DataFrame:
    return _frame(spark, "src_path string, fingerprint string, line_no long, line string", *[(path, "1|2", i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)])


def _kimi_code(spark: SparkSession) -> DataFrame:
    loop = lambda event, t=None: {"type": "context.append_loop_event", "time": t, "event": event}
    part = lambda text, t: loop({"type": "content.part", "part": {"type": "text", "text": text}}, t)
    user = {"type": "context.append_message", "time": 1700000000000, "message": {"role": "user", "content": [{"type": "text", "text": "hello  there"}]}}
    return _lines(spark, "/l/wd/session_1/agents/sub/wire.jsonl", user, part("a", 1700000001000), part("b", 1700000002000), loop({"type": "tool.call", "name": "grep"}, 1700000003000), "{broken", "", part("c", None))


def _kimi_cli(spark: SparkSession) -> DataFrame:
    m = lambda t, p=None, ts=None: {"timestamp": ts, "message": {"type": t, "payload": p or {}}}
    return _lines(spark, "/l/0123456789abcdef0123456789abcdef/u1/wire.jsonl", m("TurnBegin", {"user_input": [{"text": "hi"}, {"text": "you"}]}, 5.0), m("ContentPart", {"text": "x"}, 6.0), m("ContentPart", {"text": "y"}), m("TurnEnd"))


def _claude(spark: SparkSession) -> DataFrame:
    rec = lambda kind, content, ts, **k: {"type": kind, "timestamp": ts, "message": {"content": content}, **k}
    say = lambda t: {"type": "text", "text": t}
    return _lines(spark, "/t/abc.jsonl", rec("user", [say("a question that is long enough to be kept as a chunk")], "2024-01-01T00:00:02Z", cwd="/w", sessionId="s"), rec("assistant", [say("ok"), {"type": "tool_use", "name": "run"}], "2024-01-01T00:00:01Z"), {"type": "summary", "summary": "all  done"}, "not json")


@query(_sql("agent, role, ts, text", ("kimi-code", "user", 1.7e9, "hello there"), ("kimi-code", "assistant", 1.7e9 + 2, "a b"), ("kimi-code", "tool", 1.7e9 + 3, "tool: grep"), ("kimi-code", "assistant", None, "c"), ("kimi-cli", "user", 5.0, "hi you"), ("kimi-cli", "assistant", 6.0, "x y"), ("claude", "user", 1704067202.0, "a question that is long enough to be kept as a chunk"), ("claude", "assistant", 1704067201.0, "ok"), ("claude", "tool", 1704067201.0, "tool: run"), ("claude", "assistant", None, "[summary] all done")))
def log_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-06 to S-08: messages of three kinds of logs."""
    read = {"kimi-code": sessions.kimi_code(_kimi_code(spark)), "kimi-cli": sessions.kimi_cli(_kimi_cli(spark)), "claude": sessions.claude(_claude(spark))}
    each = [m.select(F.lit(a).alias("agent"), "role", F.col("ts").cast("double").alias("ts"), "text") for a, m in read.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(_sql("source_key, session_id, role, first_ts, last_ts, msg_count", ("kimi-code::/l/wd/session_1/agents/sub/wire.jsonl", "session_1/sub", "subagent", 1.7e9, 1.7e9 + 3, 4), ("claude::/t/abc.jsonl", "s", "main", 1704067201.0, 1704067202.0, 4), ("omp::?", "?", "main", 1.7e9, 1.7e9, 1), ("omp::h", "h", "main", 1.7e9 + 1, 1.7e9 + 2, 1)))
def indexed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-09, S-10, A-08, J-02: logs of three agents in one session index, then read back."""
    import uuid

    ix = api.SessionIndex(spark, f"{table_dir(spark)}/sessions-{uuid.uuid4().hex}")
    long = "a prompt that is long enough to stay in the index"
    ix.index("kimi-code", _kimi_code(spark))
    ix.index("claude", _claude(spark))
    ix.index("omp", _frame(spark, "id int, session_id string, prompt string, created_at long, cwd string", (1, None, long, 1700000000, "/a"), (2, "h", "tiny", 1700000001, "/b"), (3, "h", long, 1700000002000, "/c")))
    return ix.list().select("source_key", "session_id", "role", "first_ts", "last_ts", F.col("msg_count").cast("long").alias("msg_count"))


# ---- texts


@query(_sql("word, stem", ("running", "run"), ("consistency", "consist"), ("hopping", "hop"), ("важная", "важн"), ("памяти", "памят"), ("_raw", "_raw"), (None, None)))
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-12: words whose stems the published algorithms list."""
    return _frame(spark, "word string", ("running",), ("consistency",), ("hopping",), ("важная",), ("памяти",), ("_raw",), (None,)).select("word", stem.stem_column(F.col("word")).alias("stem"))


@query(_sql("query, plain, cut", ("running getUser_names", "run,getuser_nam", "run,getus,name"), ("память агентов", "памя,агент", "памя,агент"), (None, "", "")))
def query_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-13, T-14, R-02: query terms of both analyzers."""
    q = _frame(spark, "query string", ("running getUser_names",), ("память агентов",), (None,))
    return q.select("query", _joined(stem.stem_query_column(F.col("query"))).alias("plain"), _joined(stem.stem_query_column(F.col("query"), True)).alias("cut"))


@query(_sql("value, seconds", ("1700000000000", 1.7e9), ("1700000000", 1.7e9), ("true", None), (None, None)))
def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-10."""
    return _frame(spark, "value string", ("1700000000000",), ("1700000000",), ("true",), (None,)).select("value", T.epoch_seconds(F.col("value")).alias("seconds"))


@query(_sql("what, value", ("cells", "Name,k"), ("review", "2026-02-03"), ("empty", "false"), ("missing", "true")))
def note_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-27, T-28: tables, dated headings and sections of a note."""
    t = F.lit("## [2026-01-02] a\n## [2026-02-03] b\n## Next\nstep\n| Name | x |\n|---|---|\n| `k` | v |")
    found = {"cells": _joined(T.first_cells(t)), "review": T.last_review(t).cast("string"), "empty": T.section_empty(t, "Next").cast("string"), "missing": T.section_empty(t, "None").cast("string")}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("what"), v.alias("value")) for k, v in found.items()]))
    return spark.range(1).select(pairs.alias("p")).select("p.what", "p.value")


@query(_sql("field, value", ("name", "demo"), ("related", "a,b"), ("tags", "x,y z"), ("d", "one two"), ("l", "p\nq"), ("u", "http://x#y")))
def frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-01: every kind of value."""
    t = _frame(spark, "t string", ("---\nname: demo\nrelated:\n  - a\n  - 'b' # x\ntags: [x, 'y z']\nd: >\n  one\n\n  two\nl: |\n  p\n  q\nu: http://x#y # note\n---\nBody\n",), ("plain",), (None,))
    return t.select(markdown.frontmatter_column(F.col("t")).alias("f")).select(F.explode("f.fields").alias("field", "v")).select("field", _joined("v").alias("value"))


@query(_sql("path, heading, part, chain, prefix", ("demo.md", "Intro", 0, "Intro", "[demo] > Intro"), ("fence.md", "Код", 0, "Код", "[fence] > Код")))
def chunk_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-02 to T-06: a section is a chunk with its headings; a heading mark inside a fence is none."""
    f = _frame(spark, "path string, content string", ("demo.md", "## Intro\nКороткий текст"), ("fence.md", "## Код\n```python\n# no heading\nx = 1\n```\nТекст."))
    c = markdown.chunk_files(f)
    return c.select(F.col("file_path").alias("path"), "heading", F.col("part").cast("long").alias("part"), F.array_join("heading_chain", "/").alias("chain"), F.substring_index("text_for_embedding", "\n", 1).alias("prefix"))


@query(_sql("path, line, text, sig", ("a.c", 1, "hello", "int x;"), ("a.py", 1, "a", "x=1 # b"), ("a.sql", 1, "c", "select '--x'"), ("a.yml", 1, "z", "a: 'x # y'"), ("a.sh", 1, "1", "x"), ("a.ps1", 1, "doc", "Get-Item")))
def comment_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-18 to T-22: one comment in each of the six styles."""
    f = _frame(spark, "path string, content string", ("a.c", "int x; // hello"), ("a.py", "# a\nx=1 # b"), ("a.sql", "select '--x' -- c"), ("a.yml", "a: 'x # y' # z"), ("a.sh", "x #1"), ("a.ps1", "<# doc #>\nGet-Item"))
    return comments.chunk_sources(f).select(F.col("file_path").alias("path"), F.col("line").cast("long").alias("line"), F.substring_index("text", "\n", 1).alias("text"), F.substring_index("sig", "\n", 1).alias("sig"))


# ---- models and tasks


@query(_sql("name, category, status, related, entities", ("A", "tool", None, "B", "K,L")))
def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-01, N-02: answers of a model, pieces of a long text merged, values outside the enumerations dropped."""
    skills = _frame(spark, "name string, body string", ("A", "a" * 7_000), ("B", None))

    def ask(name: str, text: str) -> str:
        if name == "B":
            raise OSError
        return "```json\n" + json.dumps({"category": "tool", "related": ["B", "A", "Z"], "status": "weird", "entities": [" K "] if len(text) == 6_000 else ["L", ""]}) + "\n```"

    got = enrich.sanitize(enrich.extract(skills, ask), skills)
    return got.select("name", "category", "status", _joined("related").alias("related"), _joined("entities").alias("entities"))


@query(_sql("path, content", ("p/A", "---\nname: A\ncategory: tool\nrelated: [B]\nupdated: 2026-03-01\n---\nx")))
def enrichment_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-02, K-08."""
    skills = _frame(spark, "name string, path string, content string", ("A", "p/A", "---\nname: A\n---\nx"))
    p = _frame(spark, "name string, category string, status string, related array<string>, entities array<string>", ("A", "tool", None, ["B"], []))
    return enrich.apply(skills, p, _day())


@query(_sql("what, name, entities", ("changed", "A", "y,z"), ("dead", "Q", None)))
def entities_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-03."""
    changed, dead = enrich.migrate_entities(_frame(spark, "skill_name string, entity_name string", ("A", "z"), ("A", "y"), ("Q", "z")), _frame(spark, "name string, entities array<string>", ("A", ["old"]), ("B", [])))
    return changed.select(F.lit("changed").alias("what"), "name", _joined("entities").alias("entities")).unionByName(dead.select(F.lit("dead").alias("what"), "name", F.lit(None).cast("string").alias("entities")))


@query(_sql("id, title, archived, fits", ("1", "T, one", False, True), ("2", "Two", True, False)))
def task_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-12, F-08, X-03, Y-01."""
    t = trees.task_files(_tree(spark))
    return t.select("id", "title", "archived", F.coalesce(tasks.matches(status="open", tag="home"), F.lit(False)).alias("fits"))


@query(_sql("subject, problem, detail", ("tasks/1-x.md", "missing", "sphere"), ("tasks/1-x.md", "reference", "9"), ("tasks/archive/2-y.md", "missing", "sphere"), ("tasks/archive/2-y.md", "domain", "status=done"), ("tasks/archive/2-y.md", "section", "Next"), ("tasks/12-z.md", "missing", "sphere"), ("tasks/12-z.md", "number", "7")))
def task_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y-05: fields, domains, references, the number in a file's name, and sections that must not be empty."""
    t = trees.task_files(_tree(spark).unionByName(_frame(spark, "path string, content string", ("tasks/12-z.md", "---\nid: 7\nstatus: open\n---\n## Next\ngo on")).withColumns({"modified_ns": F.lit(1).cast("long"), "bytes": F.lit(1).cast("long"), "content_hash": F.lit("")})))
    return tasks.check(t, ("id", "sphere"), {"status": ("open",)}, ("deadline",), sections=("Next",), numbered=True)


@query(_sql("id, problem, days", ("1", "idle", 59), ("1", "soon", -3)))
def task_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y-03, Y-04: notes by the age of their dates."""
    rules = {"idle": (F.col("status") == "open", "created", 21, None), "soon": (F.lit(True), "deadline", -7, 0)}
    return tasks.date_problems(trees.task_files(_tree(spark)), _day(), rules).withColumn("days", F.col("days").cast("long"))


@query(_sql("path, target, content", ("tasks/1-x.md", "tasks/archive/1-x.md", FILES["tasks/1-x.md"].replace("status: open", "status: done").replace("\n---\n## Next", "\nupdated: 2026-03-01\n---\n## Next") + "\n\nno longer needed\n")))
def task_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y-06: fields set, a remark appended, the note to be moved to another folder."""
    t = _tree(spark)
    one = trees.task_files(t).where("id = '1'").select("path").join(t.select("path", "content"), "path")
    return tasks.close(one, {"status": "done", "updated": "2026-03-01"}, "tasks/archive", "no longer needed")


@query(_sql("id, event", ("1", "BEGIN:VEVENT\r\nUID:task-1\r\nDTSTAMP:20260101T000000Z\r\nDTSTART;VALUE=DATE:20260304\r\nDTEND;VALUE=DATE:20260305\r\nSUMMARY:T\\, one\r\nBEGIN:VALARM\r\nACTION:DISPLAY\r\nTRIGGER:-P1D\r\nDESCRIPTION:T\\, one\r\nEND:VALARM\r\nEND:VEVENT")))
def task_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-09, T-25."""
    return tasks.calendar(trees.task_files(_tree(spark)), "20260101T000000Z")


@query(_sql("id, rank", ("1", 2)))
def task_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y-02: each task once, in the order of its best hit."""
    hits = _frame(spark, "path string, rank long", ("tasks/1-x.md", 5), ("tasks/1-x.md", 2), ("a/SKILL.md", 1))
    return tasks.first_hits(hits, trees.task_files(_tree(spark))).select("id", "rank")
