"""Graph, checks, enrichment, tasks, log sources, folders and the API."""

import json

from pyspark.sql import functions as F

from ranksight import api
from ranksight.operators import enrich, graph, quality, tasks
from ranksight.operators.search import hashing_embedder
from ranksight.sources import sessions, trees


def rows(df):
    return sorted(tuple(r) for r in df.collect())


SKILL = "name string, category string, related array<string>, entities array<string>"


def test_graph(spark):
    s = spark.createDataFrame([("A", "c", ["B", "A", "X"], ["K", "B"]), ("B", None, [], ["K"]), (None, "c", ["A"], [])], SKILL)
    g = graph.build(s)
    assert rows(g.entities.fillna("-")) == [("A", "skill:c"), ("B", "skill:"), ("K", "-")]
    assert rows(g.edges) == [("A", "B", "related_to", "A")]
    assert rows(g.mentions) == [("A", "B"), ("A", "K"), ("B", "K")]
    assert rows(graph.degrees(g.entities, g.edges).select("name", "n")) == [("A", 1), ("B", 1), ("K", 0)]
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("a", "b")], "source string, target string")
    start = spark.createDataFrame([("a",)], "name string")
    assert rows(graph.neighbors(e, start)) == [("a", "in", "c"), ("a", "out", "b")]
    assert rows(graph.two_hops(e, start)) == [("a", "in", "c", "b"), ("a", "out", "b", "c"), ("a", "out", "b", "d")]
    assert [r.name for r in graph.match_entities(g.entities, "k").collect()] == ["K"] and graph.match_entities(g.entities, "%").count() == 0
    m = spark.createDataFrame([(f"s{i}", "Click House") for i in range(3)] + [("s1", "Click House"), ("s1", "AI"), ("s2", "AI"), ("s3", "AI"), ("s0", "Two"), ("s1", "Two")], "skill_name string, entity_name string")
    assert rows(graph.uncovered_entities(m, spark.createDataFrame([("x",)], "name string"))) == [("Click House", 3, ["s0", "s1", "s2"])]
    assert graph.uncovered_entities(m, spark.createDataFrame([("entity-click-house",)], "name string")).count() == 0


def test_tree_and_lint(spark, tmp_path):
    def put(path, text):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    put("a/SKILL.md", "---\nname: A\ncategory: c\nrelated: [B, Z]\nentities: [K]\nupdated: 2020-01-01\ndescription: long enough to be a description of it\n---\n# A\nred apple\n## More\npie")
    put("b/SKILL.md", "---\nname: B\nstatus: archived\n---\n# B\ngreen")
    put("streams/s/log.md", "x")
    put("node_modules/x/README.md", "no")
    put("templates/t.md", "no")
    put("tasks/1-x.md", "---\nid: 1\ntitle: T, one\nstatus: open\npriority: high\ndeadline: 2026-05-01\nrelated: [9]\n---\nbody")
    put("tasks/index.md", "no")
    put("src/m.py", "# note about pears\nx = 1")
    put("drafts/d.md", "draft")
    tree = trees.read_tree(spark, str(tmp_path))
    md = trees.markdown_files(tree)
    assert sorted(r.path for r in md.collect()) == ["a/SKILL.md", "b/SKILL.md", "drafts/d.md", "streams/s/log.md", "tasks/1-x.md"]
    skills = trees.skills(tree)
    found = {(r.rule, r.subject) for r in quality.lint(skills, md, md.where("path != 'drafts/d.md'"), F.lit("2026-01-01").cast("date")).collect()}
    assert found == {("broken_ref", "A"), ("reciprocal_ref", "A"), ("stale", "A"), ("no_related", "B"), ("no_category", "B"), ("empty_description", "B"), ("index_drift", "drafts/d.md"), ("stream_no_readme", "streams/s")}
    fixed = quality.fix_references(skills.join(tree.select("path", "content"), "path"), F.lit("2026-02-02").cast("date")).collect()
    assert len(fixed) == 1 and "related: [B]" in fixed[0].content and "updated: 2026-02-02" in fixed[0].content
    p = trees.project_files(tree, trees.IgnoreRules.parse("**/drafts/**\n*.log\n# c\n"))
    assert {(r.path, r.kind) for r in p.collect()} >= {("src/m.py", "code"), ("a/SKILL.md", "docs")} and p.where("path like 'drafts%'").count() == 0
    assert trees.IgnoreRules.parse("./.hidden/\n**/x/**\n*.tmp") == trees.IgnoreRules((".hidden", "x"), ("*.tmp",))
    t = trees.task_files(tree)
    assert [(r.id, r.title) for r in t.collect()] == [("1", "T, one")]
    assert "SUMMARY:T\\, one\r\n" in tasks.calendar(t, "20260101T000000Z").first().event
    assert rows(tasks.check(t, ("id", "sphere"), {"status": ("open",), "priority": ("low",)}, ("deadline",)).select("problem", "detail")) == [("domain", "priority=high"), ("missing", "sphere"), ("reference", "9")]
    assert t.where(tasks.matches(status="open", tag=None)).count() == 1 and t.where(tasks.matches(tag="x")).count() == 0
    assert tasks.next_id(t, F.col("id").cast("int")).first()[0] == 2 and tasks.next_id(t.limit(0), F.col("id").cast("int")).first()[0] == 1
    ranked = t.unionByName(t.withColumns({"id": F.lit("2"), "priority": F.lit("low"), "deadline": F.lit(None)})).orderBy(*tasks.order("priority", ("low", "high"), ("open",)))
    assert [r.id for r in ranked.collect()] == ["2", "1"]

    kb = api.KnowledgeBase(spark, str(tmp_path / ".kb"), hashing_embedder(16))
    assert kb.index(str(tmp_path)) == {"new": 5, "changed": 0, "removed": 0, "remaining_chunks": 0}
    assert kb.index(str(tmp_path))["new"] == 0
    got = kb.search("red apples", root=str(tmp_path), k=3).orderBy("rank").collect()
    assert got[0].path == "a/SKILL.md" and got[0].name == "A" and all(r.path != "b/SKILL.md" and not r.path.startswith("tasks/") for r in got)
    (tmp_path / "b/SKILL.md").unlink()
    put("a/SKILL.md", "---\nname: A\n---\n# A\nblue plums")
    assert kb.index(str(tmp_path))["removed"] == 1
    assert kb.search("plum", mode="keyword", plane="all").first().path == "a/SKILL.md" and kb.search("apple", mode="keyword", plane="all").count() == 0
    assert kb.status(str(tmp_path)).first()["same"] == 4
    kb.reindex(str(tmp_path))  # another object on the same path sees the rebuilt index
    again = api.KnowledgeBase(spark, str(tmp_path / ".kb"))
    assert again.store.path != str(tmp_path / ".kb") and again.search("plum", mode="keyword", plane="all").count() == 1
    pr = api.ProjectIndex(spark, str(tmp_path / ".pr"))
    pr.index(str(tmp_path), budget=2)
    pr.index(str(tmp_path))
    hit = pr.search("pear", mode="keyword", kinds=("code",)).first()
    assert (hit.path, hit.line, hit.kind) == ("src/m.py", 1, "code")
    both = api.search_origins(5, project=pr.search("plum", mode="keyword"), **{"global": kb.search("plum", mode="keyword", plane="all")}).orderBy("rank").collect()
    assert [r.origin for r in both] == ["project", "global"] and both[0].score == 1.0


def test_numbers_and_enrichment(spark):
    docs = spark.createDataFrame([("LIMIT = 5, SIZE=7, NONE_SUCH = 1",)], "text string")
    consts = spark.createDataFrame([("LIMIT", 5.0), ("SIZE", 8.0)], "name string, value double")
    assert rows(quality.check_numbers(docs, consts).select("name")) == [("NONE_SUCH",), ("SIZE",)]
    skills = spark.createDataFrame([("A", "p/A", "body A", "---\nname: A\n---\nx", ["old"]), ("B", "p/B", None, "plain", [])], "name string, path string, body string, content string, entities array<string>")
    answer = json.dumps({"category": "c", "related": ["B", "A", "Z"], "status": "weird", "entities": [" K ", "K", ""]})

    def ask(name, text):
        if name == "B":
            raise OSError
        return f"```json\n{answer}\n```"

    got = enrich.sanitize(enrich.extract(skills, ask), skills, ("c",))
    assert [tuple(r) for r in got.collect()] == [("A", "c", None, ["B"], ["K"])]
    (new,) = enrich.apply(skills, got, F.lit("2026-01-02").cast("date")).collect()
    assert new.content == "---\nname: A\ncategory: c\nrelated: [B]\nentities: [K]\nupdated: 2026-01-02\n---\nx"
    m = spark.createDataFrame([("A", "z"), ("A", "y"), ("Q", "z")], "skill_name string, entity_name string")
    changed, dead = enrich.migrate_entities(m, skills)
    assert rows(changed) == [("A", ["y", "z"])] and rows(dead) == [("Q",)]
    assert rows(enrich.upsert(got.select("name", "category"), spark.createDataFrame([("A", "d")], "name string, category string"))) == [("A", "d")]


def lines(spark, path, *records):
    return spark.createDataFrame([(path, "1|2", i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "src_path string, fingerprint string, line_no int, line string").repartition(3)


def said(df):
    return [(r.role, r.ts, r.text) for r in df.orderBy("line_no", "sub").collect()]


def test_kimi_code(spark):
    part = lambda t, ts: {"type": "context.append_loop_event", "time": ts, "event": {"type": "content.part", "part": {"type": "text", "text": t}}}
    user = lambda t: {"type": "context.append_message", "time": 1700000000000, "message": {"role": "user", "content": [{"type": "text", "text": t}, {"type": "image"}]}}
    log = lines(
        spark, "/l/wd_x/session_1/agents/sub/wire.jsonl", user("hello  there"), part("a", 1700000001000), part("b", 1700000002000), {"type": "context.append_loop_event", "time": 1700000003000, "event": {"type": "tool.call", "name": "grep"}},
        "{broken", "", part("c", None), {"type": "context.append_loop_event", "event": {"type": "tool.result"}}, part("d", 1700000004), user("<system x"), {"type": "other"},
    )
    assert said(sessions.kimi_code(log)) == [("user", 1.7e9, "hello there"), ("assistant", 1.7e9 + 2, "a b"), ("tool", 1.7e9 + 3, "tool: grep"), ("assistant", None, "c"), ("assistant", 1.7e9 + 4, "d")]
    r = sessions.path_sessions("kimi-code", log).first()
    assert (r.session_id, r.role) == ("session_1/sub", "subagent")


def test_kimi_cli(spark):
    m = lambda t, p=None, ts=None: {"timestamp": ts, "message": {"type": t, "payload": p or {}}}
    log = lines(spark, "/l/0123456789abcdef0123456789abcdef/u1/wire.jsonl", m("TurnBegin", {"user_input": [{"text": "hi"}, {"text": "you"}]}, 5.0), m("ContentPart", {"text": "x"}, 6.0), m("ContentPart", {"text": ""}), m("ContentPart", {"text": "y"}), m("TurnEnd"), m("ContentPart", {"text": "z"}))
    assert said(sessions.kimi_cli(log)) == [("user", 5.0, "hi you"), ("assistant", 6.0, "x y"), ("assistant", None, "z")]
    assert sessions.path_sessions("kimi-cli", log).first().session_id == "u1"


def test_claude_and_chunks(spark, tmp_path):
    text = "long text " * 300
    rec = lambda kind, content, ts, **k: {"type": kind, "timestamp": ts, "message": {"content": content}, **k}
    log = lines(
        spark, "/t/abc.jsonl", rec("user", [{"type": "text", "text": text}], "2024-01-01T00:00:02Z", cwd="/w", sessionId="s"), rec("assistant", [{"type": "text", "text": "ok"}, {"type": "tool_use", "name": "run"}], "2024-01-01T00:00:01Z"),
        rec("user", "plain", None), {"type": "summary", "summary": "all  done"}, "not json",
    )
    got = said(sessions.claude(log))
    assert [(r, t[:15]) for r, _, t in got] == [("user", "long text long "), ("assistant", "ok"), ("tool", "tool: run"), ("assistant", "[summary] all d")]
    s = sessions.claude_sessions(log).first()
    assert (s.session_id, s.work_dir, s.first_ts, s.last_ts, len(s.title)) == ("s", "/w", 1704067201.0, 1704067202.0, 80)
    ix = api.SessionIndex(spark, str(tmp_path / "s"))
    assert ix.index("claude", log) == 0
    assert ix.status().first().stated_chunks == ix.status().first().chunks == 3
    hit = ix.search("texts", mode="keyword", agent="claude", work_dir="/W").orderBy("rank").first()
    assert (hit.session_id, hit.title[:4]) == ("s", "long")
    assert ix.search("texts", mode="keyword", since="2030-01-01").count() == 0
    assert ix.list("claude").count() == 1 and [r.text[:9] for r in ix.tail("s", 2).collect()] == ["long text"]
    ix.index("claude", log.limit(0))
    assert ix.chunks.snapshot().count() == 0


def test_log_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f"line {i} of the log\n" for i in range(400)))
    (tmp_path / "b.jsonl").write_text("only\r\n\nlast")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        got = [(r.src_path[-7:], r.line_no, r.line) for r in sessions.read_lines(spark, str(tmp_path)).orderBy("src_path", "line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [("a.jsonl", i, f"line {i} of the log") for i in range(400)] + [("b.jsonl", i, x) for i, x in enumerate(["only\r", "", "last"])]


def test_history_sessions(spark, tmp_path):
    """Each session of the fourth agent is a source of its own."""
    long = "a prompt that is long enough to stay in the index"
    schema = "id int, session_id string, prompt string, created_at long, cwd string"
    rows = spark.createDataFrame([(1, None, long, 1700000000, "/a"), (2, "s", "tiny", 1700000001, "/b"), (3, "s", long + " too", 1700000002, "/c")], schema)
    ix = api.SessionIndex(spark, str(tmp_path / "h"))
    ix.index("omp", rows)
    assert [(r.source_key, r.chunk_count) for r in ix.sources.snapshot().orderBy("source_key").collect()] == [("omp::?", 1), ("omp::s", 1)]
    before = ix.store.version()
    assert ix.index("omp", rows) == 0 and ix.store.version() == before
    ix.index("omp", rows.unionByName(spark.createDataFrame([(4, "s", long + " once more", 1700000009, "/c")], schema)))
    assert ix.search("prompts", mode="keyword").count() == 3 and [r.line_no for r in ix.tail("s").collect()] == [3, 4]


def test_windows(spark):
    sizes = [1500, 1600, 2700, 2610]
    m = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)] + [(9, None), (10, "short")], "i int, text string")
    got = {}
    for r in sessions.window_chunks(m, ["i"], ["i"]).orderBy("i", "ord").collect():
        got.setdefault(r.i, []).append(len(r.text))
    assert got == {0: [1500], 1: [1500, 300], 2: [1500, 1400, 100], 3: [1500, 1310]}
    h = spark.createDataFrame([(1, None, "a prompt that is long enough to stay here", 1700000000, "/a"), (2, "s", "tiny", 1700000001, "/b"), (3, "s", "another prompt that is long enough to stay", 1700000002000, "/c")], "id int, session_id string, prompt string, created_at long, cwd string")
    messages, ss = sessions.history(h, "db")
    assert messages.count() == 2
    assert rows(ss.select("session_id", "work_dir", "msg_count", "last_ts")) == [("?", "/a", 1, 1.7e9), ("s", "/b", 1, 1.7e9 + 2)]
