"""Versioned tables, incremental planning, life cycle, components and streaming."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ranksight.operators import incremental, lifecycle
from ranksight.operators.components import connected_components
from ranksight.operators import versions
from ranksight.operators.versions import Store, VersionedTable, process_new
from ranksight.streaming.incremental import index_available


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "k string, v int")
    assert t.version() == 0 and t.snapshot().count() == 0 and t.changes(0).count() == 0
    mk = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    assert t.commit(mk(("a", 1), ("b", 2), ("b", 2))) == 1
    assert t.merge(mk(("a", 1), ("b", 3), ("c", None)), ["k"]) == 2
    assert rows(t.snapshot().fillna(-1)) == [("a", 1), ("b", 3), ("b", 3), ("c", -1)]
    assert rows(t.snapshot(1)) == [("a", 1), ("b", 2), ("b", 2)]
    assert rows(t.changes(1, 2).fillna(-1)) == [("b", 2, "delete"), ("b", 2, "delete"), ("b", 3, "insert"), ("b", 3, "insert"), ("c", -1, "insert")]
    t.commit(removed=t.manifest(1).added)
    assert rows(t.changes(2, 3)) == [("a", 1, "delete")]
    assert rows(t.changes(0, 3).fillna(-1)) == [("b", 3, "insert"), ("b", 3, "insert"), ("c", -1, "insert")]
    assert t.changes(3, 3).count() == 0


def test_checkpoints_and_dead_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "CHECKPOINT", 2)
    t = VersionedTable(spark, str(tmp_path / "t"), "k int")
    mk = lambda *r: spark.createDataFrame([(x,) for x in r], "k int")
    for i in range(5):
        t.commit(mk(i), removed=t.manifest(i).added if i == 2 else None, properties={"processed:c": str(i)} if i == 3 else None)
    assert t.folder.names("checkpoints") == [f"{v:020d}.json" for v in (2, 4)]
    assert rows(t.snapshot()) == [(0,), (2,), (3,), (4,)] and rows(t.snapshot(2)) == [(0,), (1,)] and t.processed("c") == 3
    assert rows(t.changes(2, 5)) == [(1, "delete"), (2, "insert"), (3, "insert"), (4, "insert")]
    assert t.drop_dead(5) == 1 and t.snapshot().count() == 4
    assert t.merge(mk(0, 2, 3, 4), ["k"], whole=True) == 5 and t.merge(mk(0, 9), ["k"], whole=True) == 6 and rows(t.snapshot()) == [(0,), (9,)]


def test_store_changes_tables_together(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), {"a": "k int", "b": "k int"})
    mk = lambda *r: spark.createDataFrame([(x,) for x in r], "k int")
    s.commit({"a": (mk(1), None), "b": (mk(2, 3), None)})
    s["a"].write(mk(7))  # a run that died before its manifest
    s.commit({"b": (mk(4), s["b"].snapshot(positions=True).where("k = 2").select("_file", "_row"))})
    assert rows(s["a"].snapshot()) == [(1,)] and rows(s["b"].snapshot()) == [(3,), (4,)] and rows(s["b"].snapshot(1)) == [(2,), (3,)]
    with pytest.raises(FileExistsError):
        s.commit({"a": (mk(1), None)}, base=1)


def test_two_writers(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "k string")
    one = spark.createDataFrame([("a",)], "k string")
    t.commit(one)
    with pytest.raises(FileExistsError):
        t.commit(one, base=0)
    assert t.version() == 1


def test_exactly_once_over_failures(spark, tmp_path):
    src, out = (VersionedTable(spark, str(tmp_path / n), "k int") for n in ("src", "out"))
    mk = lambda *r: spark.createDataFrame([(x,) for x in r], "k int")
    step = lambda d: d.where("change = 'insert'").select("k")
    src.commit(mk(1, 2))
    assert process_new(src, out, "c", step) == 1 and process_new(src, out, "c", step) is None
    src.commit(mk(3))

    def fails(d):
        return step(d).withColumn("k", F.raise_error(F.lit("lost")).cast("int"))

    with pytest.raises(Exception, match="lost"):
        process_new(src, out, "c", fails)
    assert out.processed("c") == 1
    src.commit(mk(4))
    process_new(src, out, "c", step)
    assert rows(out.snapshot()) == [(1,), (2,), (3,), (4,)] and out.processed("c") == 3


T0 = dt.datetime(2026, 3, 1)


def due(spark, scans, files=(), sources=(), runs=(), tmp=None):
    ts = lambda h: None if h is None else T0 + dt.timedelta(hours=h)
    scan = spark.createDataFrame([(1, k, i, m, ts(s), ts(s)) for k, i, m, s in scans], "run_id long, item_kind string, item_key string, seen_mark string, seen_at timestamp_ntz, loaded_at timestamp_ntz")
    f = spark.createDataFrame([(p, h, ts(a)) for p, h, a in files], "path string, content_hash string, indexed_at timestamp_ntz")
    s = spark.createDataFrame([(k, "x", "p", m, 1, ts(a)) for k, m, a in sources], "source_key string, agent string, src_path string, fingerprint string, chunk_count int, indexed_at timestamp_ntz")
    r = spark.createDataFrame([(i, k, ts(a), None, o) for i, (k, a, o) in enumerate(runs)], "run_id long, item_kind string, started_at timestamp_ntz, finished_at timestamp_ntz, outcome string")
    return {tuple(x) for x in incremental.items_to_index(scan, f, s, r).collect()}


def test_incremental_cases(spark):
    runs = [("file", 1, "ok"), ("file", 30, "failed"), ("file", 60, "ok"), ("source", 1, "ok"), ("source", 90, None)]
    h = "0123456789abcdef"
    files = [("same.md", h, 2), ("other.md", h, 2), ("failed.md", h, 31), ("both.md", h, 2), ("both.md", "f" * 64, 61), ("./a\\b.md", h.upper() + "f" * 48, 2), ("early.md", h, 0), ("null.md", h, None), ("gone.md", h, 2), (None, h, 2)]
    scans = [
        ("file", "same.md", h, 70), ("file", "same.md", "e" * 16, 60), ("file", "same.md", None, 80), ("file", "other.md", "e" * 16, 70), ("file", "failed.md", h, 70), ("file", "both.md", "f" * 16, 70), ("file", ".\\a/b.md", h, 70),
        ("file", "early.md", h, 70), ("file", "null.md", h, 70), ("file", "new.md", h, 70), ("file", "unread.md", None, 70), ("file", "gone.md", None, 70), ("source", "s1", "1|2", 70), ("source", "s2", "1|2", 70), ("source", "s3", "1|2", 95), ("file", None, h, 70),
    ]
    sources = [("s1", "1|2", 5), ("s2", "1|3", 5), ("s3", "1|2", 91)]
    want = {("file", x) for x in ("other.md", "failed.md", "early.md", "null.md", "new.md", "unread.md")} | {("source", "s2"), ("source", "s3")}
    assert due(spark, scans, files, sources, runs) == want
    assert due(spark, scans + scans, files + files, sources, runs) == want
    assert due(spark, []) == set() and due(spark, [("file", "a", h, 1)]) == {("file", "a")}


def test_plan_over_runs(spark, tmp_path, monkeypatch):
    """Nothing is lost by a second run, a crash between commits, or an item that changes, goes and comes back."""
    marks = lambda **m: spark.createDataFrame(list(m.items()), "item_key string, mark string").select(F.lit("file").alias("item_kind"), "item_key", "mark")

    def run(seen, held, dies=False):
        plan = incremental.IndexPlan(spark, str(tmp_path / "plan"))
        plan.hold(marks(**held))
        plan.see(marks(**seen))
        if dies:
            with monkeypatch.context() as m:
                m.setattr(plan.waiting.folder, "create", lambda *a: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(OSError, match="lost"):
                    plan.due()
            return None
        return sorted(r.item_key for r in plan.due().collect()), plan.waiting.version()

    assert run({"a": "1", "b": "2", "c": "3", "d": None}, {"a": "1", "b": "1"}) == (["b", "c", "d"], 1)
    assert run({"a": "1", "b": "2", "c": "3", "d": None}, {"a": "1", "b": "1"}) == (["b", "c", "d"], 1)  # nothing new, no version
    run({"a": "9", "b": "2", "c": "3"}, {"a": "1", "b": "2"}, dies=True)
    assert run({"a": "9", "b": "2", "c": "3"}, {"a": "1", "b": "2"}) == (["a", "c"], 2)
    assert run({"b": "2", "c": "3"}, {"a": "1", "b": "2"}) == (["c"], 3)  # a is gone
    assert run({"a": "1", "b": "2", "c": "3"}, {"a": "1", "b": "2", "c": "3"}) == ([], 4)  # back with its old mark
    assert run({"a": "1", "b": "2", "c": "3"}, {"b": "2", "c": "3"}) == (["a"], 5)


def test_diff_and_freshness(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "p string, m string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("w", "1"), ("z", None)], "p string, m string")
    assert dict(rows(lifecycle.diff(a, b, ["p"], "m"))) == {"x": "same", "y": "changed", "w": "removed", "z": "same"}
    assert tuple(lifecycle.freshness(a, b, ["p"], "m").first()) == (0, 1, 1, 2)
    assert tuple(lifecycle.freshness(a.limit(0), b.limit(0), ["p"], "m").first()) == (0, 0, 0, 0)


@given(st.lists(st.integers(0, 9), max_size=25), st.integers(0, 30))
@settings(max_examples=4, deadline=None)
def test_budgets(spark, sizes, budget):
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, n int")
    soft, left, hard, before = [], budget, [], 0
    for i, s in enumerate(sizes):
        if before < budget:
            soft.append(i)
        before += s
        if i == 0 or s <= left:
            hard.append(i)
            left -= s
            if left <= 0:
                break
    ranked = lifecycle.places(items, [F.desc("n"), F.col("i")], 3).collect()
    assert {r.i: r.place for r in ranked} == {i: k + 1 for k, (_, i) in enumerate(sorted((-s, i) for i, s in enumerate(sizes)))}
    assert sorted(r.i for r in lifecycle.soft_budget(items, "n", [F.col("i")], budget, 3).collect()) == soft
    assert sorted(r.i for r in lifecycle.hard_budget(items, "n", [F.col("i")], budget).collect()) == hard


def test_store_operations(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "c"), "p string, n int")
    mk = lambda *r: spark.createDataFrame(list(r), "p string, n int")
    t.commit(mk(("a", 1), ("a", 2), ("b", 3)))
    lifecycle.replace_chunks(t, mk(("a", 0), ("c", 0)), mk(("a", 9)), ["p"])
    assert rows(t.snapshot()) == [("a", 9), ("b", 3)]
    assert rows(lifecycle.collect_garbage(t.snapshot(), mk(("b", 0)), ["p"])) == [("b", 3)]
    assert rows(lifecycle.orphans(t.snapshot(), mk(("b", 0)), ["p"])) == [("a", 9)]
    assert dict(rows(lifecycle.zero_filled(mk(("a", 1)), "p", ("a", "z")))) == {"a": 1, "z": 0}
    meta = lifecycle.Meta(spark, str(tmp_path / "m"))
    meta.set("x", [1])
    meta.set("x", {"a": 2})
    assert meta.get("x") == {"a": 2} and meta.get("y", 5) == 5
    root = str(tmp_path / "idx")
    first = lifecycle.publish(spark, root, lambda p: None)
    with pytest.raises(RuntimeError, match="not published"):
        lifecycle.publish(spark, root, lambda p: None, lambda: "unfinished")
    assert lifecycle.current(spark, root) == first
    with lifecycle.RebuildLock(spark, root):
        with pytest.raises(BlockingIOError):
            lifecycle.RebuildLock(spark, root).__enter__()
        with lifecycle.RebuildLock(spark, root, stale=0):
            pass
    with lifecycle.RebuildLock(spark, root):
        pass


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200), (202, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {}
    for n, c in connected_components(df).collect():
        got.setdefault(c, set()).add(n)
    assert got == {0: set(range(61)), 100: set(range(100, 140)), 200: {200, 201, 202}}
    assert connected_components(df.limit(0)).count() == 0


def test_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, t string")
    df.write.parquet(src)
    t = VersionedTable(spark, str(tmp_path / "out"), "i int")
    step = lambda b: b.select("i")
    run = lambda: index_available(spark, src, df.schema, t, step, str(tmp_path / "cp"))
    run()
    run()
    df.withColumn("i", F.col("i") + 10).write.mode("append").parquet(src)
    run()
    assert rows(t.snapshot()) == [(1,), (2,), (11,), (12,)]


def test_executors_get_the_package(tmp_path):
    """A program elsewhere that only knows the path of the repository."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from ranksight.runtime import build_session
from ranksight.functions.markdown import chunk_files
spark = build_session(2)
df = spark.createDataFrame([("a.md", "# T")], "path string, content string")
print("ROWS", chunk_files(df).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS 1" in done.stdout, done.stderr[-2000:]
