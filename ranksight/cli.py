"""Command line; results as JSON lines.

    python -m ranksight.cli kb|project index|search|status|reindex ROOT [QUERY] ...
    python -m ranksight.cli sessions index|reindex|search|list|tail|status LOGS [QUERY or SESSION] --agent NAME ...
    python -m ranksight.cli graph degrees|neighbors|two-hops|find ROOT [NAME]
    python -m ranksight.cli maintain lint|fix|dedup ROOT
    python -m ranksight.cli enrich extract|apply|migrate ROOT --model MODULE:FUNCTION
    python -m ranksight.cli tasks list|find|check|next-id|counts|ics|close ROOT [QUERY or ID] ...
"""

from __future__ import annotations

import argparse
import datetime
import importlib
import json
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksight.api import KnowledgeBase, ProjectIndex, SessionIndex
from ranksight.functions.text import owner_of
from ranksight.operators import enrich, graph, knn, quality, tasks
from ranksight.operators.filters import parse_kinds
from ranksight.runtime import build_session
from ranksight.settings import AGENTS, DEDUP_NEIGHBORS, DEDUP_SIMILARITY, MODES, PLANES, SCOPES
from ranksight.sources import sessions as logs
from ranksight.sources import trees
from ranksight.sources.sinks import json_rows, write_texts
from ranksight.sources.trees import IgnoreRules


def find_root(start: str) -> str:
    """The folder from ``start`` upwards that holds ``.agents`` or AGENTS.md; PROJECT_ROOT, if set, goes first."""
    if os.environ.get("PROJECT_ROOT"):
        return os.environ["PROJECT_ROOT"]
    at = os.path.abspath(start)
    while not any(os.path.exists(os.path.join(at, n)) for n in (".agents", "AGENTS.md")):
        up = os.path.dirname(at)
        if up == at:
            raise FileNotFoundError(f"no project at or above {start}")
        at = up
    return at


ACTIONS = {
    "kb": ("index", "search", "status", "reindex"), "project": ("index", "search", "status", "reindex"), "sessions": ("index", "reindex", "search", "list", "tail", "status"),
    "graph": ("degrees", "neighbors", "two-hops", "find"), "maintain": ("lint", "fix", "dedup"), "enrich": ("extract", "apply", "migrate"), "tasks": ("list", "find", "check", "next-id", "counts", "ics", "close"),
}


def named(spec: str | None) -> Callable | None:
    """The function that ``module:function`` names."""
    if not spec:
        return None
    module, _, function = spec.partition(":")
    return getattr(importlib.import_module(module), function)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ranksight")
    p.add_argument("corpus", choices=tuple(ACTIONS))
    p.add_argument("action")
    p.add_argument("root")
    p.add_argument("query", nargs="?")
    p.add_argument("--index", help="folder of the index; <root>/.agents/.index by default")
    p.add_argument("--embedder", help="MODULE:FUNCTION that gives the vectors of a list of texts")
    p.add_argument("--scorer", help="MODULE:FUNCTION that scores a list of (query, text)")
    p.add_argument("--model", help="MODULE:FUNCTION that answers (name, text)")
    p.add_argument("--mode", choices=MODES, help="hybrid with an embedder, else keyword")
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--plane", choices=PLANES, default="knowledge")
    p.add_argument("--scope", choices=SCOPES)
    p.add_argument("--category")
    p.add_argument("--skill")
    p.add_argument("--archived", action="store_true")
    p.add_argument("--kind", default="")
    p.add_argument("--budget", type=int)
    p.add_argument("--agent", choices=AGENTS)
    p.add_argument("--since")
    p.add_argument("--work-dir")
    p.add_argument("--sort", choices=("priority", "deadline", "updated"), default="priority")
    p.add_argument("--priorities", default="high,medium,low")
    p.add_argument("--status")
    p.add_argument("--today", help="YYYY-MM-DD; the current day by default")
    p.add_argument("--write", action="store_true", help="write changed notes back; else they are shown")
    p.add_argument("--remark", default="")
    return p


def show(rows: DataFrame) -> None:
    for r in json_rows(rows).toLocalIterator():
        print(r["value"])


def _changed(rows: DataFrame, root: str, write: bool) -> None:
    if write:
        print(json.dumps({"written": write_texts(rows, root)}))
    else:
        show(rows)


def _text_index(spark: SparkSession, a: argparse.Namespace) -> None:
    root = find_root(a.root) if a.corpus == "project" else a.root
    path = a.index or os.path.join(root, ".agents", ".index", a.corpus)
    embedder, scorer = named(a.embedder), named(a.scorer)
    if a.corpus == "kb":
        index = KnowledgeBase(spark, path, embedder)
    else:
        ignore = os.path.join(root, ".ignore")
        rules = IgnoreRules.parse(open(ignore, encoding="utf-8").read()) if os.path.exists(ignore) else IgnoreRules()  # noqa: SIM115
        index = ProjectIndex(spark, path, embedder, rules=rules)
    if a.action == "index":
        print(json.dumps(index.index(root, a.budget)))
    elif a.action == "reindex":
        index.reindex(root)
    elif a.action == "status":
        show(index.status(root))
    elif not a.query:
        raise SystemExit("search needs a query")
    else:
        how = {"k": a.top_k, "mode": a.mode or ("hybrid" if embedder else "keyword"), "scorer": scorer}
        if a.corpus == "kb":
            rows = index.search(a.query, root=root, plane=a.plane, scope=a.scope, category=a.category, skill=a.skill, archived=a.archived, **how)
        else:
            rows = index.search(a.query, kinds=parse_kinds(a.kind), **how)
        show(rows.orderBy("query_id", "rank"))


def _sessions(spark: SparkSession, a: argparse.Namespace) -> None:
    index = SessionIndex(spark, a.index or os.path.join(a.root, ".index"), named(a.embedder))
    lines = lambda: spark.read.parquet(a.root) if a.agent == "omp" else logs.read_lines(spark, a.root)
    if a.action in ("index", "reindex", "tail") and not (a.agent or a.action == "tail"):
        raise SystemExit(f"{a.action} needs --agent")
    if a.action == "index":
        print(json.dumps({"remaining_chunks": index.index(a.agent, lines(), a.budget)}))
    elif a.action == "reindex":
        index.reindex({a.agent: lines()})
    elif a.action == "list":
        show(index.list(a.agent))
    elif a.action == "status":
        show(index.status())
    elif not a.query:
        raise SystemExit(f"{a.action} needs a query or a session")
    elif a.action == "tail":
        show(index.tail(a.query, a.top_k))
    else:
        show(index.search(a.query, k=a.top_k, mode=a.mode or ("hybrid" if a.embedder else "keyword"), agent=a.agent, since=a.since, work_dir=a.work_dir, scorer=named(a.scorer)).orderBy("rank"))


def _graph(spark: SparkSession, a: argparse.Namespace) -> None:
    g = graph.build(trees.skills(trees.read_tree(spark, a.root, "*.md")))
    start = spark.createDataFrame([(a.query or "",)], "name string")
    show({"degrees": lambda: graph.top_connected(g, a.top_k), "neighbors": lambda: graph.neighbors(g.edges, start), "two-hops": lambda: graph.two_hops(g.edges, start), "find": lambda: graph.match_entities(g.entities, a.query or "")}[a.action]())


def _maintain(spark: SparkSession, a: argparse.Namespace, today: Column) -> None:
    tree = trees.read_tree(spark, a.root, "*.md")
    skills, index = trees.skills(tree), KnowledgeBase(spark, a.index or os.path.join(a.root, ".agents", ".index", "kb"))
    if a.action == "lint":
        show(quality.lint(skills, trees.markdown_files(tree), index.files.snapshot(), today).orderBy("rule", "subject"))
    elif a.action == "fix":
        _changed(quality.fix_references(skills.join(tree.select("path", "content"), "path"), today), a.root, a.write)
    else:
        vectors = index.chunks.snapshot().where("embedding is not null").select("id", "embedding", owner_of(F.col("path")).alias("owner"))
        show(knn.semantic_duplicates(vectors, DEDUP_SIMILARITY, DEDUP_NEIGHBORS, id_col="id").orderBy(F.desc("score"), "a"))


def _enrich(spark: SparkSession, a: argparse.Namespace, today: Column) -> None:
    tree = trees.read_tree(spark, a.root, "*.md")
    skills = trees.skills(tree).join(tree.select("path", "content"), "path")
    if a.action == "migrate":
        g = graph.build(skills)
        show(enrich.migrate_entities(g.mentions, skills)[0])
        return
    ask = named(a.model)
    if ask is None:
        raise SystemExit(f"{a.action} needs --model")
    proposals = enrich.sanitize(enrich.extract(skills, ask), skills)
    if a.action == "extract":
        show(proposals)
    else:
        _changed(enrich.apply(skills, proposals, today), a.root, a.write)


def _tasks(spark: SparkSession, a: argparse.Namespace, today: Column) -> None:
    tree = trees.read_tree(spark, a.root, "*.md")
    notes = trees.task_files(tree, with_archive=a.archived or a.action in ("check", "next-id", "close"))
    order = tasks.order(a.sort, tuple(a.priorities.split(",")))
    if a.action == "list":
        show(notes.where(tasks.matches(status=a.status)).orderBy(*order).drop("body"))
    elif a.action == "check":
        show(tasks.check(notes, ("id", "title", "status"), {}, ("created", "updated", "deadline"), numbered=True))
    elif a.action == "next-id":
        show(tasks.next_id(notes, F.col("id").try_cast("long")))
    elif a.action == "counts":
        show(tasks.group_counts(notes, ("status", "priority", "sphere")))
    elif a.action == "ics":
        show(tasks.calendar(notes, "19700101T000000Z"))
    elif not a.query:
        raise SystemExit(f"{a.action} needs a query or an id")
    elif a.action == "find":
        index = KnowledgeBase(spark, a.index or os.path.join(a.root, ".agents", ".index", "kb"))
        show(tasks.first_hits(index.search(a.query, k=a.top_k, mode="keyword", plane="tasks"), notes).drop("body"))
    else:
        one = notes.where(F.col("id") == a.query).select("path").join(tree.select("path", "content"), "path")
        done = tasks.close(one, {"status": a.status or "done", "updated": a.today or datetime.date.today().isoformat()}, "tasks/archive", a.remark)
        if a.write:
            moved = [r["path"] for r in done.select("path").collect()]  # one note
            _changed(done.select(F.col("target").alias("path"), "content"), a.root, True)
            for path in moved:
                os.remove(os.path.join(a.root, path))
        else:
            show(done)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.action not in ACTIONS[a.corpus]:
        raise SystemExit(f"{a.corpus} has the actions {', '.join(ACTIONS[a.corpus])}")
    spark = build_session()
    today = F.lit(a.today).cast("date") if a.today else F.current_date()
    if a.corpus in ("kb", "project"):
        _text_index(spark, a)
    elif a.corpus in ("sessions", "graph"):
        {"sessions": _sessions, "graph": _graph}[a.corpus](spark, a)
    else:
        {"maintain": _maintain, "enrich": _enrich, "tasks": _tasks}[a.corpus](spark, a, today)


if __name__ == "__main__":
    main()
