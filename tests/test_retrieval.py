"""BM25 against SQLite's FTS5, neighbours and joins against brute force, fusion and search."""

import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranksight.operators import bm25 as B
from ranksight.operators import filters, fusion, knn
from ranksight.operators.search import SearchCorpus, embed, hashing_embedder, search

DOCS = [
    (1, "run vector search run", "entity-grafana", "Intro to run"), (2, "vector direction_restor fast", "a", "b c d e f"), (3, "plain text about run time of café ёлка", "run", "x"), (4, "nothing here", "vector", "run"),
    (5, "restor direction", "q", "w"), (6, "misc words only", "q", "w"), (7, "other lorem ipsum", "q", "w"), (8, "run", "q", None),
]


@pytest.fixture(scope="module")
def index(spark):
    rows = spark.createDataFrame(DOCS, "id int, st string, sk string, hd string")
    return B.InvertedIndex.build(rows, "id", F.col("st"), ("sk", "hd"))


def ask(spark, *queries):
    return B.query_terms(spark.createDataFrame(list(enumerate(queries)), "query_id int, query string"))


def test_bm25_published_values(spark, index):
    got = {(r.query_id, r.id): r.score for r in B.bm25(index, ask(spark, "run", "run vector", "run run", "direction_restor"), 10).collect()}
    want = {(0, 8): 0.6238667905, (0, 1): 0.5490027757, (0, 3): 0.3590567158, (1, 1): 1.3505913653, (1, 2): 0.7590577286, (2, 8): 1.2477335811, (3, 2): 1.2785365288}
    for k, v in want.items():
        assert abs(got[k] - v) < 1e-8
    assert (3, 5) not in got


def test_bm25_against_fts5(spark, index):
    try:
        con = sqlite3.connect(":memory:")
        con.execute("create virtual table t using fts5(st, sk, hd, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    con.executemany("insert into t(rowid, st, sk, hd) values (?, ?, ?, ?)", [(i, a, b, c or "") for i, a, b, c in DOCS])
    for q in ("run", "vector search", "lorem text run"):
        match = "st : (" + " OR ".join(f'"{w}"' for w in q.split()) + ")"
        want = [(r[0], round(-r[1], 8)) for r in con.execute("select rowid, rank from t where t match ? order by rank, rowid", (match,))]
        got = [(r.id, round(r.score, 8)) for r in B.bm25(index, ask(spark, q), None).orderBy("rank").collect()]
        assert got == want


def test_bm25_edges(spark, index):
    assert B.bm25(index, ask(spark, None, "", "zzzz"), 5).count() == 0
    only = spark.createDataFrame([(3,)], "id int")
    assert [r.id for r in B.bm25(index, ask(spark, "run"), 1, only).collect()] == [3]
    empty = spark.createDataFrame([], "id int, st string")
    assert B.bm25(B.InvertedIndex.build(empty, "id", F.col("st")), ask(spark, "run"), 5).count() == 0
    inverse = [r.id for r in B.bm25(index, ask(spark, "run"), 3, inverse=True).orderBy("rank").collect()]
    assert inverse == [3, 1, 8]


def test_index_round_trip(spark, index, tmp_path):
    index.save(str(tmp_path))
    again = B.InvertedIndex.load(spark, str(tmp_path))
    a, b = (sorted((r.id, r.score) for r in B.bm25(x, ask(spark, "run vector"), None).collect()) for x in (index, again))
    assert a == b


def vectors(spark, n=200, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[n // 2 :] = x[: n - n // 2] + rng.normal(scale=0.05, size=(n - n // 2, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, x[i].tolist(), f"o{i % 3}") for i in range(n)] + [(900, None, "o0"), (901, [1.0], "o1"), (None, x[0].tolist(), "o0"), (902, [float("nan")] * dim, "o1")]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, owner string").repartition(5)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest(spark, metric):
    x, v = vectors(spark)
    q = v.where("vec_id < 10").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in knn.nearest(v, q, 4, metric=metric, skip_self=True).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    for i in range(10):
        s = x @ x[i] if metric == "cosine" else 1 - np.linalg.norm(x - x[i], axis=1) / 2
        s[i] = -9
        assert [b for _, b in sorted(got[i])] == np.lexsort((np.arange(len(s)), -s))[:4].tolist()


def test_nearest_ties_and_empty(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "vec_id long, embedding array<double>").repartition(7)
    q = same.where("vec_id = 3").select(F.col("vec_id").alias("query_id"), "embedding")
    assert [r.id for r in knn.nearest(same, q, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert knn.nearest(same.limit(0), q, 3).count() == 0 and knn.nearest(same, q.limit(0), 3).count() == 0


@pytest.mark.parametrize("metric,threshold,cell_rows", [("l2", 0.9, 7), ("cosine", 0.95, 40), ("l2", 0.4, 40)])
def test_nearest_of_others(spark, metric, threshold, cell_rows):
    x, v = vectors(spark, 400)
    v = v.unionByName(v.where("vec_id < 5"))  # delivered twice
    owner = np.arange(len(x)) % 3
    want = set()
    for i in range(len(x)):
        s = x @ x[i] if metric == "cosine" else 1 - np.linalg.norm(x - x[i], axis=1) / 2
        s[(owner == owner[i]) | (s <= threshold)] = -9
        want |= {(i, j) for j in np.lexsort((np.arange(len(s)), -s))[:3].tolist() if s[j] > -9}
    got = [(r.id, r.other) for r in knn.nearest_of_others(v, threshold, 3, metric=metric, cell_rows=cell_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert knn.nearest_of_others(v.limit(0), threshold, 3).count() == 0


def test_nearest_of_others_with_copies(spark):
    """A third of the rows are one vector: its smallest ids of other owners come out, and no pair list is made."""
    rows = [(i, [1.0, 0.0], f"o{i % 2}") for i in range(300)] + [(1000 + i, [float(np.cos(i)), float(np.sin(i))], "c") for i in range(1, 90)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, owner string").repartition(3)
    got = {}
    for r in knn.nearest_of_others(v, 0.999999, 3, cell_rows=20).collect():
        got.setdefault(r.id, set()).add(r.other)
    assert all(got[i] == ({1, 3, 5} if i % 2 == 0 else {0, 2, 4}) for i in range(300))


def test_nearest_of_others_sends_rows_once(spark):
    """where vectors lie in groups with gaps between, shuffles hold a few copies of the table, not one for many cells."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 64)).repeat(10, axis=0)
    x += rng.normal(scale=0.05, size=x.shape) * np.linspace(0.5, 4, len(x))[:, None]
    x = x.astype(np.float32)
    v = spark.createDataFrame([(i, e.tolist(), f"o{i % 7}") for i, e in enumerate(x)], "vec_id long, embedding array<float>, owner string").repartition(4)
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    got = {(r.id, r.other) for r in knn.nearest_of_others(v, 0.9872, 3, metric="cosine").collect()}
    assert written() - before < 8 * x.nbytes
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    s = u @ u.T
    s[(np.arange(len(x))[:, None] - np.arange(len(x))) % 7 == 0] = -9
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:3] if s[i, j] > 0.9872}
    assert got == want and len(want) > 1_000


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, id string, score double, source string")


def test_fusion(spark):
    (one,) = fusion.reciprocal_ranks(hits(spark, [(0, "a", 0.8, "bm25"), (0, "a", 0.9, "vec")])).collect()
    assert one.id == "a" and abs(one.score - 2 / 61) < 1e-12
    best = fusion.best_scores(hits(spark, [(0, "a", 0.8, "x"), (0, "a", 0.9, "y"), (0, "b", 0.9, "y")])).orderBy("rank").collect()
    assert [(r.id, r.score) for r in best] == [("a", 0.9), ("b", 0.9)]
    rows = spark.createDataFrame([(0, "a", 2.0, "global"), (0, "b", 1.0, "global"), (0, "c", 0.5, "project"), (1, "d", -1.0, "global")], "query_id int, id string, score double, origin string")
    got = fusion.merge_origins(rows, 3).orderBy("query_id", "rank").collect()
    assert [(r.id, r.score) for r in got] == [("c", 1.0), ("a", 1.0), ("b", 0.5), ("d", 0.0)]


def test_abstention(spark):
    rows = spark.createDataFrame([(None, None), (0.95, None), (0.89, None), (0.95, 0.95)], "a double, b double")
    assert [r[0] for r in rows.select(fusion.low_confidence(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]
    s = spark.createDataFrame([(None,), (0.517,), (0.518,)], "s double").select(fusion.absent_by_similarity(F.col("s"))).collect()
    assert [r[0] for r in s] == [None, True, False]


def test_search_modes(spark):
    docs = spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(["red apple pie", "green apple", "blue sky over sea", "red sea", None, ""])], "id long, text string, skill string")
    e = hashing_embedder(16)
    vec = embed(docs, e).where("embedding is not null").select("id", "embedding")
    asked = embed(spark.createDataFrame([(0, "red apple"), (1, "nothing of this")], "query_id int, query string"), e, "query")
    corpus = SearchCorpus(docs, B.InvertedIndex.build(docs, "id", F.col("text"), ("skill",)), vec)
    for mode in ("keyword", "semantic", "hybrid"):
        got = search(corpus, asked, 2, mode).where("query_id = 0").orderBy("rank").collect()
        assert got[0].id == 0 and len(got) == 2 and got[0].snippet == "red apple pie"
    only = spark.createDataFrame([(1,)], "id long")
    assert {r.id for r in search(corpus, asked, 2, "hybrid", allowed=only).collect()} == {1}
    turned = search(corpus, asked, 2, "keyword", scorer=lambda pairs: [float(len(t)) for _, t in pairs]).where("query_id = 0").orderBy("rank").collect()
    assert [r.id for r in turned] == [0, 1]

    def broken(pairs):
        raise OSError("down")

    assert [r.id for r in search(corpus, asked, 2, "keyword", scorer=broken).where("query_id = 0").orderBy("rank").collect()] == [0, 1]
    with pytest.raises(ValueError):
        search(corpus, asked, 2, "other")
    with pytest.raises(RuntimeError):
        search(SearchCorpus(docs, corpus.index), asked, 2, "semantic")


def test_filters(spark):
    chunks = spark.createDataFrame([(1, "a/x.md"), (2, "b/y.md"), (3, "tasks/1-x.md"), (4, "streams/s/README.md"), (5, "loose.md")], "id int, file_path string")
    skills = spark.createDataFrame([("a", "A", "a", "shared", "c1", "active"), ("b", "B", "b", "project", "c2", "archived")], "owner string, name string, dir string, scope string, category string, status string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(filters.filter_chunks(chunks, skills)) == [1, 4, 5]
    assert ids(filters.filter_chunks(chunks, skills, archived=True, plane="all")) == [1, 2, 3, 4, 5]
    assert ids(filters.filter_chunks(chunks, skills, skill="A")) == [1] and ids(filters.filter_chunks(chunks, skills, scope="project")) == []
    assert ids(filters.filter_chunks(chunks, plane="tasks")) == [3] and ids(filters.filter_chunks(chunks, plane="skills")) == [1, 2, 5]
    with pytest.raises(ValueError):
        filters.in_plane(F.col("x"), "nowhere")
    s = spark.createDataFrame([("claude", 1.7e9, "/W/Proj"), ("claude", None, "/w/proj"), ("omp", 1.8e9, None)], "agent string, ts double, work_dir string")
    assert s.where(filters.session_filter("claude", "2023-01-01", "PROJ")).count() == 1
    with pytest.raises(ValueError):
        filters.session_filter(since="yesterday")
    assert filters.parse_kinds("docs,zzz") == ("docs",) and filters.parse_kinds("zzz") == ("skill", "docs", "code")
