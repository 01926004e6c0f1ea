import numpy as np
import pytest
from pyspark.sql import functions as F

from ranksight.llm import vectors as V


def brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in range(len(ids)):
        s = np.round(x @ x[i], 9)
        s[i] = -9
        out[int(ids[i])] = [int(ids[j]) for j in np.lexsort((ids, -s))[:k] if j != i]
    return out


def found(df):
    got = {}
    for r in df.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbor_id)
    return got


def recall(got, want):
    return sum(len(set(got.get(i, ())) & set(n)) for i, n in want.items()) / max(1, sum(map(len, want.values())))


def test_priority_queue_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = V.KMeansTree.fit(x, 40, 4, 1)
    assert tree.n_leaves > 40 and (np.bincount(tree.label) <= 40).mean() > 0.95
    q = x[:30]
    key = tree.priorities(q)
    for i in range(len(q)):
        order = tree.pop_order(q[i])
        assert sorted(order) == list(range(tree.n_leaves))
        popped = key[i, order]
        assert (popped[1:] <= popped[:-1] + 1e-5).all()


@pytest.mark.parametrize("shard_rows", [300, 10_000])
def test_recall(spark, shard_rows):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 64))
    x = centre[rng.integers(0, 40, 3000)] + rng.normal(scale=0.4, size=(3000, 64))
    ids = rng.permutation(3000) + 5
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    df = spark.createDataFrame(rows + rows[:200], "chunk_id long, embedding array<float>").repartition(6)
    got = found(V.nearest_vectors(df, V.NeighborConfig(shard_rows=shard_rows, sample=1500)))
    assert recall(got, brute(ids, x.astype(np.float32).astype(float), 5)) >= 0.95
    assert len(got) == 3000 and all(len(n) == 5 for n in got.values())


def test_many_shards_are_not_visited_by_every_row(spark, monkeypatch):
    """Groups of eight among hundreds of shards: shards that a row opens in all trees together."""
    rng = np.random.default_rng(6)
    x = (np.repeat(rng.normal(size=(800, 64)), 8, axis=0) + rng.normal(scale=0.12, size=(6400, 64))).astype(np.float32)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<float>").repartition(4)
    opened, search = [], V._search

    def counted(source, tree, margin, *rest):
        key = tree.priorities(unit)
        opened.append((key >= key.max(axis=1, keepdims=True) - margin).sum() / len(unit))
        return search(source, tree, margin, *rest)

    monkeypatch.setattr(V, "_search", counted)
    got = found(V.nearest_vectors(df, V.NeighborConfig(shard_rows=32, calibration=200)))
    assert sum(opened) <= 5, opened
    assert recall(got, brute(np.arange(len(x)), x.astype(float), 5)) >= 0.95
    assert all(len(n) == len(set(n)) == 5 for n in got.values()) and len(got) == len(x)


def test_a_third_are_copies_and_hot_shards(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(600, 64)), np.tile(rng.normal(size=(1, 64)), (300, 1)), np.tile(rng.normal(size=(1, 64)), (3, 1))]).astype(np.float32)
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "chunk_id long, embedding array<float>").repartition(5)
    got = found(V.nearest_vectors(df, V.NeighborConfig(shard_rows=150, shard_cap=60, sample=500, recall=1.0)))
    want = brute(ids, x.astype(float), 5)
    hot = sorted(ids[600:900].tolist())
    for i in hot:
        assert got[i] == [j for j in hot[:6] if j != i][:5]
    assert recall(got, want) >= 0.97 and len(got) == len(x)


def test_ties_of_scaled_vectors_go_to_the_smaller_id(spark):
    """More vectors of one direction, and none bit-equal after normalising, than a leaf's best hold."""
    rng = np.random.default_rng(4)
    one = rng.normal(size=64)
    x = np.concatenate([np.outer(1.0 + np.arange(60) * 0.37, one), rng.normal(size=(200, 64))]).astype(np.float32)
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "chunk_id long, embedding array<float>").repartition(3)
    got = found(V.nearest_vectors(df, V.NeighborConfig(recall=1.0)))
    same = sorted(ids[:60].tolist())
    assert all(got[i] == [j for j in same[:6] if j != i][:5] for i in same)


def test_dirty_rows_and_clashing_columns(spark):
    e = [1.0] + [0.0] * 63
    f = [0.0, 1.0] + [0.0] * 62
    rows = [(1, e, "x"), (1, e, "x"), (2, [2 * v for v in e], "x"), (3, f, None), (None, e, "x"), (4, None, "x"), (5, [0.0] * 64, "x"), (6, [1.0] * 32, "x"), (7, [float("nan")] + e[1:], "x"), (8, [None] + e[1:], "x")]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, id string").withColumn("rank", F.lit(1)).withColumn("key", F.lit("k"))
    got = found(V.nearest_vectors(df))
    assert got == {1: [2, 3], 2: [1, 3], 3: [1, 2]}
    assert V.nearest_vectors(df.limit(0)).count() == 0 and V.neighbor_pairs(df.where("chunk_id = 4")).count() == 0
    assert V.nearest_vectors(df.where("chunk_id = 3")).count() == 0
    assert sorted(map(tuple, V.neighbor_pairs(df).collect())) == [(1, 2), (1, 3), (2, 3)]
