import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranksight.llm import neardup as N
from ranksight.llm.shingles import words_of


def brute(rows, cfg, grouped):
    sets, grp = {}, {}
    for i, t, g in rows:
        w = words_of(t)
        if i is None or len(w) < cfg.min_words or (grouped and g is None) or len(w) < cfg.words:
            continue
        sets[i], grp[i] = {tuple(w[k : k + cfg.words]) for k in range(len(w) - cfg.words + 1)}, (g or "").strip().lower() if grouped else i
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = list(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if grp[ids[a]] != grp[ids[b]] and len(x & y) / len(x | y) >= cfg.similarity:
                parent[find(ids[a])] = find(ids[b])
    out = defaultdict(set)
    for i in ids:
        out[find(i)].add(i)
    return sorted(sorted(g) for g in out.values() if len(g) > 1)


def groups(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r.group_id].add(r.id)
    return sorted(sorted(g) for g in out.values())


def corpus(n, seed, words=40, vocabulary=3000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            w = words_of(rng.choice(rows)[1])
            for _ in range(rng.randint(0, 8)):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 2)] = [f"n{rng.randrange(9999)}"] * rng.randint(0, 2)
                w = w or ["x"]
        else:
            w = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(10, words))]
        rows.append((i, " ".join(w), rng.choice(["a", " A ", "b", "c", None])))
    return rows


@pytest.mark.parametrize("words,similarity,grouped", [(3, 0.5, True), (3, 0.5, False), (5, 0.8, False), (2, 0.3, True)])
def test_against_brute_force(spark, words, similarity, grouped):
    rows = corpus(500, words)
    cfg = N.NearDupConfig(words=words, similarity=similarity, min_words=20)
    df = spark.createDataFrame(rows, "doc_id long, text string, skill string").repartition(5)
    got = N.near_duplicate_groups(df, cfg, group_col="skill" if grouped else None)
    assert groups(got) == brute(rows, cfg, grouped)


def test_short_texts_take_part(spark):
    """From five words on, with a short template in a third of the rows."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(2)}" for _ in range(rng.randint(0, 9))), None) for i in range(300)]
    rows += [(1000 + i, "See the linked task card", None) for i in range(150)] + [(2000, "only four words here", None), (2001, "only four words here", None)]
    cfg = N.NearDupConfig()
    got = groups(N.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string, skill string").repartition(5), cfg))
    assert got == brute(rows, cfg, False) and list(range(1000, 1150)) in got and len(got) > 10


def test_documents_of_five_words_come_out(spark, tmp_path):
    from ranksight.llm.queries import QUERIES

    rows = [(1, "one two three four five"), (2, "One, two, three, four, five!"), (3, "one two three four six"), (4, "too short"), (5, "too short")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in QUERIES["p2_documents"](spark, str(tmp_path)).collect()} == {1, 2}


def test_hot_runs_are_cut_and_lose_nothing(spark):
    """A sentence in every text makes one hot shard per run; blocks of 16 cut them."""
    rng = random.Random(4)
    common = " ".join(f"common{i}" for i in range(30))
    rows = [(i, common + " " + " ".join(f"v{rng.randrange(60)}" for _ in range(rng.randint(0, 14))), "ab"[i % 2]) for i in range(150)]
    cfg = N.NearDupConfig(words=3, similarity=0.5, min_words=20, shard_cap=16, paired=8, pack_rows=500)
    df = spark.createDataFrame(rows, "doc_id long, text string, skill string").repartition(4)
    got = N.near_duplicate_groups(df, cfg, group_col="skill")
    assert groups(got) == brute(rows, cfg, True)


@pytest.mark.parametrize("skills", [("a", "b", "c"), ("a",) * 30 + ("b",)])
def test_families_are_joined_without_their_pairs(spark, skills):
    """Texts on one template, beside others that share a part of it; blocks are small, so all ways are taken."""
    rng = random.Random(len(skills))
    template = [f"t{i}" for i in range(40)]
    rows = [(i, " ".join(w if rng.random() > 0.02 else f"e{rng.randrange(999)}" for w in template) + f" x{i}", rng.choice(skills)) for i in range(400)]
    rows += [(1000 + i, " ".join(template[:20] + [f"o{rng.randrange(30)}" for _ in range(rng.randint(10, 40))]), rng.choice("abc")) for i in range(120)]
    rows += [(2000 + i, " ".join(f"w{rng.randrange(500)}" for _ in range(30)), "a") for i in range(50)]
    cfg = N.NearDupConfig(words=3, similarity=0.5, min_words=20, shard_cap=32, paired=8, part_cap=200, family=16, pack_rows=800)
    df = spark.createDataFrame(rows, "doc_id long, text string, skill string").repartition(4)
    assert groups(N.near_duplicate_groups(df, cfg, group_col="skill")) == brute(rows, cfg, True)


def test_labels_leave_out_pairs():
    rng = np.random.default_rng(1)
    sig = np.repeat(rng.integers(0, 1 << 63, (1, N.BITS // 64), dtype=np.uint64), 60, axis=0)
    sig[::7, 2] ^= np.uint64(5)
    label = rng.integers(0, 4, 60)
    a, b = N.trie_self_join(np.zeros(60, int), sig, np.full(60, 40), N.NearDupConfig(3, 0.5), label)
    want = {(i, j) for i in range(60) for j in range(i) if label[i] != label[j]}
    assert {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist())} == want
    assert len(N.trie_self_join(np.zeros(60, int), sig, np.full(60, 40), N.NearDupConfig(3, 0.5), np.zeros(60))[0]) == 0


def test_a_third_are_copies(spark):
    base = " ".join(f"w{i}" for i in range(30))
    rows = [(i, base, "ab"[i % 2]) for i in range(300)] + [(1000 + i, " ".join(f"x{i}y{k}" for k in range(30)), "a") for i in range(50)]
    got = N.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string, skill string").repartition(6), N.NearDupConfig(3, 0.5), group_col="skill")
    assert groups(got) == [list(range(300))] and got.select("class_id").distinct().count() == 1
    same = [(i, base, "a") for i in range(5)]
    assert N.near_duplicate_groups(spark.createDataFrame(same, "doc_id long, text string, skill string"), N.NearDupConfig(3, 0.5), group_col="skill").count() == 0


def test_trie_join_is_exact():
    rng = np.random.default_rng(0)
    n = 400
    size = rng.integers(20, 60, n)
    sig = rng.integers(0, 1 << 63, (n, N.BITS // 64), dtype=np.uint64)
    for i in range(n // 2, n):  # near copies
        sig[i] = sig[i - n // 2]
        for b in rng.integers(0, N.BITS, rng.integers(0, 30)):
            sig[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        size[i] = size[i - n // 2]
    shard = rng.integers(0, 3, n)
    shard[n // 2 :] = shard[: n // 2]
    cfg = N.NearDupConfig(3, 0.5)
    a, b = N.trie_self_join(shard, sig, size, cfg)
    got = Counter((min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist()))
    want = set()
    for i in range(n):
        for j in range(i + 1, n):
            d = int(np.bitwise_count(sig[i] ^ sig[j]).sum())
            if shard[i] == shard[j] and d <= cfg.budget(size[i], size[j]) and min(size[i], size[j]) >= max(size[i], size[j]) * 0.5:
                want.add((i, j))
    assert set(got) == want and max(got.values()) == 1 and len(want) >= 150
    same = np.zeros((4, N.BITS // 64), np.uint64)
    assert len(N.trie_self_join(np.zeros(4, int), same, np.full(4, 10), cfg)[0]) == 6
    assert len(N.trie_self_join(np.zeros(0, int), same[:0], np.zeros(0, int), cfg)[0]) == 0


def test_budget_loses_no_pair():
    """Signatures differ in at most as many bits as the sets differ in elements."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 60, 50, dtype=np.uint64))
        b = np.unique(np.r_[a[: rng.integers(10, 50)], rng.integers(0, 1 << 60, 10, dtype=np.uint64)])
        s = N.signatures(np.r_[a, b], np.r_[np.zeros(len(a), int), np.ones(len(b), int)], 2)
        assert np.bitwise_count(s[0] ^ s[1]).sum() <= len(np.setxor1d(a, b))


def test_dirty_rows(spark):
    t = " ".join(f"w{i}" for i in range(25))
    rows = [(1, t, "a"), (1, t, "a"), (2, t.upper(), "B "), (None, t, "c"), (3, None, "a"), (4, "", "a"), (5, t, None), (6, "short one", "b"), (7, "z " * 50_000, "a"), (8, "z " * 50_001, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, skill string").withColumns({"id": F.lit("x"), "cls": F.lit(1), "size": F.lit(None), "group_id": F.lit(0)})
    got = N.near_duplicate_groups(df, N.NearDupConfig(3, 0.5), group_col="skill")
    assert groups(got) == [[1, 2], [7, 8]] and got.count() == 4
    assert sorted(map(tuple, N.group_pairs(got).collect())) == [(1, 2), (7, 8)]
    assert N.near_duplicate_groups(df.limit(0), N.NearDupConfig(3, 0.5), group_col="skill").count() == 0
