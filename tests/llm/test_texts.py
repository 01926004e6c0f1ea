"""Frequencies, splitting, leaks, mixtures and repetition."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ranksight.llm import leakage, mixture, repetition, splitting, terms
from ranksight.llm.shingles import words_of

# ---- frequencies


def test_name_frequencies(spark):
    rows = [(f"s{i}", "Hot Name") for i in range(30)] + [(" S1 ", "hot_-name"), (None, "HOT  name"), ("s1", None), ("s1", "  "), ("s2", "Two"), ("s3", "two"), ("s3", "two"), (None, "null only"), ("s4", "a__b"), ("s5", "A - B"), ("s6", " a b")]
    df = spark.createDataFrame(rows, "skill_name string, entity_name string").withColumns({"entity": F.lit("x"), "n": F.lit(1), "mark": F.lit(0)})
    got = {r.entity: (r.n_rows, r.n_records, r.mark) for r in terms.name_frequencies(df).collect()}
    assert got == {"hot-name": (32, 30, "common"), "two": (3, 2, "rare"), "null-only": (1, 0, "rare"), "a-b": (3, 3, None)}
    assert terms.name_frequencies(df.limit(0)).count() == 0


def test_hot_name(spark):
    df = spark.range(30_000).select(F.concat(F.lit("s"), (F.col("id") % 500).cast("string")).alias("skill_name"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("n"), F.col("id").cast("string"))).alias("entity_name"))
    hot = terms.name_frequencies(df).where("entity = 'hot'").first()
    assert (hot.n_rows, hot.n_records, hot.mark) == (10_000, 500, "common")


def test_text_terms(spark):
    df = spark.createDataFrame([(1, "a b_a"), (2, "A c"), (3, None), (4, "")], "doc_id int, text string")
    got = {r.term: (r.n_occurrences, r.n_records, r.mark) for r in terms.text_term_frequencies(df, terms.FrequencyBounds(2, 0.4)).collect()}
    assert got == {"a": (3, 2, "common"), "b": (1, 1, "rare"), "c": (1, 1, "rare")}


# ---- splitting


def pieces(text, cfg=splitting.SplitConfig()):
    _, start, end = splitting.split_texts([text], cfg)
    return list(zip(start.tolist(), end.tolist()))


def check_pieces(text, cfg=splitting.SplitConfig()):
    got = pieces(text, cfg)
    if len(text) <= cfg.limit:
        assert not got
        return
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for a, b in got:
        assert 0 < b - a <= cfg.limit
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a < c <= b and b - c <= cfg.overlap and d > b


@given(st.text(alphabet="ab .\n#`-é\r", max_size=600), st.integers(20, 120), st.integers(0, 19))
@settings(max_examples=300, deadline=None)
def test_piece_invariants(text, limit, overlap):
    check_pieces(text, splitting.SplitConfig(limit, overlap))


def test_every_piece_brings_something_new():
    """With an overlap larger than the least fill, the same end could be chosen again."""
    check_pieces(" `````````````\r```````", splitting.SplitConfig(20, 14))


def sequential(text, cfg):
    """The greedy rule, one cut at a time."""
    pos, kind = splitting.boundaries(text, cfg.limit)
    end, nxt = splitting.successors(pos, kind, np.zeros(len(pos), int), cfg)
    out, at = [], 0
    while True:
        out.append((int(pos[at]), int(pos[end[at]])))
        if nxt[at] == at:
            return out
        at = nxt[at]


def test_doubling_equals_sequential_cuts():
    rng = random.Random(1)
    for _ in range(30):
        text = "".join(rng.choice(["word ", "Sentence. ", "\n", "\n\n", "# head\n", "```\n", "x" * 50]) for _ in range(rng.randint(50, 900)))
        if len(text) > 1500:
            assert pieces(text) == sequential(text, splitting.SplitConfig())


def test_natural_boundaries():
    para = "This is a sentence of some length. " * 12
    text = "\n\n".join(para.strip() for _ in range(12))
    for a, b in pieces(text):
        assert b == len(text) or text[:b].endswith("\n\n")
    head = "intro " * 200 + "\n# Next\n" + "more " * 300
    assert pieces(head)[0][1] == head.index("# Next")
    code = "```\n" + "line of code here\n" * 200 + "```\n"
    for a, b in pieces(code):
        assert code[:b].endswith("\n")
    for text in ("x" * 10_000, " " * 4_000, "é" * 1_501, "a\r\n" * 2_000, "z" * 200_000):
        check_pieces(text)


def test_split_table(spark):
    rows = [(1, "h", "word " * 700), (1, "h", "word " * 700), (2, None, "short"), (3, "x", None), (None, "n", "y" * 1501), (4, "e", "")]
    df = spark.createDataFrame(rows, "chunk_id long, heading string, text string").withColumns({"part": F.lit(9), "start": F.lit("s")})
    got = splitting.split_oversized(df).orderBy("chunk_id", "part").collect()
    assert [(r.chunk_id, r.part) for r in got] == [(None, 1), (None, 2), (1, 1), (1, 2), (1, 3)] and {r.heading for r in got} == {"h", "n"}
    assert splitting.split_oversized(df.limit(0)).count() == 0


# ---- leaks


def leaks_brute(docs, items, n=12):
    out = set()
    for d, t in docs:
        w = words_of(t)
        runs = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for k, q in items:
            v = words_of(q)
            if d is not None and k is not None and any(tuple(v[i : i + n]) in runs for i in range(len(v) - n + 1)):
                out.add((d, k))
    return out


def test_leaks(spark):
    rng = random.Random(3)
    word = lambda: f"w{min(int(rng.expovariate(0.15)), 60)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 40)))) for i in range(40)] + [(90, None), (None, "w1 " * 20), (91, "same same " * 10)]
    docs = []
    for d in range(200):
        w = [word() for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.4:
            q = words_of(rng.choice(items[:40])[1])
            a = rng.randrange(max(1, len(q) - 10))
            at = rng.randint(0, len(w))
            w[at:at] = q[a : a + rng.randint(9, 30)]
        docs.append((d, ", ".join(w)))
    docs += [(500, None), (501, ""), (None, items[0][1]), (502, "SAME " * 40), (502, "SAME " * 40)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).repartition(4)
    t = spark.createDataFrame(items, "item_id long, text string")
    want = leaks_brute(docs, items)
    assert len(want) > 20
    for cfg in (leakage.LeakConfig(), leakage.LeakConfig(block_words=700, query_words=300)):
        assert {tuple(r) for r in leakage.contaminated_documents(d, t, cfg).collect()} == want
    assert leakage.contaminated_documents(d.limit(0), t).count() == 0 and leakage.contaminated_documents(d, t.limit(0)).count() == 0


def test_passages_and_proximity(spark):
    item = " ".join(f"q{i}" for i in range(30))
    near = [f"q{i}" for i in range(15)]
    near[5:5] = ["extra"]
    docs = [(1, "a b " + " ".join(f"q{i}" for i in range(3, 28)) + " c"), (2, " ".join(near)), (3, "q1 q9 q20")]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    got = [tuple(r) for r in leakage.leaked_passages(d, t).collect()]
    assert got == [(1, 7, 2, 3, 25, "exact")]
    loose = {(r.doc_id, r.kind) for r in leakage.leaked_passages(d, t, leakage.LeakConfig(slop=2)).collect()}
    assert loose == {(1, "exact"), (2, "near")}


def near_brute(docs, items, cfg):
    """(document, item) -> most agreeing words of a window at any alignment, without pairs that have an exact passage."""
    out, exact = {}, leaks_brute(docs, items, cfg.words)
    for d, t in docs:
        w = words_of(t)
        for k, q in items:
            v = words_of(q)
            for s in range(-len(v) - cfg.slop, len(w) + cfg.slop + 1):
                hit = [x in w[max(0, s + p - cfg.slop) : max(0, s + p + cfg.slop + 1)] for p, x in enumerate(v)]
                n = max((sum(hit[a : a + cfg.words]) for a in range(len(v) - cfg.words + 1)), default=0)
                if (d, k) not in exact and n >= cfg.near_share * cfg.words:
                    out[d, k] = max(n, out.get((d, k), 0))
    return out


def test_proximity_survives_replaced_words(spark):
    """The rarest word of every window is replaced, or no document has it."""
    item = [f"q{i}" for i in range(12)]
    docs = [(i, " ".join(f"q{j}" for j in range(12) if j != 5)) for i in range(3)]  # q5 is in no document
    docs += [(10 + i, " ".join(["other" if j == i else w for j, w in enumerate(item)])) for i in range(12) if i != 5]
    docs += [(50, "q2 alone"), (51, " ".join(item[:9])), (52, " ".join(item[:4])), (53, " ".join(item[4:8]))]  # parts of neighbours don't add up
    d, t = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    cfg = leakage.LeakConfig(slop=2)
    got = {(r.doc_id, r.item_id): r.n_words for r in leakage.leaked_passages(d, t, cfg).collect()}
    assert got == near_brute(docs, [(7, " ".join(item))], cfg) and len(got) == 15


@pytest.mark.parametrize("cfg", [leakage.LeakConfig(slop=2), leakage.LeakConfig(slop=1, near_share=0.6), leakage.LeakConfig(words=5, slop=1, near_share=0.2), leakage.LeakConfig(words=6, slop=3, near_share=1.0)])
def test_proximity_against_brute_force(spark, cfg):
    rng = random.Random(cfg.words)
    items = [(i, " ".join(f"w{min(int(rng.expovariate(0.05)), 120)}" for _ in range(rng.randint(4, 30)))) for i in range(12)]
    docs = []
    for i in range(120):
        w = [f"w{min(int(rng.expovariate(0.05)), 120)}" for _ in range(rng.randint(0, 15))]
        q = words_of(rng.choice(items)[1])
        a = rng.randrange(len(q))
        q = q[a : a + rng.randint(6, 20)]
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(q) + 1)
            q[k : k + rng.randint(0, 2)] = [f"n{rng.randrange(9)}"] * rng.randint(0, 2)
        at = rng.randint(0, len(w))
        w[at:at] = q
        docs.append((i, " ".join(w)))
    d, t = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    rows = [r for r in leakage.leaked_passages(d, t, cfg).collect() if r.kind == "near"]
    assert {(r.doc_id, r.item_id): r.n_words for r in rows} == near_brute(docs, items, cfg) and len(rows) > 5
    for r in rows:
        assert words_of(docs[r.doc_id][1])[r.doc_word] == words_of(items[r.item_id][1])[r.item_word]


# ---- mixtures


def test_token_sizes_match_the_tokenizer(spark):
    texts = ["Hello, world!  Привет", "", None, "<|endoftext|> x"]
    enc = mixture.encoder(mixture.Tokenizer())
    df = spark.createDataFrame([(i, t, " A-b ") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = mixture.token_sizes(df).orderBy("doc_id").collect()
    assert [r.tokens for r in got] == [len(enc.encode_ordinary(t)) if t else 0 for t in texts] and {r.source for r in got} == {"a_b"}


def test_plan_shares():
    total, use = mixture.plan_shares({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.4, 3), "c": (0.1, 4)})
    assert abs(use["b"] - 30) < 1e-9 and abs(use["a"] - 37.5) < 1e-9 and use["c"] == 0 and abs(total - 67.5) < 1e-9
    total, use = mixture.plan_shares({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.5, 3)}, 100)
    assert use == {"a": 70.0, "b": 30.0} and total == 100
    assert mixture.plan_shares({}, {"a": (1.0, 1)}) == (0.0, {"a": 0.0})
    assert mixture.plan_shares({"a": 10}, {"a": (1.0, 2)}, 1000)[1] == {"a": 20.0}


def test_weight_pieces():
    got = mixture.weight_pieces({"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}, {"a": ((0, 0), (0.5, 1), (1, 0)), "d": ((0, 1), (1, 2))})
    at = lambda s, t: next(w + k * (t - b) for _, b, w, k in reversed(got[s]) if b <= t)
    for t in (0.0, 0.2, 0.5, 0.9, 1.0):
        assert abs(sum(at(s, t) for s in "abc") - 1) < 1e-9 and abs(at("b", t) * 2 - at("c", t) * 3) < 1e-9
    assert [x[0] for x in got["a"]] == [0.0, 0.25] and abs(at("a", 0.5) - 1) < 1e-9
    flat = mixture.weight_pieces({"a": 0.6, "b": 0.4}, {"a": ((0, 0), (0.5, 1), (1, 0))})  # b would be below 0 in the middle
    assert abs(flat["b"][1][2]) < 1e-9 and abs(flat["a"][1][2] - 1) < 1e-9
    assert mixture.weight_pieces({"a": 1.0}, {"a": ((0, 1), (1, 2))})["a"] == [(0.0, 0.0, 1.0, 0.0)]


def docs(spark, n=3000, seed=0):
    rng = random.Random(seed)
    rows = [(i, "word " * rng.randint(1, 60), rng.choice(["big"] * 8 + ["small", "MID", " mid", None, "other"])) for i in range(n)]
    rows += [(n + 1, None, "big"), (n + 2, "", "small"), (None, "lost", "big")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"use": F.lit(0), "start": F.lit("x"), "share": F.lit(1.0)}).repartition(5)


def test_mixture(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.25, 3), ("mid", 0.25, 2), ("gone", 0.1, 5)], "source string, target_share double, max_repeats int")
    cfg = mixture.MixtureConfig(schedules={"big": ((0, 0.4), (0.25, 0.4), (0.5, 0.8), (1, 0.6)), "small": ((0, 2), (1, 0))}, slices=16)
    mix, shares = mixture.training_order(docs(spark), targets, cfg)
    rows = mix.collect()
    assert {r.source: r.most_uses <= r.max_repeats for r in shares.collect()} == {"big": True, "small": True, "mid": True, "gone": True}
    by = {r.source: r for r in shares.collect()}
    for s, w in (("big", 0.5), ("small", 0.25), ("mid", 0.25)):
        assert abs(by[s].actual_share - w) < 0.01
    assert by["gone"].used_tokens == 0 and by["gone"].actual_share == 0.0
    count = Counter((r.doc_id, r.use) for r in rows)
    assert max(count.values()) == 1 and all(0 <= r.position <= 1 for r in rows)
    # the order follows the schedule: tokens of a source in the first half are the integral of its weight
    total = sum(r.tokens for r in rows)
    rows.sort(key=lambda r: r.position)
    half, seen = Counter(), 0
    for r in rows:
        if seen >= total / 2:
            break
        seen += r.tokens
        half[r.source] += r.tokens
    big = 0.5 * (0.25 * 0.4 + 0.25 * 0.6) / 0.6
    small = 0.25 * 0.75
    for s, want in (("big", big), ("small", small), ("mid", 0.5 - big - small)):
        assert abs(half[s] / seen - 2 * want) < 0.02
    again = mixture.training_order(docs(spark).repartition(9), targets, cfg)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_mixture_edges(spark):
    t = spark.createDataFrame([("big", 0.7, 1), ("BIG ", None, None), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    d = docs(spark, 50)
    mix, shares = mixture.training_order(d, t, mixture.MixtureConfig(total=10**9))
    assert mix.groupBy("doc_id").count().where("count > 1").count() == 0 and abs(shares.first().actual_share - 1) < 1e-9
    for a, b in ((d.limit(0), t), (d, t.limit(0)), (d, t.where("source is null"))):
        assert mixture.training_order(a, b)[0].count() == 0
    with pytest.raises(ValueError):
        mixture.training_order(d, t, mixture.MixtureConfig(schedules={"big": ((0, -1), (1, 2))}))


# ---- repetition


def repeated_brute(text, n=5):
    w = words_of(text)
    seen, mark = set(), [False] * len(w)
    for i in range(len(w) - n + 1):
        run = tuple(w[i : i + n])
        if run in seen:
            mark[i : i + n] = [True] * n
        seen.add(run)
    return len(w), sum(mark)


@given(st.lists(st.lists(st.sampled_from("a b c dd e. f|g\n".split(" ") + ["\n", "h_i"]), max_size=60).map(" ".join), max_size=8))
@settings(max_examples=150, deadline=None)
def test_repetition_against_brute_force(texts):
    got = repetition.judge([*texts, None, ""], repetition.CleaningRules(), np.zeros(0, np.uint64))
    want = [repeated_brute(t) for t in [*texts, None, ""]]
    assert list(zip(got["n_words"].tolist(), got["repeated_words"].tolist())) == want
    # what lines lose is never less than what repeats, so no repetitive text escapes the rejection
    assert (got["lost_words"] >= got["repeated_words"]).all()
    assert [v == "repetition" for v in got["verdict"]] == [n > 0 and 10 * r >= 3 * n for n, r in want]


def test_line_rules(spark):
    loop = "one two three four five six\n" * 4
    rows = [
        (1, loop), (2, "A fine sentence here.\n[Home](/h) | [Menu](/m)\nsee [this page](/p) for more on the subject\nhome | about | news | more\n-----\nALL rights reserved, 2024!\n| alpha | beta | gamma |"), (3, None), (4, ""), (5, "***\n!!!"),
        (6, "a b"), (6, "a b"), (7, "word " * 100_000), (8, "short but fine\nhttps://a.example/b\n[[one]] [[two]] x"),
    ] + [(20 + i, f"all rights reserved 2024\ntext number {i} has its own words\nall rights reserved 2024") for i in range(4)] + [(30, "only a\nnote")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"verdict": F.lit("x"), "n_words": F.lit(0)})
    got = {r.doc_id: r for r in repetition.clean_documents(df).collect()}
    assert got[1].verdict == "repetition" and got[1].repeated_words == 18 and got[1].repetition_lines == 3 and got[1].clean_text == "one two three four five six\n"
    assert got[2].clean_text == "A fine sentence here.\nsee [this page](/p) for more on the subject\n| alpha | beta | gamma |"
    assert (got[2].navigation_lines, got[2].boilerplate_lines, got[2].punctuation_lines, got[2].lost_words, got[2].verdict) == (2, 1, 2, 12, "lines")
    assert got[8].navigation_lines == 2 and got[8].clean_text == "short but fine"
    # counted once for a document: five documents hold the line, so it is boilerplate; a line of two words never is
    assert got[20].boilerplate_lines == 2 and got[20].clean_text == "text number 0 has its own words" and got[6].boilerplate_lines == 0
    assert got[3].clean_text is None and got[3].verdict == got[4].verdict == got[5].verdict == "keep"
    assert got[7].repeated_words == 99_999 and repetition.clean_documents(df).count() == len(rows)
    assert repetition.clean_documents(df.limit(0)).count() == 0
