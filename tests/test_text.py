"""Stems, Markdown, frontmatter and comments."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ranksight.functions import comments as C
from ranksight.functions import markdown as M
from ranksight.functions import text as T
from ranksight.functions.stem import english, russian, stem_identifiers, stem_query, stem_text


@pytest.mark.parametrize(
    "word,stem",
    [("running", "run"), ("consistency", "consist"), ("generously", "generous"), ("happily", "happili"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("skies", "sky"), ("agreed", "agre"), ("ties", "tie"), ("gas", "gas"), ("luxuriating", "luxuri"), ("electricity", "electr"), ("say", "say"), ("cry", "cri"), ("by", "by")],
)
def test_english_vectors(word, stem):
    assert english(word) == stem


@pytest.mark.parametrize("word,stem", [("важная", "важн"), ("вагоне", "вагон"), ("важнейшие", "важн"), ("падают", "пада"), ("памяти", "памят"), ("агентов", "агент"), ("прочитавши", "прочита"), ("ведущего", "ведущ")])
def test_russian_vectors(word, stem):
    assert russian(word) == stem


def test_stem_texts():
    assert stem_text("Running, память агентов! _private") == "run, " + russian("память") + " агент! _private"
    assert stem_query("a running running") == ["run", "run"]
    assert stem_text(None) is None and stem_query(None) == []
    assert stem_identifiers("getUsers user_names x_y") == "getus user name "


def test_fences_and_sections():
    text = "Заголовок\n\n```python\nx = 1\n```\n\nТекст."
    assert len(M.fence_ranges(text)) == 1
    a, b = M.fence_ranges(text)[0]
    assert a <= text.index("x = 1") <= b
    assert M.sections("intro\n# A\ntext\n```\n# no\n```\n# also not, right behind a fence\n\n## B\n#### not\n~~~\n# open") == [
        "intro", "# A\ntext\n```\n# no\n```\n# also not, right behind a fence\n", "## B\n#### not\n~~~\n# open",
    ]


def test_blocks():
    text = "para one\nline\n\n- a\n  b\n\n- c\n\n| x | y |\n| - | - |\n```py\ncode\n\nmore\n```\nafter\n1. one\n2. two\ntext\n~~~\nopen"
    assert [k for k, _ in M.blocks(text)] == ["paragraph", "list", "table", "code", "paragraph", "list", "paragraph", "code"]
    assert M.blocks("") == [] and M.blocks(" \n\t\n") == []


def test_chunks():
    (c,) = M.chunk_markdown("## Intro\nКороткий текст", "demo.md")
    assert (c["heading"], c["part"], c["heading_chain"]) == ("Intro", 0, ["Intro"])
    assert c["text_for_embedding"].startswith("[demo] > Intro\n\n")
    text = "---\nname: s\ndescription: about\n---\n# A\n## B\n" + "\n\n".join("word " * 80 for _ in range(9)) + "\n### C\nend\n## D\nx"
    made = M.chunk_markdown(text, "x/y.md")
    assert [c["part"] for c in made if c["heading"] == "B"] == [1, 2, 3, 4]
    assert all(len(c["text"]) <= 1500 for c in made)
    assert made[-1]["heading_chain"] == ["A", "D"] and made[-2]["heading_chain"] == ["A", "B", "C"]
    assert made[0]["text_for_embedding"].startswith("[s] about > A\n\n")
    assert M.chunk_markdown(None, "a.md") == [] and M.chunk_markdown("  \n", "a.md") == []


@given(st.lists(st.integers(1, 3000), max_size=30))
@settings(max_examples=200, deadline=None)
def test_pack_invariants(sizes):
    spans = M.pack(sizes, 1500, lambda last, nxt: last <= 1500 and last + nxt + 4 <= 1500)
    seen = [i for a, b in spans for i in range(a, b)]
    assert sorted(set(seen)) == list(range(len(sizes)))
    for a, b in spans:
        assert b - a == 1 or sum(sizes[a:b]) + 2 * (b - a) <= 1500


def test_frontmatter():
    fields, body = M.parse_frontmatter("---\nname: demo\nrelated:\n  - a\n  - 'b' # x\ntags: [x, 'y z']\nd: >\n  one\n\n  two\nl: |\n  p\n  q\nu: http://x#y # note\n---\nBody\n")
    assert fields == {"name": "demo", "related": ["a", "b"], "tags": ["x", "y z"], "d": "one two", "l": "p\nq", "u": "http://x#y"} and body == "Body"
    assert M.parse_frontmatter("Просто текст") == ({}, "Просто текст")
    assert M.parse_frontmatter("---\nname: x\n") == ({}, "---\nname: x\n")


def test_update_frontmatter():
    text = "---\nname: demo\nrelated:\n  - a\nd: |\n  x\n---\nBody\n"
    new = M.update_frontmatter(text, {"related": ["q"], "d": "1", "new": "v"})
    assert M.parse_frontmatter(new)[0] == {"name": "demo", "related": ["q"], "d": "1", "new": "v"}
    assert new.endswith("\n---\nBody\n")
    assert M.update_frontmatter("plain", {"a": "1"}, create=False) == "plain"
    assert M.update_frontmatter("plain", {"a": "1"}) == "---\na: 1\n---\nplain"


_key = st.text("abcdefgh", min_size=1, max_size=6)
_value = st.text("abcdefgh xyz", max_size=12).map(str.strip)


@given(st.dictionaries(_key, st.one_of(_value, st.lists(_value.filter(bool), max_size=3)), max_size=5))
@settings(max_examples=100, deadline=None)
def test_frontmatter_round_trip(fields):
    fields = {k: v for k, v in fields.items() if not any(k != o and k.startswith(o) for o in fields)}
    parsed, body = M.parse_frontmatter(M.update_frontmatter("text", fields))
    assert parsed == fields and body == "text" or not fields


def test_comments():
    c = C.extract_comments("c", 'int x; // hello\n/* multi\n line */ int y; // tail\nchar* s="// no"; /* in */\nfoo();\n/* open\nend')
    assert [(b["start"], b["end"], b["text"], b["sig"]) for b in c] == [
        (1, 1, "hello", "int x;"), (2, 3, "multi\n line", 'char* s="'), (3, 3, "tail", "int y;"), (4, 4, "in", 'char* s="// no";'), (6, 7, "open\nend", ""),
    ]
    p = C.extract_comments("py", '# a\nx=1 # b\n"""doc\nmore"""\ndef f():\n  pass')
    assert [(b["text"], b["sig"]) for b in p] == [("a", "x=1 # b"), ("b", "x=1"), ("doc\nmore", "def f():")]
    q = C.extract_comments("sql", "select '--x' -- c\n/* b\nb2 */\nselect 1")
    assert [(b["text"], b["sig"]) for b in q] == [("c", "select '--x'"), ("b\nb2", "select 1")]
    y = C.extract_comments("yml", "a: 'x # y' # z\n# top\nk: v#n")
    assert [(b["text"], b["sig"]) for b in y] == [("z", "a: 'x # y'"), ("top", "k: v#n")]
    assert [b["text"] for b in C.extract_comments("hash", "x #1\n#\n")] == ["1"]
    assert C.extract_comments("c", None) == [] and C.extract_comments(None, "") == []
    chunks = C.comment_chunks("a.py", [{"start": i, "end": i, "text": "t" * 600, "sig": ""} for i in range(1, 5)])
    assert [x["line"] for x in chunks] == [1, 2, 3] and chunks[0]["text_for_embedding"].startswith("[a.py:#1]\n\n")


def test_text_columns(spark):
    rows = spark.createDataFrame([("память memory",), ("Café  x\n y",), (None,), ("",)], "t string")
    got = rows.select(T.fold(F.col("t")), T.clean(F.col("t")), T.terms(F.col("t")), T.query_words(F.col("t")), T.is_junk(F.col("t")), T.is_cyrillic(F.col("t"))).collect()
    assert got[1][0] == "cafe  x\n y" and got[1][1] == "Café x y" and got[1][2] == ["cafe", "x", "y"] and got[1][3] == ["café"]
    assert got[2][2] == [] and got[2][4] is True and got[3][2] == [] and got[2][0] is None
    words = spark.createDataFrame([("память",), ("memory",)], "w string").select(T.is_cyrillic(F.col("w"))).collect()
    assert [r[0] for r in words] == [True, False]


def test_times_and_names(spark):
    t = spark.createDataFrame([("1700000000000",), ("1700000000",), ("true",), (None,)], "x string").select(T.epoch_seconds(F.col("x"))).collect()
    assert [r[0] for r in t] == [1.7e9, 1.7e9, None, None]
    iso = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01",), ("x",)], "x string").select(T.iso_seconds(F.col("x")), T.iso_time(T.iso_seconds(F.col("x")))).collect()
    assert iso[0][0] == iso[1][0] == 1704067200.0 and iso[2][0] is None and iso[0][1] == "2024-01-01T00:00:00Z"
    paths = ["tools/SKILL.md", "streams/x/README.md", "streams/x.md", "README.md", "a/b/c.md"]
    owners = spark.createDataFrame([(p,) for p in paths], "p string").select(T.owner_of(F.col("p")), T.display_name(F.col("p"), F.lit("me"))).collect()
    assert [r[0] for r in owners] == ["skills-tools", "streams/x", "streams", "(root)", "a"]
    assert [r[1] for r in owners] == ["me", "streams/x/README", "streams/x", "README", "a/b/c"]
    noise = spark.createDataFrame([("AI",), ("docker",), ("ДКУР",), ("ClickHouse",), (None,)], "e string").select(T.is_noise_entity(F.col("e"), ("docker",))).collect()
    assert [r[0] for r in noise] == [True, True, True, False, True]
    g = spark.createDataFrame([("tasks/1/x.md",), ("Skills/a",), ("tasks/x.md",)], "p string").select(T.glob(F.col("p"), "tasks/[0-9]*.md"), T.glob(F.col("p"), "skills/*")).collect()
    assert [tuple(r) for r in g] == [(True, False), (False, False), (False, False)]
    d = spark.createDataFrame([("2024-01-01",), ("2024-13-01",), (None,)], "d string").select(T.age_days(F.col("d"), F.lit("2024-01-31").cast("date"))).collect()
    assert [r[0] for r in d] == [30, None, None]
    m = spark.createDataFrame([("A_B = 3 and X1=2.5", "## [2024-01-02]\n## [2024-03-01] x", "## Next\n\n## Other\nx")], "a string, b string, c string")
    r = m.select(T.named_numbers(F.col("a")), T.last_review(F.col("b")).cast("string"), T.section_empty(F.col("c"), "Next"), T.section_empty(F.col("c"), "Other"), T.json_object(F.lit('x ```{"a": 1}```'))).first()
    assert [tuple(x) for x in r[0]] == [("A_B", 3.0)] and r[1] == "2024-03-01" and r[2] is True and r[3] is False and r[4] == '{"a": 1}'


def test_chunk_tables(spark):
    files = spark.createDataFrame([("a/x.md", "# T\nhello"), ("a/y.md", None), (None, "x"), ("a/z.md", "")], "path string, content string")
    assert [(r.file_path, r.heading) for r in M.chunk_files(files).collect()] == [("a/x.md", "T")]
    code = spark.createDataFrame([("m.py", "# note\nx = 1"), ("n.py", None)], "path string, content string")
    assert [(r.file_path, r.line, r.text, r.sig) for r in C.chunk_sources(code).collect()] == [("m.py", 1, "note", "x = 1")]
    assert M.chunk_files(files.limit(0)).count() == 0
