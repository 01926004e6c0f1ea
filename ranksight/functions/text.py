"""Column expressions for texts, paths, times and vectors. All run in the JVM; none is a Python function per row.

Null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ranksight.settings import NOISE_ENTITIES, SYNTHETIC_PREFIXES, SessionLimits



def _bare_letters() -> dict[str, str]:
    """Latin letters that Unicode composes of an ASCII letter and marks, by that letter. Cyrillic letters keep their marks."""
    found = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        whole = chr(code).lower()
        bare = unicodedata.normalize("NFD", whole)
        if len(whole) == 1 and len(bare) > 1 and bare[0].isascii() and bare[0].isalpha():
            found[whole] = bare[0]
    return found


_BARE = _bare_letters()
_MARKED, _PLAIN = "".join(_BARE), "".join(_BARE.values())

#: A term of the index: letters and digits of any alphabet.
TERM = r"[\p{L}\p{N}]+"
NO_TERM = r"[^\p{L}\p{N}]+"
#: A word of a query: also ``_``, two characters at least.
QUERY_WORD = r"[\p{L}\p{N}_]{2,}"


def fold(c: Column) -> Column:
    """Lower case, without the marks on Latin letters and without combining marks."""
    low = F.lower(c)
    return F.when(low.rlike("[\u00e0-\u024f\u0300-\u036f\u1e00-\u1eff]"), F.translate(F.regexp_replace(low, "[\u0300-\u036f]", ""), _MARKED, _PLAIN)).otherwise(low)


def terms(c: Column) -> Column:
    """Index terms in order; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(fold(c), NO_TERM), ""), F.array().cast("array<string>"))


def query_words(c: Column) -> Column:
    """Words of a query in order, repeated ones kept; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(QUERY_WORD), F.lit(0)), F.array().cast("array<string>"))


def is_cyrillic(c: Column) -> Column:
    """More Cyrillic letters (U+0400 to U+04FF) than ASCII letters."""
    return F.length(F.regexp_replace(c, "[^Ѐ-ӿ]", "")) > F.length(F.regexp_replace(c, "[^A-Za-z]", ""))


def clean(c: Column) -> Column:
    """Runs of white space as one blank, no outer blanks."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def is_synthetic(c: Column) -> Column:
    """Begins like a text that a harness wrote in the user's name. Null is not."""
    start = F.ltrim(F.coalesce(c, F.lit("")))
    test = F.lit(False)
    for p in SYNTHETIC_PREFIXES:
        test = test | start.startswith(p)
    return test


def is_junk(c: Column, limits: SessionLimits = SessionLimits()) -> Column:
    """Too short to be worth a chunk, synthetic, or a notice that the context was compacted. Null is junk."""
    bare = F.trim(F.coalesce(c, F.lit("")))
    return (F.length(bare) < limits.least) | is_synthetic(bare) | F.lower(bare).contains("context has been compacted")


def epoch_seconds(c: Column) -> Column:
    """Seconds since 1970 of a number of seconds or, beyond 1e11, milliseconds. Anything that isn't a number is null."""
    x = F.expr("1") * c.try_cast("double")
    return F.when(x > 1e11, x / 1000).otherwise(x)


def iso_seconds(c: Column) -> Column:
    """Seconds since 1970 of an ISO date or time; without a zone it is UTC. Null if it can't be read."""
    return F.unix_micros(F.try_to_timestamp(c).cast("timestamp")) / 1e6


def iso_time(c: Column) -> Column:
    """ISO time in UTC of seconds since 1970."""
    return F.date_format(F.timestamp_micros((c * 1_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def content_hash(c: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def snippet(c: Column, size: int = 300) -> Column:
    """The first characters on one line."""
    return F.translate(F.substring(c, 1, size), "\n", " ")


def owner_of(path: Column) -> Column:
    """The owner of a file: the first folder, ``streams/<name>`` in streams, ``skills-tools`` for tools, ``(root)`` at the root."""
    part = F.split(path, "/")
    n = F.size(part)
    return (
        F.when(n < 2, "(root)")
        .when(part[0] == "tools", "skills-tools")
        .when((part[0] == "streams") & (n > 2), F.concat_ws("/", part[0], part[1]))
        .otherwise(part[0])
    )


def display_name(path: Column, skill: Column) -> Column:
    """How a hit names its file: the skill for SKILL.md and for the README of the folder of that name, else the path without ``.md``."""
    base = F.element_at(F.split(path, "/"), -1)
    folder = F.regexp_replace(path, "/?[^/]*$", "")
    own = (base == "SKILL.md") | (base == "README.md") & F.coalesce(folder == skill, F.lit(False))
    return F.when(own, F.coalesce(skill, owner_of(path))).otherwise(F.regexp_replace(path, r"\.md$", ""))


def entity_skill_name(c: Column) -> Column:
    """The name of the skill that covers an entity."""
    return F.concat(F.lit("entity-"), F.translate(F.lower(c), " ", "-"))


def is_entity_skill(c: Column) -> Column:
    return c.startswith("entity-")


def is_noise_entity(c: Column, stop: tuple[str, ...] = NOISE_ENTITIES) -> Column:
    """Shorter than three characters, a stop word in any letter case, or an upper-case name with Cyrillic letters of at most six characters. Null is noise."""
    c = F.trim(c)
    listed = F.lower(c).isin([s.lower() for s in stop]) if stop else F.lit(False)
    return F.coalesce((F.length(c) < 3) | listed | (F.upper(c) == c) & c.rlike("[Ѐ-ӿ]") & (F.length(c) <= 6), F.lit(True))


def glob_regex(pattern: str) -> str:
    """The regular expression of a GLOB: ``*`` and ``?`` also match ``/``, letter case counts, ``[...]`` is a class."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out += r"[\s\S]*"
        elif ch == "?":
            out += r"[\s\S]"
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "^!" else body) + "]"
            i = close
        else:
            out += "\\" + ch if not ch.isalnum() and ch not in "_/ " else ch
        i += 1
    return f"^{out}$"


def glob(c: Column, pattern: str) -> Column:
    return c.rlike(glob_regex(pattern))


def float32(c: Column) -> Column:
    """A vector in the precision of the index."""
    return c.cast("array<float>")


def table_cell(c: Column) -> Column:
    """Safe inside a Markdown table."""
    return F.regexp_replace(F.regexp_replace(c, r"\|", r"\\|"), r"\s*\n\s*", " ")


def named_numbers(c: Column) -> Column:
    """``[(name, number)]`` of all ``NAME = number`` marks in a text."""
    pairs = F.regexp_extract_all(c, F.lit(r"\b[A-Z][A-Z0-9_]{2,}\s*=\s*-?\d+(?:\.\d+)?"), F.lit(0))
    return F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^(\w+)", 1).alias("name"), F.regexp_extract(p, r"(-?\d+(?:\.\d+)?)$", 1).cast("double").alias("number")))


def first_cells(c: Column) -> Column:
    """First cells of the rows of Markdown tables, without rules and code marks."""
    rows = F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^\s*\|") & ~x.rlike(r"^\s*\|[\s:|-]+$"))
    return F.transform(rows, lambda x: F.trim(F.translate(F.regexp_extract(x, r"^\s*\|([^|]*)", 1), "`", "")))


def last_review(c: Column) -> Column:
    """The latest date of a heading ``## [YYYY-MM-DD]``."""
    found = F.regexp_extract_all(c, F.lit(r"(?m)^##\s*\[(\d{4}-\d{2}-\d{2})\]"), F.lit(1))
    return date_of(F.array_max(found))


def section_empty(c: Column, title: str) -> Column:
    """Whether the level-two section of that title is missing or blank."""
    body = F.regexp_extract(c, rf"(?ms)^##\s+{title}\s*$(.*?)(?=^##\s|\z)", 1)
    return F.length(F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+", " "))) == 0


def json_object(c: Column) -> Column:
    """The outermost ``{...}`` of an answer, inside or outside a code fence."""
    return F.nullif(F.regexp_extract(c, r"\{[\s\S]*\}", 0), F.lit(""))


def date_of(c: Column) -> Column:
    """The date of a ``YYYY-MM-DD`` string; null if it isn't one."""
    return F.try_to_timestamp(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c), F.lit("yyyy-MM-dd")).cast("date")


def age_days(date: Column, as_of: Column) -> Column:
    """Days from a ``YYYY-MM-DD`` string to ``as_of``; null if it isn't a date."""
    return F.datediff(as_of, date_of(date))
