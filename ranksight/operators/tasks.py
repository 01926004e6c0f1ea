"""Task notes as rows: choosing, sorting, dates, counts, validation and a calendar. What the states of a task mean is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranksight.functions.markdown import update_frontmatter_column
from ranksight.functions.text import age_days, date_of, section_empty


def matches(sphere: str | None = None, status: str | None = None, priority: str | None = None, id: str | None = None, tag: str | None = None) -> Column:
    keep = F.lit(True)
    for column, wanted in (("sphere", sphere), ("status", status), ("priority", priority), ("id", id)):
        if wanted:
            keep &= F.col(column) == wanted
    return keep & F.array_contains("tags", tag) if tag else keep


def order(mode: str, priorities: tuple[str, ...], statuses: tuple[str, ...] = ()) -> list[Column]:
    """Sort keys: ``priority`` (priority, deadline, status), ``deadline`` (deadline, priority) or ``updated`` (newest first, priority).

    Values outside the enumerations come last, missing deadlines behind all dates.
    """

    def place(column: str, known: tuple[str, ...]) -> Column:
        p = F.array_position(F.array(*map(F.lit, known)), F.col(column)) if known else F.lit(0)
        return F.when(F.coalesce(p, F.lit(0)) == 0, len(known) + 1).otherwise(p)

    due, rank = F.coalesce("deadline", F.lit("9999-12-31")), place("priority", priorities)
    keys = {"priority": [rank, due, place("status", statuses)], "deadline": [due, rank], "updated": [F.desc(F.coalesce("updated", F.lit(""))), rank]}[mode]
    return [*keys, F.col("id")]


def next_id(tasks: DataFrame, number: Column) -> DataFrame:
    """One row: the largest number plus one, 1 for none."""
    return tasks.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_id"))


def date_problems(tasks: DataFrame, as_of: Column, rules: dict[str, tuple[Column, str, int, int | None]], id_col: str = "id") -> DataFrame:
    """(id, problem, days): for each rule name a (condition, date column, from, to): the age of the date in days at ``as_of``
    is at least ``from`` and at most ``to``. A task may have several problems; what isn't a date has none."""
    found = []
    for name, (condition, column, low, high) in rules.items():
        age = age_days(F.col(column), as_of)
        hit = condition & (age >= low) & (age <= high if high is not None else F.lit(True))
        found.append(F.when(hit, F.struct(F.lit(name).alias("problem"), age.alias("days"))))
    return tasks.select(id_col, F.explode(F.array_compact(F.array(*found))).alias("p")).select(id_col, "p.problem", "p.days")


def group_counts(tasks: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(field, value, n) of several columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return tasks.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def check(tasks: DataFrame, required: tuple[str, ...], domains: dict[str, tuple[str, ...]], dates: tuple[str, ...] = (), sections: tuple[str, ...] = (), numbered: bool = False) -> DataFrame:
    """(subject, problem, detail): missing fields, values outside their domain, bad dates, ids used twice, unknown references.

    ``sections`` of the body must not be empty; ``numbered`` ids are numbers, the same as at the begin of the file's name.
    """
    tests = [F.when(F.length(F.coalesce(c, F.lit(""))) == 0, F.struct(F.lit("missing").alias("problem"), F.lit(c).alias("detail"))) for c in required]
    tests += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*d), F.struct(F.lit("domain").alias("problem"), F.concat_ws("=", F.lit(c), c).alias("detail"))) for c, d in domains.items()]
    tests += [F.when(F.col(c).isNotNull() & age_days(F.col(c), F.current_date()).isNull(), F.struct(F.lit("date").alias("problem"), F.concat_ws("=", F.lit(c), c).alias("detail"))) for c in dates]
    tests += [F.when(section_empty(F.col("body"), c), F.struct(F.lit("section").alias("problem"), F.lit(c).alias("detail"))) for c in sections]
    if numbered:
        number = F.regexp_extract("path", r"(?:^|/)0*(\d+)-[^/]*$", 1)
        bad = ~F.col("id").rlike(r"^\d+$") | (F.regexp_replace("id", "^0+(?=.)", "") != number)
        tests.append(F.when(bad, F.struct(F.lit("number").alias("problem"), F.col("id").alias("detail"))))
    own = tasks.select(F.col("path").alias("subject"), F.explode(F.array_compact(F.array(*tests))).alias("p")).select("subject", "p.problem", "p.detail")
    twice = tasks.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("path"))).where("n > 1 and id is not null").select(F.col("path").alias("subject"), F.lit("duplicate").alias("problem"), F.col("id").alias("detail"))
    refs = tasks.select(F.col("path").alias("subject"), F.explode("related").alias("detail")).join(tasks.select(F.col("id").alias("detail")).distinct(), "detail", "left_anti").select("subject", F.lit("reference").alias("problem"), "detail")
    return own.unionByName(twice).unionByName(refs)


def close(notes: DataFrame, updates: dict[str, str], folder: str, remark: str = "") -> DataFrame:
    """(path, target, content) of notes (path, content) whose fields are set and that go to ``folder``, a ``remark`` at their end.

    ``sources.sinks.write_texts`` writes the targets; the caller then removes the old paths.
    """
    fields = F.create_map(*[x for k, v in updates.items() for x in (F.lit(k), F.array(F.lit(v)))])
    new = update_frontmatter_column(F.col("content"), fields)
    new = F.concat(F.rtrim(new), F.lit(f"\n\n{remark}\n")) if remark else new
    return notes.select("path", F.concat(F.lit(folder.rstrip("/") + "/"), F.element_at(F.split("path", "/"), -1)).alias("target"), new.alias("content"))


def first_hits(hits: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks in the order of their best hit (path, rank), each once."""
    best = hits.groupBy("path").agg(F.min("rank").alias("rank"))
    return tasks.join(best, "path").orderBy("rank", "path")


def calendar(tasks: DataFrame, stamp: str) -> DataFrame:
    """(id, event): an all-day event with a reminder the day before, for every task with a deadline. Lines end in CRLF."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"([\;,])", r"\\$1"), "\n", r"\\n")
    lines = [
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:task-"), "id"), F.lit(f"DTSTAMP:{stamp}"), F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format("_day", "yyyyMMdd")), F.concat(F.lit("DTEND;VALUE=DATE:"), F.date_format(F.date_add("_day", 1), "yyyyMMdd")),
        F.concat(F.lit("SUMMARY:"), esc("title")), F.lit("BEGIN:VALARM"), F.lit("ACTION:DISPLAY"), F.lit("TRIGGER:-P1D"), F.concat(F.lit("DESCRIPTION:"), esc("title")), F.lit("END:VALARM"), F.lit("END:VEVENT"),
    ]
    return tasks.withColumn("_day", date_of(F.col("deadline"))).where("_day is not null").select("id", F.concat_ws("\r\n", *lines).alias("event"))
