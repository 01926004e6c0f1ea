"""Checks of a knowledge base. Every rule is a query; the suite is their union (rule, subject, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranksight.functions.markdown import update_frontmatter_column
from ranksight.functions.text import age_days, named_numbers
from ranksight.operators.graph import uncovered_entities
from ranksight.settings import LEAST_DESCRIPTION, MOST_LINES, NOISE_ENTITIES, STALE_DAYS, STREAM_STALE_DAYS


def finding(rows: DataFrame, rule: str, subject: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def missing(rows: DataFrame, rule: str, subject: str, column: str) -> DataFrame:
    """Rows whose value is null, blank or an empty list."""
    empty = F.size(column) <= 0 if rows.schema[column].dataType.typeName() == "array" else F.length(F.trim(F.coalesce(column, F.lit("")))) == 0
    return finding(rows.where(empty), rule, F.col(subject), F.lit(None))


def broken_references(rows: DataFrame, key: str, refs: str, rule: str = "broken_ref") -> DataFrame:
    """References to keys that don't exist."""
    r = rows.select(F.col(key).alias("_from"), F.explode(refs).alias("_to")).distinct()
    known = rows.select(F.col(key).alias("_to")).distinct()
    return finding(r.join(known, "_to", "left_anti"), rule, F.col("_from"), F.col("_to"))


def one_way_references(rows: DataFrame, key: str, refs: str, rule: str = "reciprocal_ref") -> DataFrame:
    """References to existing keys that don't refer back."""
    r = rows.select(F.col(key).alias("_from"), F.explode(refs).alias("_to")).where("_from != _to").distinct()
    known = rows.select(F.col(key).alias("_to")).distinct()
    back = r.select(F.col("_to").alias("_from"), F.col("_from").alias("_to"))
    return finding(r.join(known, "_to", "left_semi").join(back, ["_from", "_to"], "left_anti"), rule, F.col("_from"), F.col("_to"))


def stale(rows: DataFrame, rule: str, subject: str, date: str, as_of: Column, days: int) -> DataFrame:
    """Dates more than ``days`` before ``as_of``; what isn't a date isn't stale."""
    age = age_days(F.col(date), as_of)
    return finding(rows.where(age > days), rule, F.col(subject), age)


def unconnected(rows: DataFrame, key: str, refs: str, rule: str = "orphan") -> DataFrame:
    """Keys that refer to nothing and that nothing refers to."""
    there = rows.select(F.explode(refs).alias(key)).distinct()
    return finding(rows.where(F.size(refs) <= 0).join(there, key, "left_anti"), rule, F.col(key), F.lit(None))


def too_long(rows: DataFrame, subject: str, text: str, lines: int = MOST_LINES, rule: str = "skill_too_long") -> DataFrame:
    n = F.size(F.split(text, "\n"))
    return finding(rows.where(n > lines), rule, F.col(subject), n)


def index_drift(files: DataFrame, indexed: DataFrame, path: str = "path") -> DataFrame:
    """Files that aren't in the index, and index entries without a file."""
    a, b = files.select(path).distinct(), indexed.select(path).distinct()
    return finding(a.join(b, path, "left_anti"), "index_drift", F.col(path), F.lit("not indexed")).unionByName(finding(b.join(a, path, "left_anti"), "index_drift", F.col(path), F.lit("no file")))


def streams_without_readme(files: DataFrame, path: str = "path") -> DataFrame:
    part = F.split(path, "/")
    s = files.where(F.col(path).startswith("streams/") & (F.size(part) > 2)).select(F.concat_ws("/", part[0], part[1]).alias("stream"), (part[2] == "README.md").cast("int").alias("readme"))
    return finding(s.groupBy("stream").agg(F.max("readme").alias("readme")).where("readme = 0"), "stream_no_readme", F.col("stream"), F.lit(None))


def lint(skills: DataFrame, files: DataFrame, indexed: DataFrame, as_of: Column, stop: tuple[str, ...] = NOISE_ENTITIES, covered: dict[str, str] | None = None) -> DataFrame:
    """All rules over skills (see ``sources.trees.skills``), files (path, content) and index entries (path).

    One rule of the original suite, uncommitted changes, needs a version control system and is left out.
    """
    body = skills.withColumn("about", F.coalesce("description", F.lit("")))
    short = body.where(F.length(F.trim("about")) < LEAST_DESCRIPTION)
    entities = uncovered_entities(skills.select(F.col("name").alias("skill_name"), F.explode("entities").alias("entity_name")), skills, stop=stop, covered=covered)
    streams = skills.where(F.col("path").startswith("streams/"))
    return reduce(
        DataFrame.unionByName,
        [
            missing(skills, "no_related", "name", "related"),
            missing(skills, "no_category", "name", "category"),
            broken_references(skills, "name", "related"),
            one_way_references(skills, "name", "related"),
            stale(skills.where(~F.col("path").startswith("streams/")), "stale", "name", "updated", as_of, STALE_DAYS),
            finding(entities, "missing_entity", F.col("entity_name"), F.col("n")),
            unconnected(skills, "name", "related"),
            finding(short, "empty_description", F.col("name"), F.length(F.trim("about"))),
            index_drift(files, indexed),
            stale(streams, "stale_streams", "name", "updated", as_of, STREAM_STALE_DAYS),
            streams_without_readme(files),
            too_long(skills, "name", "body"),
        ],
    )


def fix_references(skills: DataFrame, today: Column) -> DataFrame:
    """(path, content) of the skills with broken references, rewritten without them and with a new ``updated``.

    ``skills`` needs (path, name, related, content).
    """
    valid = skills.select(F.col("name").alias("ref")).distinct()
    each = skills.select("path", F.posexplode("related").alias("at", "ref"))
    kept = each.join(valid, "ref", "left_semi").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ref"))), lambda x: x["ref"]).alias("kept"))
    both = skills.join(kept, "path", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<string>"))).where(F.size("kept") < F.size("related"))
    updates = F.create_map(F.lit("related"), F.col("kept"), F.lit("updated"), F.array(F.date_format(today, "yyyy-MM-dd")))
    return both.select("path", update_frontmatter_column(F.col("content"), updates, create=False).alias("content"))


def check_numbers(docs: DataFrame, constants: DataFrame, text: str = "text") -> DataFrame:
    """(name, stated, actual) of ``NAME = number`` marks in documents that differ from (name, value), or name no constant."""
    stated = docs.select(F.explode(named_numbers(F.col(text))).alias("m")).select("m.name", F.col("m.number").alias("stated")).distinct()
    joined = stated.join(constants.select("name", F.col("value").cast("double").alias("actual")), "name", "left")
    return joined.where("actual is null or actual != stated")
