"""Model-made metadata of skills: asking, sanitising, applying."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranksight.functions.markdown import update_frontmatter_column
from ranksight.functions.text import json_object
from ranksight.settings import CATEGORIES, STATUSES

ANSWER = "category string, related array<string>, status string, entities array<string>"
PROMPT_CHARS = 6_000


def extract(skills: DataFrame, ask: Callable[[str, str], str], text: str = "body") -> DataFrame:
    """(name, part, answer): ``ask(name, text)`` for every piece of 6,000 characters of a skill's text; null where asking fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for n, t in zip(f["name"], f["text"]):
                for at in range(0, max(len(t or ""), 1), PROMPT_CHARS):
                    try:
                        answer = ask(n, (t or "")[at : at + PROMPT_CHARS])
                    except Exception:  # noqa: BLE001  (one failed call must not lose the others)
                        answer = None
                    out.append((n, at // PROMPT_CHARS, answer))
            yield pd.DataFrame(out, columns=["name", "part", "answer"])

    return skills.select("name", F.col(text).alias("text")).mapInPandas(run, "name string, part int, answer string")


def sanitize(answers: DataFrame, names: DataFrame, categories: tuple[str, ...] = CATEGORIES, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """(name, category, status, related, entities) of answers that hold a JSON object.

    Values outside the enumerations become null, references to unknown skills or to the skill itself go, lists are distinct and
    sorted. Of the pieces of one text the first valid value counts, lists are put together. Answers without an object are left out.
    """
    read = answers.withColumn("part", F.col("part") if "part" in answers.columns else F.lit(0)).withColumn("a", F.from_json(json_object(F.col("answer")), ANSWER)).where("a is not null")
    first = lambda c, known: F.min(F.when(F.col(c).isin(*known), F.struct("part", F.col(c).alias("v"))))["v"]
    none = F.array().cast("array<string>")
    many = lambda c: F.flatten(F.collect_list(F.coalesce(c, none)))
    a = read.groupBy("name").agg(first("a.category", categories).alias("category"), first("a.status", statuses).alias("status"), many("a.related").alias("refs"), many("a.entities").alias("found"))
    refs = a.select("name", F.explode("refs").alias("ref")).join(names.select(F.col("name").alias("ref")).distinct(), "ref", "left_semi").where("ref != name")
    related = refs.groupBy("name").agg(F.array_sort(F.collect_set("ref")).alias("related"))
    entities = F.array_sort(F.array_distinct(F.filter(F.transform("found", lambda e: F.trim(e)), lambda e: F.length(e) > 0)))
    return a.join(related, "name", "left").select("name", "category", "status", F.coalesce("related", none).alias("related"), entities.alias("entities"))


def upsert(proposals: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    return proposals.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def apply(skills: DataFrame, proposals: DataFrame, today: Column) -> DataFrame:
    """(path, content) of the skills with a proposal, its non-empty fields and today's date written into their frontmatter."""
    one = lambda c: F.when(F.length(F.coalesce(c, F.lit(""))) > 0, F.array(c))
    many = lambda c: F.when(F.size(c) > 0, F.array_sort(c))
    p = proposals.select("name", F.create_map(F.lit("category"), one("category"), F.lit("status"), one("status"), F.lit("related"), many("related"), F.lit("entities"), many("entities")).alias("all"))
    p = p.withColumn("updates", F.map_filter("all", lambda k, v: v.isNotNull())).where(F.size("updates") > 0)
    p = p.withColumn("updates", F.map_concat("updates", F.create_map(F.lit("updated"), F.array(F.date_format(today, "yyyy-MM-dd")))))
    return skills.join(p.select("name", "updates"), "name").select("path", update_frontmatter_column(F.col("content"), F.col("updates"), create=True).alias("content"))


def migrate_entities(mentions: DataFrame, skills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed: name, entities) of skills whose list differs from the graph's, and (dead: name) of mentions without a skill."""
    wanted = mentions.groupBy(F.col("skill_name").alias("name")).agg(F.array_sort(F.collect_set("entity_name")).alias("wanted"))
    changed = skills.select("name", F.array_sort("entities").alias("have")).join(wanted, "name").where("have != wanted").select("name", F.col("wanted").alias("entities"))
    return changed, wanted.join(skills.select("name"), "name", "left_anti").select("name")
