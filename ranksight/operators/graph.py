"""The entity graph of skills: vertices, edges and mentions as tables, neighbourhoods by joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranksight.functions.text import entity_skill_name, is_noise_entity
from ranksight.settings import ENTITY_SKILLS, NOISE_ENTITIES


@dataclass
class EntityGraph:
    """entities (name, type), edges (source, target, relation, source_skill), mentions (skill_name, entity_name)."""

    entities: DataFrame
    edges: DataFrame
    mentions: DataFrame


def build(skills: DataFrame) -> EntityGraph:
    """From (name, category, related, entities) of skills.

    Every skill is an entity of type ``skill:<category>``; a mentioned entity has no type, and a skill of the same name wins.
    ``related`` becomes an edge if its target is a skill and not the skill itself. Everything counts once; null names are none.
    """
    named = skills.where("name is not null")
    own = named.groupBy("name").agg(F.concat(F.lit("skill:"), F.coalesce(F.max("category"), F.lit(""))).alias("type"))
    mentions = named.select(F.col("name").alias("skill_name"), F.explode("entities").alias("entity_name")).where("entity_name is not null and entity_name != ''").distinct()
    other = mentions.select(F.col("entity_name").alias("name")).distinct().join(own, "name", "left_anti").select("name", F.lit(None).cast("string").alias("type"))
    links = named.select(F.col("name").alias("source"), F.explode("related").alias("target")).where("source != target").distinct()
    edges = links.join(own.select(F.col("name").alias("target")), "target", "left_semi").select("source", "target", F.lit("related_to").alias("relation"), F.col("source").alias("source_skill"))
    return EntityGraph(own.unionByName(other), edges, mentions)


def match_entities(entities: DataFrame, part: str) -> DataFrame:
    """Entities whose name holds ``part``, in any letter case of any alphabet; ``%`` and ``_`` mean themselves."""
    return entities.where(F.lower("name").contains(part.lower()))


def neighbors(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(name, direction, other): one hop from every ``name`` of ``start``, ``out`` and ``in``."""
    s = start.select("name").distinct()
    out = edges.join(s, edges["source"] == s["name"]).select("name", F.lit("out").alias("direction"), F.col("target").alias("other"))
    into = edges.join(s, edges["target"] == s["name"]).select("name", F.lit("in").alias("direction"), F.col("source").alias("other"))
    return out.unionByName(into).distinct()


def two_hops(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(name, direction, via, other): two steps out, or two steps in, that don't lead back to the start.

    Edges count once. A hub is joined on its own key; adaptive execution splits its rows.
    """
    e = edges.select("source", "target").distinct()
    first = neighbors(e, start).withColumnRenamed("other", "via")
    out = first.where("direction = 'out'").join(e, F.col("via") == e["source"]).select("name", "direction", "via", F.col("target").alias("other"))
    into = first.where("direction = 'in'").join(e, F.col("via") == e["target"]).select("name", "direction", "via", F.col("source").alias("other"))
    return out.unionByName(into).where("other != name").distinct()


def degrees(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, type, n): edges at each entity, counted at both ends; 0 without any."""
    ends = edges.select(F.col("source").alias("name")).unionAll(edges.select(F.col("target").alias("name")))
    return entities.join(ends.groupBy("name").agg(F.count("*").alias("n")), "name", "left").select("name", "type", F.coalesce("n", F.lit(0)).alias("n"))


def top_connected(graph: EntityGraph, k: int = 15) -> DataFrame:
    return degrees(graph.entities, graph.edges).where("n > 0").orderBy(F.desc("n"), "name").limit(k)


def type_counts(graph: EntityGraph) -> DataFrame:
    return graph.entities.groupBy("type").agg(F.count("*").alias("n"))


def uncovered_entities(mentions: DataFrame, skill_names: DataFrame, least: int = ENTITY_SKILLS, stop: tuple[str, ...] = NOISE_ENTITIES, covered: dict[str, str] | None = None, examples: int = 5) -> DataFrame:
    """(entity_name, n, skills): entities in at least ``least`` skills, without noise and without a skill of their own.

    ``covered`` names the skill that stands for an entity; ``skills`` lists the first ``examples`` by name. Repeated mentions count once.
    """
    m = mentions.where("skill_name is not null and entity_name is not null").select("skill_name", "entity_name").distinct()
    count = m.groupBy("entity_name").agg(F.count("*").alias("n")).where((F.col("n") >= least) & ~is_noise_entity(F.col("entity_name"), stop))
    if covered:
        count = count.where(~F.col("entity_name").isin(*covered))
    own = skill_names.select(F.col("name").alias("_skill")).distinct()
    open_ = count.withColumn("_skill", entity_skill_name(F.col("entity_name"))).join(own, "_skill", "left_anti").drop("_skill")
    first = m.join(open_, "entity_name").withColumn("place", F.row_number().over(Window.partitionBy("entity_name").orderBy("skill_name"))).where(F.col("place") <= examples)
    return first.groupBy("entity_name", "n").agg(F.array_sort(F.collect_list("skill_name")).alias("skills"))
