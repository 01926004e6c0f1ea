"""Predicates on chunks: metadata of their owner, access planes, kinds and session fields. All are Columns or semi-joins,
applied before any cut to the best k, so a filter never costs results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranksight.functions.text import glob, owner_of
from ranksight.settings import KINDS

# Globs of task notes and streams.
TASK_GLOBS = ("tasks/[0-9]*.md", "tasks/archive/*", "tasks/reviews.md")
STREAM_GLOB = "streams/*"


def in_plane(path: Column, plane: str = "knowledge") -> Column:
    """``knowledge``: all but task notes; ``skills``: also without streams; ``streams``; ``tasks``; ``all``."""
    task = F.lit(False)
    for g in TASK_GLOBS:
        task |= glob(path, g)
    stream = glob(path, STREAM_GLOB)
    try:
        return {"knowledge": ~task, "skills": ~task & ~stream, "streams": stream, "tasks": task, "all": F.lit(True)}[plane]
    except KeyError:
        raise ValueError(f"unknown plane {plane!r}") from None


def in_kinds(kind: Column, kinds: tuple[str, ...]) -> Column:
    """``kinds`` that aren't known count as all."""
    known = [k for k in kinds if k in KINDS]
    return F.lit(True) if not known or set(known) == set(KINDS) else kind.isin(known)


def parse_kinds(value: str | None) -> tuple[str, ...]:
    known = tuple(k for k in (x.strip() for x in (value or "").split(",")) if k in KINDS)
    return known or KINDS


def select_owners(skills: DataFrame, scope: str | None = None, category: str | None = None, skill: str | None = None, archived: bool = False) -> DataFrame:
    """(owner) of the skills that pass; ``skill`` names a folder or a skill; archived ones only if asked for."""
    keep = F.lit(True)
    for column, wanted in (("scope", scope), ("category", category)):
        if wanted:
            keep &= F.col(column) == wanted
    if skill:
        keep &= (F.col("name") == skill) | (F.col("dir") == skill) | (F.col("owner") == skill)
    if not archived:
        keep &= F.coalesce("status", F.lit("active")) != "archived"
    return skills.where(keep).select("owner").distinct()


def filter_chunks(chunks: DataFrame, skills: DataFrame | None = None, scope: str | None = None, category: str | None = None, skill: str | None = None, archived: bool = False, plane: str = "knowledge", hide_archived: str = "always", path: str = "file_path") -> DataFrame:
    """Chunks of the plane whose owner passes. With a metadata filter only owners that pass stay; without one, archived
    owners go (``hide_archived``: ``always``, ``filtered`` for only with a filter, ``never``) and files without a skill stay."""
    rows = chunks.where(in_plane(F.col(path), plane))
    if skills is None:
        return rows
    owned = rows.withColumn("_owner", owner_of(F.col(path)))
    if scope or category or skill:
        keep = select_owners(skills, scope, category, skill, archived or hide_archived == "never")
        return owned.join(keep.withColumnRenamed("owner", "_owner"), "_owner", "left_semi").drop("_owner")
    if archived or hide_archived != "always":
        return rows
    gone = skills.where("status = 'archived'").select(F.col("owner").alias("_owner")).distinct()
    return owned.join(gone, "_owner", "left_anti").drop("_owner")


def session_filter(agent: str | None = None, since: str | None = None, work_dir: str | None = None, ts: str = "ts", folder: str = "work_dir") -> Column:
    """Agent, time from ``since`` on (ISO, UTC; rows without a time fail) and a part of the folder in any letter case."""
    keep = F.lit(True)
    if agent:
        keep &= F.col("agent") == agent
    if since:
        from datetime import datetime, timezone

        at = datetime.fromisoformat(since.replace("Z", "+00:00"))  # an unreadable time raises
        at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
        keep &= F.coalesce(F.col(ts) >= at.timestamp(), F.lit(False))
    if work_dir:
        keep &= F.coalesce(F.lower(folder).contains(work_dir.lower()), F.lit(False))
    return keep
