"""Folders of Markdown and source files as tables: Markdown corpus, project tree, skills and task files."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksight.functions.markdown import frontmatter_column
from ranksight.functions.text import content_hash, glob, glob_regex, owner_of
from ranksight.settings import COMMENT_STYLES, SKIPPED_FOLDERS, SKIPPED_IN_PROJECTS

# Files that a knowledge base leaves out.
SKIPPED_NAMES = (".env", "package-lock.json", "yarn.lock")
SKIPPED_PATHS = ("skills-management/references/log-archive*.md", "tasks/index.md")


def read_tree(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, content, content_hash, modified_ns, bytes) of the files below a folder; ``path`` is relative, with ``/``.

    Files that aren't UTF-8 come with replacement characters. An empty folder gives no rows.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    base = re.sub(r"^file:(//)?", "", root).rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^file:(?://)?", ""), "^" + re.escape(base) + "/", "")
    text = F.col("content").cast("string")
    return reader.load(root).select(path.alias("path"), text.alias("content"), content_hash(text).alias("content_hash"), (F.unix_micros("modificationTime") * 1000).alias("modified_ns"), F.col("length").alias("bytes"))


def in_folders(path: Column, names: tuple[str, ...]) -> Column:
    """Whether a folder of the path has one of these names."""
    part = F.split(path, "/")
    return F.arrays_overlap(F.slice(part, 1, F.greatest(F.size(part) - 1, F.lit(0))), F.array(*map(F.lit, names)))


def markdown_files(files: DataFrame) -> DataFrame:
    """The Markdown files of a knowledge base: no skipped folders, templates, lock files, archives or derived lists."""
    path = F.col("path")
    kept = path.endswith(".md") & ~in_folders(path, (*SKIPPED_FOLDERS, "templates")) & ~F.element_at(F.split(path, "/"), -1).isin(*SKIPPED_NAMES)
    for g in SKIPPED_PATHS:
        kept &= ~glob(path, g)
    return files.where(kept)


@dataclass(frozen=True)
class IgnoreRules:
    """``folders``: path prefixes; ``files``: globs on the path or the name."""

    folders: tuple[str, ...] = ()
    files: tuple[str, ...] = ()

    @classmethod
    def parse(cls, text: str | None) -> IgnoreRules:
        """Lines of an ignore file: ``x/`` and ``x/**`` are folders, anything else a file glob; ``#`` begins a comment.

        A leading ``**/`` or ``./`` is dropped, the dot of a hidden folder is kept.
        """
        folders, files = [], []
        for line in (text or "").splitlines():
            rule = re.sub(r"^(?:\./|\*\*/)+", "", line.strip().replace("\\", "/"))
            if not rule or rule.startswith("#"):
                continue
            folder = re.match(r"(.+?)/(?:\*\*)?$", rule)
            (folders if folder else files).append(folder.group(1) if folder else rule)
        return cls(tuple(folders), tuple(files))

    def excluded(self, path: Column) -> Column:
        out = F.lit(False)
        for f in self.folders:
            out |= path.startswith(f"{f}/") | path.contains(f"/{f}/")
        name = F.element_at(F.split(path, "/"), -1)
        for g in self.files:
            out |= path.rlike(glob_regex(g)) | name.rlike(glob_regex(g))
        return out


def kind_of(path: Column) -> Column:
    """``skill`` for Markdown below ``.agents/skills``, ``docs`` for other Markdown, ``code`` for known endings, else null."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    code = ending.isin(*COMMENT_STYLES) | path.rlike(r"(^|/)CMakeLists\.txt$")
    return F.when((ending == "md") & path.startswith(".agents/skills/"), "skill").when(ending == "md", "docs").when(code, "code")


def project_files(files: DataFrame, rules: IgnoreRules = IgnoreRules()) -> DataFrame:
    """Files of a project with their ``kind``, without skipped and ignored ones."""
    path = F.col("path")
    hidden = SKIPPED_IN_PROJECTS
    return files.where(~in_folders(path, hidden) & ~rules.excluded(path) & ~F.element_at(F.split(path, "/"), -1).isin(*SKIPPED_NAMES)).withColumn("kind", kind_of(path)).where("kind is not null")


def skills(files: DataFrame) -> DataFrame:
    """One row per SKILL.md: (path, owner, name, dir, scope, category, status, updated, description, related, entities, fields, body).

    ``name`` falls back to the folder, ``status`` to ``active``; lists are empty arrays where missing.
    """
    found = files.where(F.element_at(F.split("path", "/"), -1) == "SKILL.md").select("path", "content").withColumn("fm", frontmatter_column(F.col("content")))
    one = lambda k: F.try_element_at(F.try_element_at("fm.fields", F.lit(k)), F.lit(1))
    many = lambda k: F.coalesce(F.try_element_at("fm.fields", F.lit(k)), F.array().cast("array<string>"))
    folder = F.try_element_at(F.split("path", "/"), F.lit(-2))
    return found.select(
        "path", owner_of(F.col("path")).alias("owner"), F.coalesce(one("name"), folder).alias("name"), folder.alias("dir"), one("scope").alias("scope"), one("category").alias("category"),
        F.coalesce(one("status"), F.lit("active")).alias("status"), one("updated").alias("updated"), one("description").alias("description"), many("related").alias("related"), many("entities").alias("entities"),
        F.col("fm.fields").alias("fields"), F.col("fm.body").alias("body"),
    )


def task_files(files: DataFrame, with_archive: bool = True) -> DataFrame:
    """Task notes (``tasks/*.md``, ``tasks/archive/*.md``) with their fields, without the derived list and notes without an id."""
    path = F.col("path")
    named = path.rlike(r"^tasks/(archive/)?[^/]+\.md$" if with_archive else r"^tasks/[^/]+\.md$") & (path != "tasks/index.md")
    t = files.where(named).withColumn("fm", frontmatter_column(F.col("content")))
    one = lambda k: F.try_element_at(F.try_element_at("fm.fields", F.lit(k)), F.lit(1))
    many = lambda k: F.coalesce(F.try_element_at("fm.fields", F.lit(k)), F.array().cast("array<string>"))
    scalars = ("id", "title", "sphere", "type", "status", "priority", "elaboration", "created", "updated", "deadline", "origin", "resolution")
    return t.select("path", *[one(k).alias(k) for k in scalars], many("tags").alias("tags"), many("related").alias("related"), path.startswith("tasks/archive/").alias("archived"), F.col("fm.body").alias("body")).where("id is not null")
