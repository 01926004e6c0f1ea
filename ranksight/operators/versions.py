"""Immutable table versions: data files, deletion vectors and one manifest per version.

A commit writes new data files and, for superseded rows, a deletion vector (file, row number); then it creates
``manifests/<version>.json``, which no other commit can create again. Nothing is ever rewritten, so the difference of
two versions is read from the manifests between them alone: rows of added files are inserts, rows of new deletion
vectors are deletes. A manifest carries properties, in which a consumer keeps the version of its source that the commit
has processed: output and progress are published by one file, so a run that dies leaves neither.

Every ``CHECKPOINT`` versions a commit also writes the folders that are live, so a reader opens a bounded number of
manifests. Publishing a manifest relies on a rename that refuses an existing name, as HDFS and local file systems have it;
object stores need a file system layer that offers it. A ``Store`` keeps several tables under one line of manifests.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranksight.runtime import materialize


class Folder:
    """A folder of the file system that all executors share, through Hadoop's file system interface."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, sub: str) -> list[str]:
        at = self._at(sub)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def create(self, name: str, text: str) -> None:
        """Publish a file that must not exist yet: written beside, then renamed; fails if another commit was first."""
        draft = self._at(f"drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()
        self._fs.mkdirs(self._at(name).getParent())
        if self._fs.exists(self._at(name)) or not self._fs.rename(draft, self._at(name)):
            self._fs.delete(draft, False)
            raise FileExistsError(f"{name} has been committed by another writer")

    def delete(self, name: str, recursive: bool = False) -> None:
        self._fs.delete(self._at(name), recursive)

    def text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


#: Versions between two lists of what is live.
CHECKPOINT = 32


@dataclass(frozen=True)
class Manifest:
    version: int
    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    vectors: list[str] = field(default_factory=list)
    properties: dict[str, str] = field(default_factory=dict)


@dataclass
class State:
    """What a version consists of: live data folders, deletion vectors, and the newest value of every property."""

    added: list[str] = field(default_factory=list)
    vectors: list[str] = field(default_factory=list)
    properties: dict[str, str] = field(default_factory=dict)

    def after(self, m: Manifest) -> State:
        gone = set(m.removed)
        return State([x for x in [*self.added, *m.added] if x not in gone], [*self.vectors, *m.vectors], {**self.properties, **m.properties})


class VersionedTable:
    """A table at ``path`` with a fixed schema. Version 0 is the empty table.

    A member of a ``Store`` has its data below its own ``path`` and its part of the manifests in the store's folder.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, store: str | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.folder = Folder(spark, store or self.path)
        self.part = self.path.rsplit("/", 1)[1] if store else None

    def version(self) -> int:
        found = [int(n[:-5]) for n in self.folder.names("manifests") if n.endswith(".json")]
        return max(found, default=0)

    def manifest(self, version: int) -> Manifest:
        if not version:
            return Manifest(0)
        d = json.loads(self.folder.text(f"manifests/{version:020d}.json"))
        return Manifest(version, **d["tables"].get(self.part, {}), properties=d["properties"]) if self.part else Manifest(**d)

    def manifests(self, after: int, upto: int) -> list[Manifest]:
        return [self.manifest(v) for v in range(after + 1, upto + 1)]

    def state(self, version: int) -> State:
        """The newest checkpoint up to a version and the manifests behind it."""
        sub = f"checkpoints/{self.part}" if self.part else "checkpoints"
        known = [v for v in (int(n[:-5]) for n in self.folder.names(sub)) if v <= version]
        at, state = max(known, default=0), State()
        if at:
            state = State(**json.loads(self.folder.text(f"{sub}/{at:020d}.json")))
        for m in self.manifests(at, version):
            state = state.after(m)
        return state

    def checkpoint(self, version: int) -> None:
        sub = f"checkpoints/{self.part}" if self.part else "checkpoints"
        with contextlib.suppress(FileExistsError):
            self.folder.create(f"{sub}/{version:020d}.json", json.dumps(self.state(version).__dict__))

    def write(self, added: DataFrame | None = None, deleted: DataFrame | None = None, removed: list[str] | None = None) -> dict[str, list[str]]:
        """The files of a change, which nothing shows yet: what a manifest says of it."""
        new, vectors = [], []
        if added is not None:
            new = [f"data/{uuid.uuid4().hex}"]
            added.select(*self.schema.names).write.parquet(f"{self.path}/{new[0]}")
        if deleted is not None:
            vectors = [f"vectors/{uuid.uuid4().hex}"]
            deleted.select("_file", "_row").write.parquet(f"{self.path}/{vectors[0]}")
        return {"added": new, "removed": removed or [], "vectors": vectors}

    def commit(self, added: DataFrame | None = None, deleted: DataFrame | None = None, removed: list[str] | None = None, properties: dict[str, str] | None = None, base: int | None = None) -> int:
        """Publish the next version. ``deleted`` holds (_file, _row) of rows, ``removed`` whole data folders.

        ``base`` is the version the change was computed from; a commit made since then makes this one fail.
        """
        if self.part:
            raise ValueError("a member of a store is committed by the store")
        base = self.version() if base is None else base
        m = Manifest(base + 1, **self.write(added, deleted, removed), properties=properties or {})
        self.folder.create(f"manifests/{m.version:020d}.json", json.dumps(m.__dict__))
        if m.version % CHECKPOINT == 0:
            self.checkpoint(m.version)
        return m.version

    def drop_dead(self, keep: int) -> int:
        """Delete the data folders that no version from ``keep`` on has; older versions can't be read afterwards."""
        live = set(self.state(keep).added)
        dead = [x for m in self.manifests(0, keep) for x in m.removed if x not in live]
        data = Folder(self.spark, self.path)
        for x in dead:
            data.delete(x, True)
        return len(dead)

    def _read(self, folders: list[str]) -> DataFrame:
        """Rows of data folders with ``_file`` (below the table) and ``_row``."""
        if not folders:
            wide = T.StructType([*self.schema.fields, T.StructField("_file", T.StringType()), T.StructField("_row", T.LongType())])
            return self.spark.createDataFrame([], wide)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{x}" for x in folders])
        below = F.regexp_extract(F.col("_metadata.file_path"), r"(data/[0-9a-f]{32}/[^/]+)$", 1)
        return rows.select("*", below.alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def _vectors(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], "_file string, _row long")
        return self.spark.read.schema("_file string, _row long").parquet(*[f"{self.path}/{x}" for x in folders])

    def snapshot(self, version: int | None = None, positions: bool = False) -> DataFrame:
        """The rows of a version (the newest by default), with ``positions`` also ``_file`` and ``_row``."""
        state = self.state(self.version() if version is None else version)
        live, vectors = state.added, state.vectors
        rows = self._read(live)
        if vectors:
            rows = rows.join(self._vectors(vectors), ["_file", "_row"], "left_anti")
        return rows if positions else rows.select(*self.schema.names)

    def changes(self, after: int, upto: int | None = None) -> DataFrame:
        """Record deltas between two versions: the table's columns and ``change`` (``insert`` or ``delete``).

        Only files and vectors named by the manifests in between are read. Rows that came and went in between are left out.
        """
        upto = self.version() if upto is None else upto
        between = self.manifests(after, upto)
        removed = {x for m in between for x in m.removed}
        added = [x for m in between for x in m.added]
        vectors = self._vectors([x for m in between for x in m.vectors])
        inserts = self._read([x for x in added if x not in removed]).join(vectors, ["_file", "_row"], "left_anti")
        old = self.state(after)
        before = old.added
        touched = [x for x in before if x in removed]
        deletes = self._read(touched)
        if any(m.vectors for m in between):  # rows of older files that the new vectors cover
            kept = [x for x in before if x not in removed]
            deletes = deletes.unionByName(self._read(kept).join(vectors, ["_file", "_row"], "left_semi"))
        if old.vectors:
            deletes = deletes.join(self._vectors(old.vectors), ["_file", "_row"], "left_anti")
        names = self.schema.names
        return inserts.select(*names, F.lit("insert").alias("change")).unionByName(deletes.select(*names, F.lit("delete").alias("change")))

    def processed(self, consumer: str) -> int:
        """The source version that this table's commits have processed for a consumer; 0 before the first."""
        return int(self.state(self.version()).properties.get(f"processed:{consumer}", 0))

    def merge(self, marks: DataFrame, key: list[str], properties: dict[str, str] | None = None, whole: bool = False) -> int:
        """Bring the table to ``marks`` (one row per key) where they differ: a vector for the superseded rows, files for
        new and changed ones. Keys that ``marks`` doesn't name stay as they are, or go if ``marks`` is the ``whole`` table.

        Where nothing differs and no property is set, no version is made. Returns the version that holds the marks.
        """
        base = self.version()
        values = [c for c in self.schema.names if c not in key]
        old = self.snapshot(base, positions=True).select(*key, F.struct(F.lit(True).alias("_there"), *values).alias("_old"), "_file", "_row", F.lit(True).alias("_held"))
        new = marks.select(*key, F.struct(F.lit(True).alias("_there"), *values).alias("_new"), F.lit(True).alias("_named"))
        both = new.join(old, key, "full" if whole else "left")
        differs = F.col("_held").isNull() | F.col("_named").isNull() | ~F.col("_new").eqNullSafe(F.col("_old"))
        changed = materialize(both.where(differs), "changed_marks")
        if not properties and changed.isEmpty():
            return base
        stale = changed.where("_held").select("_file", "_row")
        return self.commit(changed.where("_named").select(*key, "_new.*"), stale, properties=properties, base=base)


class Store:
    """Tables below ``path`` that change together: one manifest names the changes of all of them, so a reader never sees
    the new rows of one beside the old rows of another."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]) -> None:
        self.path = path.rstrip("/")
        self.tables = {n: VersionedTable(spark, f"{self.path}/{n}", s, self.path) for n, s in schemas.items()}
        self.folder = Folder(spark, self.path)

    def __getitem__(self, name: str) -> VersionedTable:
        return self.tables[name]

    def version(self) -> int:
        return next(iter(self.tables.values())).version()

    def commit(self, changes: dict[str, tuple[DataFrame | None, DataFrame | None]], properties: dict[str, str] | None = None, base: int | None = None) -> int:
        """Publish (added, deleted) rows of some tables as the next version of all."""
        base = self.version() if base is None else base
        parts = {n: self.tables[n].write(added, deleted) for n, (added, deleted) in changes.items()}
        self.folder.create(f"manifests/{base + 1:020d}.json", json.dumps({"tables": parts, "properties": properties or {}}))
        if (base + 1) % CHECKPOINT == 0:
            for t in self.tables.values():
                t.checkpoint(base + 1)
        return base + 1


def process_new(source: VersionedTable, target: VersionedTable, consumer: str, step: Callable[[DataFrame], DataFrame]) -> int | None:
    """Run ``step`` on the record deltas since the consumer's last commit and publish its rows with the new progress.

    Returns the target's new version, or None if nothing was new. A failure before the manifest is created changes
    nothing, and the next run sees the same deltas; after it, they are never seen again.
    """
    base, done, upto = target.version(), target.processed(consumer), source.version()
    if done >= upto:
        return None
    return target.commit(step(source.changes(done, upto)), properties={f"processed:{consumer}": str(upto)}, base=base)
