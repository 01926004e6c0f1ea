"""The life of an index: what changed, how much of it fits a budget, replacing and dropping chunks, versions and health."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranksight.operators.versions import Folder, VersionedTable
from ranksight.runtime import broadcast_if_small, materialize, parallelism


def diff(current: DataFrame, stored: DataFrame, key: list[str], mark: Column | str) -> DataFrame:
    """(key, state): ``new``, ``changed``, ``removed`` or ``same``, by the mark (a content hash, or a struct of kind and hash).

    Both sides have one row per key; a null mark differs from any other.
    """
    mark = F.col(mark) if isinstance(mark, str) else mark
    a = current.select(*key, F.struct(mark.alias("m")).alias("now"))
    b = stored.select(*key, F.struct(mark.alias("m")).alias("was"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("now").eqNullSafe(F.col("was")), "same").otherwise("changed")
    return a.join(b, key, "full").select(*key, state.alias("state"))


def _parts(rows: DataFrame, parts: int | None) -> int:
    """Range partitions of an order: as many as shuffles have, unless told otherwise."""
    return parts or parallelism(rows.sparkSession)


def places(rows: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """``rows`` with ``place`` from 1 in the order: ranks within ranges plus the sizes of the ranges before.

    Range bounds are sampled anew by every job, so the parts are fixed in a table before two jobs use them.
    """
    ranges = materialize(rows.repartitionByRange(_parts(rows, parts), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = ranges.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_base"))  # `parts` rows
    return ranges.withColumn("_in", inner).join(F.broadcast(base), "_part").withColumn("place", F.col("_base") + F.col("_in")).drop("_part", "_in", "_base")


def soft_budget(items: DataFrame, size: str, order: list[Column], budget: int, parts: int | None = None) -> DataFrame:
    """Items in order while the sum of those before is under the budget; the last one may go over it.

    Prefix sums are taken over range partitions of the order (see ``places``) and their totals, so no task holds all items.
    """
    spread = materialize(items.repartitionByRange(_parts(items, parts), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    within = F.sum(size).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    totals = spread.groupBy("_part").agg(F.sum(size).alias("_n"))
    before = totals.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_base")  # `parts` rows
    return spread.withColumn("_in", F.coalesce(within, F.lit(0))).join(F.broadcast(before), "_part").where(F.col("_base") + F.col("_in") < budget).drop("_part", "_in", "_base")


#: Items that the driver folds at a time.
FOLD_BLOCK = 1_000


def hard_budget(items: DataFrame, size: str, order: list[Column], budget: int) -> DataFrame:
    """First fit: items in order, each taken if it still fits; the first is taken in any case, so no item waits for ever.

    Items without a size (0, null or less) always fit and are taken by a filter. The others are folded a block of the
    next FOLD_BLOCK candidates at a time; what is over the rest of the budget then can't fit any more, so each round
    shrinks the candidates, and the first of a round always fits. The driver holds one block and the taken items, which
    are at most ``budget``. Ties in the order go to the smaller size; where those tie too the items are alike.
    """
    spark = items.sparkSession
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    keyed = materialize(places(items.withColumn("_size", n), [*order, F.col("_size")]).withColumnRenamed("place", "_place"), "numbered")
    first = keyed.where("_place = 1").select("_place", "_size").collect()
    if not first:
        return items
    left, at, taken = budget - first[0][1], 1, [1]
    while left > 0:
        block = keyed.where((F.col("_place") > at) & (F.col("_size") > 0) & (F.col("_size") <= left)).orderBy("_place").select("_place", "_size").limit(FOLD_BLOCK).collect()
        for place, need in block:
            if need <= left:
                left -= need
                taken.append(place)
        if len(block) < FOLD_BLOCK:
            break
        at = block[-1][0]
    # items without a size are taken up to the one that fills the budget
    last = F.lit(True) if left > 0 else F.col("_place") <= taken[-1]
    picked = broadcast_if_small(spark.createDataFrame([(x,) for x in taken], "_place long"))
    sized = keyed.join(picked, "_place", "left_semi")
    return sized.unionByName(keyed.where((F.col("_size") <= 0) & (F.col("_place") > 1) & last)).drop("_place", "_size")


def replace_chunks(table: VersionedTable, changed: DataFrame, chunks: DataFrame, key: list[str], properties: dict[str, str] | None = None) -> int:
    """One commit that drops the chunks of all keys in ``changed`` (new, changed and removed ones) and adds ``chunks``."""
    base = table.version()
    old = table.snapshot(base, positions=True).join(changed.select(*key).distinct(), key, "left_semi").select("_file", "_row")
    return table.commit(chunks, old, properties=properties, base=base)


def collect_garbage(chunks: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """Chunks whose source is still there."""
    return chunks.join(sources.select(*key).distinct(), key, "left_semi")


def orphans(rows: DataFrame, owners: DataFrame, key: list[str]) -> DataFrame:
    """Rows without an owner."""
    return rows.join(owners.select(*key).distinct(), key, "left_anti")


def freshness(current: DataFrame, stored: DataFrame, key: list[str], mark: str) -> DataFrame:
    """One row (new, changed, removed, same)."""
    d = diff(current, stored, key, mark)
    return d.agg(*[F.coalesce(F.sum((F.col("state") == s).cast("long")), F.lit(0).cast("long")).alias(s) for s in ("new", "changed", "removed", "same")])


def zero_filled(rows: DataFrame, column: str, known: tuple[str, ...]) -> DataFrame:
    """(column, n) for every known value, also those without rows, and for the values that are there besides."""
    spark = rows.sparkSession
    base = spark.createDataFrame([(k,) for k in known], f"{column} string")
    n = rows.groupBy(column).agg(F.count("*").alias("n"))
    return base.join(n, column, "full").select(column, F.coalesce("n", F.lit(0)).alias("n"))


class RebuildLock:
    """A marker file for one writer at a time; taken over when it is older than ``stale`` seconds."""

    def __init__(self, spark: SparkSession, path: str, stale: float = 1_800) -> None:
        self.folder, self.stale, self.name, self.token = Folder(spark, path), stale, "rebuild.lock", uuid.uuid4().hex

    def __enter__(self) -> RebuildLock:
        import time

        if self.folder.exists(self.name):
            held = float(self.folder.text(self.name).split("|")[1])
            if time.time() - held < self.stale:
                raise BlockingIOError("the index is being rebuilt")
            self.folder.delete(self.name)
        try:
            self.folder.create(self.name, f"{self.token}|{time.time()}")
        except FileExistsError:
            raise BlockingIOError("the index is being rebuilt") from None
        return self

    def __exit__(self, *_: object) -> None:
        if self.folder.exists(self.name) and self.folder.text(self.name).startswith(self.token):
            self.folder.delete(self.name)


class Meta:
    """Named JSON values beside a table; the newest value of a name counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = VersionedTable(spark, path, "name string, value string, at long")

    def set(self, name: str, value: object) -> None:
        import json

        row = self.table.spark.createDataFrame([(name, json.dumps(value), self.table.version() + 1)], self.table.schema)
        self.table.commit(row)

    def get(self, name: str, default: object = None) -> object:
        import json

        r = self.table.snapshot().where(F.col("name") == name).agg(F.max_by("value", "at")).first()[0]
        return default if r is None else json.loads(r)


def publish(spark: SparkSession, root: str, build, refuse=None) -> str:
    """Full rebuild: ``build(path)`` writes a new version beside the old one, then the pointer moves.

    ``refuse()`` is asked after the build; if it gives a reason, the old version stays. Readers follow ``current(root)``.
    """
    folder = Folder(spark, root)
    path = f"{root}/v-{uuid.uuid4().hex}"
    build(path)
    reason = refuse() if refuse else None
    if reason:
        folder.delete(path.rsplit("/", 1)[1], True)
        raise RuntimeError(f"not published: {reason}")
    names = folder.names("pointers")
    folder.create(f"pointers/{int(names[-1]) + 1 if names else 1:012d}", path)
    for old in names[:-1]:  # the version before stays for searches that have begun
        folder.delete(folder.text(f"pointers/{old}").rsplit("/", 1)[1], True)
        folder.delete(f"pointers/{old}")
    return path


def current(spark: SparkSession, root: str) -> str | None:
    folder = Folder(spark, root)
    names = folder.names("pointers")
    return folder.text(f"pointers/{names[-1]}") if names else None
