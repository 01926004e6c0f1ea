"""What the next run must index: present marks of scanned items against the marks of the last valid index rows.

Marks live in versioned tables: ``seen`` (what scans saw), ``held`` (what the index has) and ``due`` (the answer). Bringing
``seen`` and ``held`` up to date writes only what differs; the manifests between two versions say which items that were, and
only those items are judged anew. The commit of ``due`` carries the versions of ``seen`` and ``held`` it has processed.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranksight.operators.versions import VersionedTable
from ranksight.runtime import materialize, table_dir

MARKS = "item_kind string, item_key string, mark string"


def file_key(c: Column) -> Column:
    """A path with ``/`` for ``\\`` and without leading ``./``."""
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(?:\./)+", "")


def file_mark(c: Column) -> Column:
    """The first 16 hex digits of a content hash, in lower case."""
    return F.lower(F.substring(c, 1, 16))


def with_last_run(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """As-of join: ``rows`` (with ``item_kind``, ``indexed_at``) and the ``outcome`` of the last run of that kind started at or before it.

    Runs are grouped by day and each day also gets the last run before it, so the join is an equi-join on (kind, day)
    that a busy kind does not turn into one task. Runs without a start are none; of runs started at once the largest
    ``run_id`` counts. Rows with a null time, or before the first run, get a null outcome.
    """
    start = runs.where("started_at is not null and item_kind is not null").select("item_kind", F.to_date("started_at").alias("day"), F.struct("started_at", "run_id", "outcome").alias("run"))
    days = rows.where("indexed_at is not null").select("item_kind", F.to_date("indexed_at").alias("day")).distinct()
    per_day = start.groupBy("item_kind", "day").agg(F.array_sort(F.collect_list("run")).alias("own"), F.max("run").alias("last"))
    # one row per kind and day; the last run before each day is a running maximum over these
    grid = days.join(per_day, ["item_kind", "day"], "full")
    before = Window.partitionBy("item_kind").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("carried", F.max("last").over(before)).select("item_kind", "day", F.array_compact(F.concat(F.array("carried"), F.coalesce("own", F.slice(F.array("carried"), 1, 0)))).alias("known"))
    joined = rows.withColumn("day", F.to_date("indexed_at")).join(grid, ["item_kind", "day"], "left")
    known = F.expr("array_max(filter(known, r -> r.started_at <= indexed_at))")
    return joined.withColumn("outcome", known["outcome"]).drop("known", "day")


def index_marks(files: DataFrame, sources: DataFrame, runs: DataFrame) -> DataFrame:
    """(item_kind, item_key, mark) of the latest valid row of every item: written while the last run had outcome ``ok``."""
    rows = files.select(F.lit("file").alias("item_kind"), file_key(F.col("path")).alias("item_key"), file_mark(F.col("content_hash")).alias("mark"), "indexed_at").unionByName(
        sources.select(F.lit("source").alias("item_kind"), F.col("source_key").alias("item_key"), F.col("fingerprint").alias("mark"), "indexed_at")
    )
    valid = with_last_run(rows.where("item_key is not null"), runs).where("outcome = 'ok'")
    return valid.groupBy("item_kind", "item_key").agg(F.max(F.struct("indexed_at", "mark")).alias("last")).select("item_kind", "item_key", "last.mark")


def present_marks(scan_log: DataFrame) -> DataFrame:
    """(item_kind, item_key, mark): of every scanned item the non-null mark seen last; null if none was ever read."""
    is_file = F.col("item_kind") == "file"
    rows = scan_log.where("item_kind is not null and item_key is not null").select(
        "item_kind",
        F.when(is_file, file_key(F.col("item_key"))).otherwise(F.col("item_key")).alias("item_key"),
        F.when(is_file, file_mark(F.col("seen_mark"))).otherwise(F.col("seen_mark")).alias("mark"),
        "seen_at",
    )
    last = F.max(F.when(F.col("mark").isNotNull(), F.struct("seen_at", "mark")))
    return rows.groupBy("item_kind", "item_key").agg(last.alias("last")).select("item_kind", "item_key", "last.mark")


class IndexPlan:
    """The state of planning in a folder, carried from run to run.

    A run calls ``see`` and ``hold`` with what it knows, then ``due``. Each of the three is one commit, or none if nothing
    differs. A run that dies in between leaves versions that the next ``due`` finds unprocessed, so no item is skipped, and
    none is judged twice: an item stays in ``due``, whatever runs do in the meantime, until ``hold`` shows its present mark.
    """

    KEY = ["item_kind", "item_key"]

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.seen, self.held, self.waiting = (VersionedTable(spark, f"{path}/{n}", MARKS) for n in ("seen", "held", "due"))

    def see(self, marks: DataFrame, whole: bool = True) -> int:
        """(item_kind, item_key, mark) as scans saw them last: of all items, or only of those that changed."""
        return self.seen.merge(marks, self.KEY, whole=whole)

    def hold(self, marks: DataFrame, whole: bool = True) -> int:
        """(item_kind, item_key, mark) of what the index validly has: all of it, or only what a run added."""
        return self.held.merge(marks, self.KEY, whole=whole)

    def due(self) -> DataFrame:
        """(item_kind, item_key) of the items to index.

        Items named by the manifests since the last commit are joined with the newest marks; the rest stays as it is.
        """
        base, tables = self.waiting.version(), {"seen": self.seen, "held": self.held}
        done = {n: self.waiting.processed(n) for n in tables}
        upto = {n: t.version() for n, t in tables.items()}
        if any(done[n] < upto[n] for n in tables):
            deltas = [t.changes(done[n], upto[n]).select(*self.KEY) for n, t in tables.items() if done[n] < upto[n]]
            touched = materialize(reduce(DataFrame.unionByName, deltas).distinct(), "touched_items")
            now = self.seen.snapshot(upto["seen"]).join(touched, self.KEY, "left_semi")
            was = self.held.snapshot(upto["held"]).join(touched, self.KEY, "left_semi").select(*self.KEY, F.struct("mark").alias("held"))
            unknown = F.col("held").isNull()
            differs = F.col("mark").isNotNull() & ~F.col("mark").eqNullSafe(F.col("held.mark"))
            fresh = now.join(was, self.KEY, "left").where(unknown | differs).select(*self.KEY, "mark")
            stale = self.waiting.snapshot(base, positions=True).join(touched, self.KEY, "left_semi").select("_file", "_row")
            self.waiting.commit(fresh, stale, properties={f"processed:{n}": str(v) for n, v in upto.items()}, base=base)
        return self.waiting.snapshot().select(*self.KEY)


def items_to_index(scan_log: DataFrame, files: DataFrame, sources: DataFrame, runs: DataFrame, path: str | None = None) -> DataFrame:
    """(item_kind, item_key) of exactly the items the next run must index.

    An item of the scans is due if it has no valid index row or its latest valid row has another mark; a valid row was
    written (``indexed_at`` not null) when the last run of its kind started at or before then has outcome ``ok``.
    Late, repeated and unordered scan rows, null marks, repeated index rows and rows of failed, crashed or unfinished
    runs are all allowed for. An item whose marks are all null is due only if it has no valid row: nothing says that it
    changed. Null keys are no items. Items that are no longer scanned are not due. Empty tables are allowed.

    ``path`` is the folder of the plan (see ``IndexPlan``). A call on a plan that earlier calls left writes and judges only
    what has changed since; the answer is that of the tables as they are now, whatever the plan holds.
    """
    spark = scan_log.sparkSession
    plan = IndexPlan(spark, path or f"{table_dir(spark)}/plan-{uuid.uuid4().hex}")
    for last in (False, False, True):
        try:
            plan.hold(index_marks(files, sources, runs))
            plan.see(present_marks(scan_log))
            return plan.due()
        except FileExistsError:  # another run on the same plan committed first; its versions are the new base
            if last:
                raise
