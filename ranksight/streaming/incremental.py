"""Indexing as a stream: files that arrive in a folder are chunked and committed once each, then the query stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranksight.operators.versions import VersionedTable


def index_available(spark: SparkSession, source: str, schema: T.StructType, target: VersionedTable, step: Callable[[DataFrame], DataFrame], checkpoint: str, consumer: str = "stream", files_per_batch: int = 1_000) -> int:
    """Process all files of ``source`` (Parquet) that no earlier run has processed, and return the target's version.

    Each micro-batch is one commit that carries its number; a batch that is run again after a failure finds its number
    in the target and adds nothing.
    """

    def commit(batch: DataFrame, number: int) -> None:
        if target.processed(consumer) < number + 1:
            target.commit(step(batch), properties={f"processed:{consumer}": str(number + 1)})

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return target.version()


def event_windows(events: DataFrame, ts: str, key: str, value: str, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, key, n, total) of tumbling windows, on a stream with a watermark or on a table alike."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
