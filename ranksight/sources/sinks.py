"""Sinks: result rows as JSON lines, a calendar file, and texts written back to their files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranksight.operators.tasks import calendar


def json_rows(results: DataFrame, digits: int = 4) -> DataFrame:
    """(value) one JSON object per row; doubles rounded; null fields left out."""
    kinds = dict(results.dtypes)
    cols = [F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in results.columns]
    return results.select(F.to_json(F.struct(*cols)).alias("value"))


def write_json(results: DataFrame, path: str) -> None:
    json_rows(results).write.mode("overwrite").text(path)


def write_calendar(tasks: DataFrame, path: str, stamp: str) -> None:
    """One calendar file in the folder ``path``, events in the order of their ids. Tasks are few enough for one file by their nature."""
    spark = tasks.sparkSession
    head = spark.createDataFrame([(0, "", "BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//ranksight//tasks//EN"), (2, "", "END:VCALENDAR")], "part int, id string, event string")
    events = calendar(tasks, stamp).select(F.lit(1).alias("part"), F.col("id").cast("string").alias("id"), "event")
    head.unionByName(events).orderBy("part", "id").select("event").coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_texts(files: DataFrame, root: str) -> int:
    """Write (path, content) below ``root``, a folder that all executors share; each file is replaced at once. Returns how many.

    Rows with a null path or content, and paths that leave the folder, are not written.
    """

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = 0
            for path, text in zip(f["path"], f["content"]):
                full = os.path.normpath(os.path.join(root, path)) if path is not None else ""
                if text is None or not full.startswith(os.path.normpath(root) + os.sep):
                    continue
                os.makedirs(os.path.dirname(full), exist_ok=True)
                draft = f"{full}.{os.getpid()}.draft"
                with open(draft, "w", encoding="utf-8", newline="") as out:
                    out.write(text)
                os.replace(draft, full)
                n += 1
            yield pd.DataFrame({"n": [n]})

    return files.select("path", "content").mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
