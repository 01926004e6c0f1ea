"""Frequency of every distinct name: rows and records that hold it, with marks for too rare and too common.

Counts per (name, record) are combined by hash on the map side before each shuffle, so a name in a third of all rows
reaches the reducers as one row per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FrequencyBounds:
    """A name is ``rare`` in fewer than ``least`` records, ``common`` in more than ``most`` of all records."""

    least: int = 3
    most: float = 0.20


#: White space of any script, as a Java class with Unicode rules.
BLANKS = r"[\s\p{Z}\x1c-\x1f\x85]"


def outer_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+$", "")


def entity_key(c: Column) -> Column:
    """Without outer blanks, in lower case, each run of blanks, ``_`` and ``-`` as one ``-``; blank names are null."""
    bare = outer_trim(c)
    return F.when(F.length(bare) > 0, F.regexp_replace(F.lower(bare), r"[\s\p{Z}\x1c-\x1f\x85_-]+", "-"))


def name_frequencies(rows: DataFrame, bounds: FrequencyBounds = FrequencyBounds(), name: str = "entity_name", record: str = "skill_name") -> DataFrame:
    """(entity, n_rows, n_records, mark) for every distinct name; ``mark`` is ``rare``, ``common`` or null.

    Null and blank names are none. A null record name counts towards ``n_rows`` only; record names are compared
    without outer blanks in lower case. A name that is both rare and common (tiny tables) is ``rare``.
    An empty table gives no rows. Repeated rows count in ``n_rows`` each, in ``n_records`` once.
    """
    clean = rows.select(entity_key(F.col(name)).alias("entity"), F.lower(outer_trim(F.col(record))).alias("record"))
    per_record = clean.where("entity is not null").groupBy("entity", "record").agg(F.count("*").alias("n"))
    counts = per_record.groupBy("entity").agg(F.sum("n").alias("n_rows"), F.count("record").alias("n_records"))
    records = clean.where("record is not null").select("record").distinct().agg(F.count("*").alias("total"))
    mark = F.when(F.col("n_records") < bounds.least, "rare").when(F.col("n_records") > F.lit(bounds.most) * F.col("total"), "common")
    return counts.crossJoin(F.broadcast(records)).select("entity", "n_rows", "n_records", mark.alias("mark"))  # one row is joined


def text_term_frequencies(texts: DataFrame, bounds: FrequencyBounds = FrequencyBounds(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, n_occurrences, n_records, mark) for the words (letters and digits, lower case) of all texts.

    Null and empty texts have no words but count as records; an empty table gives no rows.
    """
    words = texts.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("term"))
    per_record = words.groupBy("term", "id").agg(F.count("*").alias("n"))
    counts = per_record.groupBy("term").agg(F.sum("n").alias("n_occurrences"), F.count("id").alias("n_records"))
    total = texts.select(F.col(id_col).alias("id")).distinct().agg(F.count("id").alias("total"))
    mark = F.when(F.col("n_records") < bounds.least, "rare").when(F.col("n_records") > F.lit(bounds.most) * F.col("total"), "common")
    return counts.crossJoin(F.broadcast(total)).select("term", "n_occurrences", "n_records", mark.alias("mark"))
