"""Fusing ranked hits: reciprocal ranks, best scores, origins, reranking and abstention. Hits are (query_id, id, score, source)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranksight.operators.bm25 import top_k
from ranksight.settings import ABSENT_MARGIN, ABSENT_SIMILARITY, ABSENT_TOP_SCORE, RERANK_POOL, RRF_K


def reciprocal_ranks(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, id, score, rank): the sum of 1 / (k + place) over the sources, places from 1 by score (ties: smaller id)."""
    place = F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "id"))
    fused = hits.withColumn("place", place).groupBy("query_id", "id").agg(F.sum(1 / (F.lit(float(k)) + F.col("place"))).alias("score"))
    return top_k(fused, None)


def best_scores(hits: DataFrame) -> DataFrame:
    """(query_id, id, score, rank): each record once, with its best score."""
    return top_k(hits.groupBy("query_id", "id").agg(F.max("score").alias("score")), None)


def merge_origins(hits: DataFrame, k: int, first: str = "project") -> DataFrame:
    """Hits of several origins (column ``origin``) on one scale: scores divided by the best of their origin (0 if that isn't
    positive), at most ``k`` for each query; ties go to the origin ``first``, then to the other origins by name, then to the smaller id."""
    peak = F.max("score").over(Window.partitionBy("query_id", "origin"))
    scaled = hits.withColumn("score", F.when(peak > 0, F.col("score") / peak).otherwise(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), (F.col("origin") != first).cast("int"), "origin", "id")
    return scaled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, k))


Scorer = Callable[[list[tuple[str, str]]], list[float]]


def rerank(hits: DataFrame, texts: DataFrame, queries: DataFrame, scorer: Scorer, k: int) -> DataFrame:
    """The first ``max(20, k)`` hits of each query in the order of ``scorer`` over (query, text) pairs.

    ``texts`` is (id, text), ``queries`` (query_id, query). Where the scorer fails, the hits of that batch keep their order.
    """
    pool = max(RERANK_POOL, k)
    rows = hits.where(F.col("rank") <= pool).join(texts.select("id", "text"), "id", "left").join(queries.select("query_id", "query"), "query_id")
    rows = rows.select("query_id", "id", "score", "rank", "query", "text")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            try:
                f = f.assign(new=scorer(list(zip(f["query"].fillna(""), f["text"].fillna("")))))
            except Exception:  # noqa: BLE001  (any failure of a model falls back to the fused order)
                f = f.assign(new=[None] * len(f))
            yield f[["query_id", "id", "score", "rank", "new"]]

    scored = rows.mapInPandas(run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double, rank int, new double")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("new"), "rank")
    return scored.withColumn("place", F.row_number().over(order)).select("query_id", "id", F.coalesce("new", "score").alias("score"), F.col("place").alias("rank"))


def absent_by_similarity(best: Column, threshold: float = ABSENT_SIMILARITY) -> Column:
    """Whether the best similarity of the whole index says that nothing fits; unknown (null) without one."""
    return best < threshold


def low_confidence(first: Column, second: Column, least: float = ABSENT_TOP_SCORE, margin: float = ABSENT_MARGIN) -> Column:
    """No hit, a weak best hit, or one not far enough ahead of the second."""
    return F.when(first.isNull(), True).when(first < least, True).otherwise(F.coalesce(first - second < margin, F.lit(False)))


def confidence(hits: DataFrame, queries: DataFrame, best: DataFrame | None = None, threshold: float = ABSENT_SIMILARITY) -> DataFrame:
    """(query_id, low_confidence) for every query, by the best similarity (``best``: query_id, similarity) where known, else by its top two scores."""
    two = hits.where("rank <= 2").groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    rows = queries.select("query_id").distinct().join(two, "query_id", "left")
    rows = rows.join(best, "query_id", "left") if best is not None else rows.withColumn("similarity", F.lit(None).cast("double"))
    return rows.select("query_id", F.coalesce(absent_by_similarity(F.col("similarity"), threshold), low_confidence(F.col("first"), F.col("second"))).alias("low_confidence"))
