"""Hybrid search of a query batch: keyword and vector branch, fusion, reranking, abstention, result rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranksight.functions.stem import stem_query_column
from ranksight.functions.text import snippet
from ranksight.operators import fusion, knn
from ranksight.operators.bm25 import InvertedIndex, bm25, query_terms
from ranksight.settings import EMBED_BATCH, EMBED_CHARS, KB, MODES, SearchProfile

Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(dim: int = 64) -> Embedder:
    """A stand-in for a model: signed hashes of words, unit length. The same text always has the same vector."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h & 1 << 20 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()

    return embed


def embed(rows: DataFrame, embedder: Embedder, text: str = "text", column: str = "embedding", batch: int = EMBED_BATCH) -> DataFrame:
    """``rows`` with the vector of ``text`` by ``embedder``, ``batch`` texts at a time; null for null.

    A text over EMBED_CHARS characters is cut into pieces of that size; its vector is the mean of theirs, weighted by length.

    A failure is tried again once, then fails the job: no row is ever stored without its vector.
    """
    schema = T.StructType([f for f in rows.schema.fields if f.name != column] + [T.StructField(column, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found: list = [None] * len(f)
            at = [i for i, t in enumerate(f[text]) if isinstance(t, str)]
            pieces = [(i, t[k : k + EMBED_CHARS]) for i in at for t in (f[text].iloc[i],) for k in range(0, max(len(t), 1), EMBED_CHARS)]
            for a in range(0, len(pieces), batch):
                texts = [t for _, t in pieces[a : a + batch]]
                try:
                    got = embedder(texts)
                except Exception:  # noqa: BLE001
                    got = embedder(texts)
                if len(got) != len(texts):
                    raise RuntimeError(f"{len(got)} vectors for {len(texts)} texts")
                for (i, t), v in zip(pieces[a : a + batch], got):
                    found[i] = [*(found[i] or []), (max(len(t), 1), v)]
            found = [None if x is None else x[0][1] if len(x) == 1 else np.average([v for _, v in x], axis=0, weights=[n for n, _ in x]).tolist() for x in found]
            yield f.assign(**{column: found})[schema.names]

    return rows.mapInPandas(run, schema)


@dataclass
class SearchCorpus:
    """Chunks (id, text and what results show), their keyword index, and their vectors (id, embedding), if there are any."""

    chunks: DataFrame
    index: InvertedIndex
    vectors: DataFrame | None = None


def search(corpus: SearchCorpus, queries: DataFrame, k: int = 10, mode: str = "hybrid", profile: SearchProfile = KB, allowed: DataFrame | None = None, scorer: fusion.Scorer | None = None, stemmed: bool = False) -> DataFrame:
    """(query_id, rank, id, score, snippet, low_confidence, and the other columns of the chunks) of every query.

    ``queries``: (query_id, query, and for vectors embedding). ``allowed`` (id) is the outcome of the filters; it applies before
    the cuts. ``mode``: ``keyword``, ``semantic`` (needs vectors) or ``hybrid`` (keyword only where there are no vectors).
    ``k`` is held between 1 and the profile's most. Ties go to the smaller id. Scores are rounded to 4 digits.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    k = min(max(1, k), profile.most_k)
    pool = profile.pool(k, allowed is not None)
    has_vectors = corpus.vectors is not None and "embedding" in queries.columns
    if mode == "semantic" and not has_vectors:
        raise RuntimeError("semantic search needs vectors of chunks and queries")
    branches = []
    if mode != "semantic":
        words = stem_query_column(F.col("query"), profile.analyzer == "identifiers") if stemmed else None
        hits = bm25(corpus.index, query_terms(queries, words=words), pool, allowed)
        branches.append(hits.select("query_id", "id", "score", F.lit("bm25").alias("source")))
    if mode != "keyword" and has_vectors:
        reach = corpus.vectors.join(allowed.select("id").distinct(), "id", "left_semi") if allowed is not None else corpus.vectors
        near = knn.nearest(reach, queries, pool, "id")
        branches.append(near.select("query_id", "id", "score", F.lit("vector").alias("source")))
    hits = branches[0] if len(branches) == 1 else branches[0].unionByName(branches[1])
    ranked = fusion.reciprocal_ranks(hits) if mode == "hybrid" else fusion.best_scores(hits)
    if scorer is not None and profile.rerank:
        ranked = fusion.rerank(ranked, corpus.chunks, queries, scorer, k)
    ranked = ranked.where(F.col("rank") <= k)
    if profile.abstain:
        best = None
        if has_vectors:  # of the whole index, whatever the filters
            best = knn.nearest(corpus.vectors, queries, 1, "id").select("query_id", F.col("score").alias("similarity"))
        ranked = ranked.join(fusion.confidence(ranked, queries, best), "query_id", "left")
    else:
        ranked = ranked.withColumn("low_confidence", F.lit(None).cast("boolean"))
    shown = corpus.chunks.drop("low_confidence", "score", "rank", "snippet", "query_id")
    full = ranked.join(shown, "id", "left")
    return full.select("query_id", "rank", "id", F.round("score", 4).alias("score"), snippet(F.col("text")).alias("snippet"), "low_confidence", *[c for c in shown.columns if c not in ("id", "text")])
