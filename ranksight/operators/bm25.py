"""BM25 over an inverted index of DataFrames.

The index is three tables: postings (term, id, tf, positions), lengths (id, dl) and one row of statistics. Only the text is
searched, but a record's length counts the terms of its other indexed columns too. Scores sum over the occurrences of the
query's terms: idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6, times tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)).
A query term of several index terms (``a_b``) is a phrase: its tf counts places where they follow each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranksight.functions.text import query_words, terms
from ranksight.runtime import broadcast_if_small, materialize, parallelism, spread
from ranksight.settings import BM25_B, BM25_K1, IDF_FLOOR


#: Up to this many query terms are looked up by a filter, which reaches the scan of a stored index; more are joined.
FILTERED_TERMS = 2_000


def index_tables(records: DataFrame, id_col: str, text: Column, others: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(lengths: id, dl) and (words: id, at, term) of every record with an id."""
    rows = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text.alias("_text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(others)])
    total = F.size(terms(F.col("_text")))
    for i in range(len(others)):
        total = total + F.size(terms(F.col(f"_{i}")))
    return rows.select("id", total.alias("dl")), rows.select("id", F.posexplode(terms(F.col("_text"))).alias("at", "term"))


def postings_of(words: DataFrame) -> DataFrame:
    """(term, id, tf, positions) of (id, at, term), clustered by term, so that a query reads the row groups of its terms only."""
    lists = words.groupBy("term", "id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"))
    return lists.repartitionByRange("term").sortWithinPartitions("term", "id")


@dataclass
class InvertedIndex:
    """``words`` (id, at, term) of an index that isn't stored: its postings are made for the terms of a query only."""

    lengths: DataFrame
    stats: DataFrame
    postings: DataFrame | None = None
    words: DataFrame | None = None

    @classmethod
    def build(cls, records: DataFrame, id_col: str, text: Column, others: tuple[str, ...] = ()) -> InvertedIndex:
        """Index ``text`` of every record. A record with a null text has no postings but counts; null ids are left out.

        Records are taken as delivered: repeated ids must be dropped before.
        """
        lengths, words = index_tables(spread(records), id_col, text, others)
        return cls.stored(materialize(lengths, "lengths"), None, words)

    @classmethod
    def stored(cls, lengths: DataFrame, postings: DataFrame | None, words: DataFrame | None = None) -> InvertedIndex:
        return cls(lengths, lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")), postings, words)

    def lookup(self, wanted: DataFrame | list[str] | None = None, positions: bool = True) -> DataFrame:
        """Postings (term, id, tf, positions) of the distinct ``wanted`` terms (a list or a column ``term``), or of all."""
        source = self.postings if self.postings is not None else self.words
        if isinstance(wanted, list):
            source = source.where(F.col("term").isin(wanted)) if wanted else source.where(F.lit(False))
        elif wanted is not None:
            source = source.join(broadcast_if_small(wanted), "term", "left_semi")
        if self.postings is not None:
            return source if positions else source.select("term", "id", "tf")
        places = [F.array_sort(F.collect_list("at")).alias("positions")] if positions else []
        return source.groupBy("term", "id").agg(F.count("*").alias("tf"), *places)

    def save(self, path: str) -> None:
        """The index as tables below ``path``; ``lengths`` come last, so an index with lengths is complete."""
        postings_of(self.words).write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> InvertedIndex:
        return cls.stored(spark.read.parquet(f"{path}/lengths"), spark.read.parquet(f"{path}/postings"))


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "query", words: Column | None = None) -> DataFrame:
    """(query_id, term, parts) for every occurrence of a term; ``parts`` are its index terms. Null queries have none."""
    found = queries.select(F.col(query_id).alias("query_id"), F.explode(words if words is not None else query_words(F.col(text))).alias("term"))
    return found.withColumn("parts", terms(F.col("term"))).where(F.size("parts") > 0)


def match_counts(index: InvertedIndex, wanted: DataFrame) -> DataFrame:
    """(term, id, tf) of the distinct terms of ``wanted`` (term, parts)."""
    asked = wanted.select("term", "parts").distinct()
    few = asked.limit(FILTERED_TERMS + 1).collect()
    known = len(few) <= FILTERED_TERMS  # then the terms go into the scan's filter, and what no query needs is not computed
    one = asked.where(F.size("parts") == 1).select("term", F.col("parts")[0].alias("index_term"))
    terms_of = lambda rows: sorted({p for r in rows for p in r["parts"]})
    single = index.lookup(terms_of(r for r in few if len(r["parts"]) == 1) if known else one.select(F.col("index_term").alias("term")).distinct(), positions=False)
    if known and all(r["parts"] == [r["term"]] for r in few):
        return single
    hits = single.withColumnRenamed("term", "index_term").join(broadcast_if_small(one), "index_term").select("term", "id", "tf")
    if known and all(len(r["parts"]) == 1 for r in few):
        return hits
    placed = asked.where(F.size("parts") > 1).select("term", F.size("parts").alias("n"), F.posexplode("parts").alias("offset", "index_term"))
    lists = index.lookup(terms_of(r for r in few if len(r["parts"]) > 1) if known else placed.select(F.col("index_term").alias("term")).distinct())
    found = lists.withColumnRenamed("term", "index_term").join(broadcast_if_small(placed), "index_term")
    starts = found.select("term", "n", "id", F.explode(F.transform("positions", lambda p: p - F.col("offset"))).alias("start"))
    whole = starts.groupBy("term", "n", "id", "start").agg(F.count("*").alias("k")).where("k = n").groupBy("term", "id").agg(F.count("*").alias("tf"))
    return hits.unionByName(whole)


def bm25(index: InvertedIndex, wanted: DataFrame, k: int | None, allowed: DataFrame | None = None, inverse: bool = False) -> DataFrame:
    """(query_id, id, score, rank) of the best ``k`` records of each query; all with k None.

    ``wanted`` comes from ``query_terms``. ``allowed`` (id) restricts the hits before the cut, but not the statistics.
    Scores are rounded to 10 digits, so that equal records tie whatever the order of the sum; ties go to the smaller id. ``inverse`` gives 1 / (1 + score), which turns the order around, for comparison only.
    """
    tf = materialize(match_counts(index, wanted), "term_counts")
    df = broadcast_if_small(tf.groupBy("term").agg(F.count("*").alias("df")))
    hits = tf.join(allowed.select("id").distinct(), "id", "left_semi") if allowed is not None else tf
    rows = hits.join(df, "term").join(index.lengths, "id").crossJoin(F.broadcast(index.stats))  # one row
    raw = F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw)
    part = idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl")))
    parts = rows.select("id", "term", part.alias("part"))
    occurrences = wanted.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = occurrences.limit(BATCH_TERMS[1] + 1).toArrow() if k is not None and not inverse else None  # an inverse order can't be cut by score
    if asked is not None and BATCH_TERMS[0] <= asked.num_rows <= BATCH_TERMS[1]:
        scored = _batch_scores(parts, asked, max(1, k), wanted.schema["query_id"].dataType.simpleString())
    else:
        scored = parts.join(broadcast_if_small(occurrences), "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("part") * F.col("times")), 10).alias("score"))
    if inverse:
        scored = scored.withColumn("score", 1 / (1 + F.abs("score")))
    return top_k(scored, k)


#: From so many query terms on, and up to so many, a batch of queries is scored by blocks of records. It changes the cost only:
#: a join would make a row of each (query, term, record).
BATCH_TERMS = (2_000, 1_000_000)
#: Numbers in the table of scores that a task holds.
SCORE_CELLS = 4_000_000


def _batch_scores(parts: DataFrame, asked: pa.Table, k: int, kind: str) -> DataFrame:
    """(query_id, id, score): of each block of records its best ``k`` for each query. Records of a block are in the order of
    their ids, so ties go to the smaller one."""
    spark = parts.sparkSession
    queries = pc.unique(asked.column("query_id").combine_chunks())
    names = pc.unique(asked.column("term").combine_chunks())
    q, t = (pc.index_in(asked.column(c), value_set=v).to_numpy() for c, v in (("query_id", queries), ("term", names)))
    o = np.argsort(t, kind="stable")
    shared = spark.sparkContext.broadcast((queries, names, q[o], asked.column("times").to_numpy()[o].astype(np.float64), np.searchsorted(t[o], np.arange(len(names) + 1))))  # at most BATCH_TERMS[1] terms
    id_kind = parts.schema["id"].dataType.simpleString()

    def best(ids: pa.Array, term: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of whole records, in the order of ids."""
        who, _, of, who_times, cut = shared.value
        runs = pc.run_end_encode(ids)
        values, ends = runs.values, runs.run_ends.to_numpy()
        doc = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
        for d0 in range(0, len(ends), max(1, SCORE_CELLS // len(who))):
            d1 = min(len(ends), d0 + max(1, SCORE_CELLS // len(who)))
            lo, hi = (int(ends[d0 - 1]) if d0 else 0), int(ends[d1 - 1])
            score, hit = np.zeros((len(who), d1 - d0)), np.zeros((len(who), d1 - d0), bool)
            by = np.argsort(term[lo:hi], kind="stable") + lo
            edge = np.flatnonzero(np.r_[True, term[by][1:] != term[by][:-1], True])
            for a, b in zip(edge[:-1], edge[1:]):
                x = term[by[a]]
                rows, cols = of[cut[x] : cut[x + 1]], doc[by[a:b]] - d0
                at = np.ix_(rows, cols)
                score[at] += who_times[cut[x] : cut[x + 1], None] * part[by[a:b]]
                hit[at] = True
            score = np.where(hit, np.round(score, 10), -np.inf)
            if score.shape[1] > k:
                first = np.argsort(-score, axis=1, kind="stable")[:, :k]
            else:
                first = np.tile(np.arange(score.shape[1]), (len(who), 1))
            found = np.take_along_axis(score, first, axis=1)
            i, j = np.nonzero(np.isfinite(found))
            yield pa.RecordBatch.from_arrays([who.take(pa.array(i)), values.take(pa.array(first[i, j] + d0)), pa.array(found[i, j])], names=["query_id", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = shared.value[1], None
        for b in batches:
            now = pa.table({"id": b.column(0), "term": pc.index_in(b.column(1), value_set=names), "part": b.column(2)})
            held = now if held is None else pa.concat_tables([held, now])
            if held.num_rows < 200_000:
                continue
            ids = held.column("id").combine_chunks()
            cut = int(pc.run_end_encode(ids).run_ends[-2].as_py()) if len(pc.run_end_encode(ids).run_ends) > 1 else 0
            if cut:  # the last record may go on
                yield from flush(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from flush(held)

    def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        return best(rows.column("id").combine_chunks(), rows.column("term").to_numpy(), rows.column("part").to_numpy())

    n = parallelism(spark)
    return parts.repartition(n, "id").sortWithinPartitions("id").mapInArrow(run, f"query_id {kind}, id {id_kind}, score double")


def top_k(hits: DataFrame, k: int | None, query: str = "query_id") -> DataFrame:
    """Hits with ``rank`` from 1 by score (ties: smaller id), of each query at most ``k`` (at least one)."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "id")))
    return ranked if k is None else ranked.where(F.col("rank") <= max(1, k))
