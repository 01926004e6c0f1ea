"""Evaluation passages in training text: a distributed positional inverted index and rarest-term-first intersection.

The index holds, for blocks of documents, the posting lists (positions) of every word, and is stored as a table with one
row per block; it knows nothing of test items, so any number of them can be looked up in it. A passage of an item is looked up from its rarest words: their
postings, moved back by the word's place in the item, are candidate alignments; the lists of the neighbouring words,
moved by their own places, are intersected with them, so that only alignments with a long enough run of agreeing words stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranksight.llm.shingles import bounded, word_hashes
from ranksight.runtime import materialize, spread


@dataclass(frozen=True)
class LeakConfig:
    """``words``: least length of a passage. ``slop`` > 0 also reports passages whose words lie near their places:
    at least ``near_share`` of ``words`` words, each within ``slop`` words of it. ``block_words`` bounds an index block,
    ``query_words`` the test words that are held against the index at a time, ``look_rows`` the candidates of a task."""

    words: int = 12
    slop: int = 0
    near_share: float = 0.75
    block_words: int = 1_500_000
    query_words: int = 2_000_000
    look_rows: int = 2_000_000

    @property
    def least(self) -> int:
        """Least agreeing words of a proximity match."""
        return max(1, int(np.ceil(self.near_share * self.words - 1e-9)))


class TestItems:
    """Word hashes of a block of test items, with the vocabulary they use."""

    __test__ = False

    def __init__(self, ids: list[int], texts: list[str | None]) -> None:
        self.ids = np.asarray(ids, np.int64)
        self.words, self.sizes = word_hashes(texts)
        self.vocabulary = np.unique(self.words)

    def seeds(self, n: int, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (in ``words``) that hold the rarest word of some run of ``n`` words, and the first place of their item.

        Runs with a word that no document has are left out: they can't occur.
        """
        first = np.r_[0, np.cumsum(self.sizes)]
        df = count[np.searchsorted(self.vocabulary, self.words)]
        out = []
        for i in range(len(self.sizes)):
            own = df[first[i] : first[i + 1]]
            if len(own) < n:
                continue
            windows = np.lib.stride_tricks.sliding_window_view(own, n)
            usable = np.flatnonzero(windows.min(axis=1) > 0)
            out.append(np.unique(usable + windows[usable].argmin(axis=1)) + first[i])
        place = np.concatenate(out) if out else np.zeros(0, np.int64)
        item = np.searchsorted(first, place, side="right") - 1
        return place, item

    def loose_seeds(self, places: range, n: int, least: int, count: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Seeds for ``least`` agreeing words of some ``n`` within ``places``, each with its company.

        ``n - least`` words of a window may fail, so one of its ``n - least + 1`` rarest agrees, and two of its
        ``n - least + 2`` rarest do: a seed that agrees has at least one agreeing word in its company. A word that no
        document has is one that fails.
        """
        df = count[np.searchsorted(self.vocabulary, self.words[places.start : places.stop])]
        rarest = np.lib.stride_tricks.sliding_window_view(df, n).argsort(axis=1, kind="stable") + places.start
        rarest += np.arange(len(rarest))[:, None]
        seeds, more = rarest[:, : n - least + 1], rarest[:, : n - least + 2]
        for place in np.unique(seeds).tolist():
            if df[place - places.start]:
                yield place, sorted({*more[(seeds == place).any(axis=1)].ravel().tolist()} - {place})


def _pack(x: np.ndarray, kind: type) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


INDEX = "docs binary, starts binary, terms binary, cuts binary, postings binary"
_KINDS = (np.int64, np.int64, np.uint64, np.int64, np.int32)


def positional_index(docs: DataFrame, cfg: LeakConfig = LeakConfig(), id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The stored index of all words: one row per block of documents. With a ``path`` it is written there, to be read again.

    ``docs`` the ids of the block's documents and ``starts`` their first word's number within the block; ``terms`` the
    hashes of its words, ascending, ``cuts`` the bounds of their lists, ``postings`` word numbers within the block, ascending.
    """
    rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).where("id is not null and text is not null")

    def block(ids: list[np.ndarray], words: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        doc, w, n = np.concatenate(ids), np.concatenate(words), np.concatenate(sizes)
        o = np.argsort(w, kind="stable")
        terms, cut = np.unique(w[o], return_index=True)
        columns = (doc, np.r_[0, np.cumsum(n)], terms, np.r_[cut, len(w)], o)
        return pa.RecordBatch.from_arrays([pa.array([_pack(x, k)], pa.binary()) for x, k in zip(columns, _KINDS)], names=["docs", "starts", "terms", "cuts", "postings"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, sizes, held = [], [], [], 0
        for b in batches:
            for part in bounded(b, 1, 2_000_000):
                w, n = word_hashes(part.column(1).to_pylist())
                ids.append(part.column(0).to_numpy())
                words.append(w)
                sizes.append(n)
                held += len(w)
                if held >= cfg.block_words:
                    yield block(ids, words, sizes)
                    ids, words, sizes, held = [], [], [], 0
        if ids:
            yield block(ids, words, sizes)

    index = rows.mapInArrow(build, INDEX)
    if path is None:
        return materialize(index, "positional_index")
    index.write.parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


def _slots(terms: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted word is in the ascending terms of a block; -1 for none."""
    if not len(terms):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    return np.where(terms[at] == wanted, at, -1)


def term_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Postings of each word of a vocabulary in the whole index."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for b in batches:
            for terms, cuts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = _slots(np.frombuffer(terms, np.uint64), shared.value)
                found = np.flatnonzero(at >= 0)
                total[found] += np.diff(np.frombuffer(cuts, np.int64))[at[found]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    found = index.select("terms", "cuts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary), np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


def _holds(sorted_list: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether the list has a number from each low to its high."""
    if not len(sorted_list):
        return np.zeros(len(low), bool)
    at = np.searchsorted(sorted_list, low)
    return (at < len(sorted_list)) & (sorted_list[np.minimum(at, len(sorted_list) - 1)] <= high)


class _Block:
    """One index block, seen from the places of the test items."""

    def __init__(self, items: TestItems, row: tuple[bytes, ...]) -> None:
        self.docs, self.starts, terms, self.cuts, self.postings = (np.frombuffer(x, k) for x, k in zip(row, _KINDS))
        self.slot = _slots(terms, items.vocabulary)[np.searchsorted(items.vocabulary, items.words)]  # of each place
        # all lists as one ascending list of (word, position)
        self.keys = (np.repeat(np.arange(len(terms)), np.diff(self.cuts)) << 32) | self.postings

    def listed(self, place: int) -> np.ndarray:
        s = self.slot[place]
        return self.postings[self.cuts[s] : self.cuts[s + 1]] if s >= 0 else self.postings[:0]

    def has(self, place: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the word of each place stands at each position: a look into its list, moved by the place."""
        slot = self.slot[place]
        key = (slot << 32) | at
        i = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return (slot >= 0) & (at >= 0) & (self.keys[i] == key) if len(self.keys) else np.zeros(len(place), bool)

    def runs(self, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
        """(seed, position, words before it, words behind it) of the occurrences of seeds within a run of at least ``words``
        agreeing words; ``lo`` and ``hi`` bound the places of the seeds' items."""
        slot = self.slot[place]
        n = np.where(slot >= 0, np.diff(np.r_[self.cuts, self.cuts[-1:]])[slot], 0)
        seed = np.repeat(np.arange(len(place)), n)
        at = self.postings[np.repeat(self.cuts[slot], n) + np.arange(len(seed)) - np.repeat(np.r_[0, np.cumsum(n)][:-1], n)].astype(np.int64)
        doc = np.searchsorted(self.starts, at, side="right") - 1
        first, end = self.starts[doc], self.starts[doc + 1]
        reach = []
        for step in (-1, 1):
            far = np.zeros(len(seed), np.int64)
            alive = np.arange(len(seed))
            for k in range(1, words):
                p, x = place[seed[alive]] + step * k, at[alive] + step * k
                inside = (p >= lo[seed[alive]]) & (p < hi[seed[alive]]) & (x >= first[alive]) & (x < end[alive])
                alive, p, x = alive[inside], p[inside], x[inside]
                alive = alive[self.has(p, x)]
                if not len(alive):
                    break
                far[alive] = k
            reach.append(far)
        ok = reach[0] + reach[1] + 1 >= words
        return seed[ok], at[ok], reach[0][ok], reach[1][ok]

    def agree(self, places: range, place: int, at: np.ndarray, doc: np.ndarray, slop: int) -> np.ndarray:
        """[at, places] whether each place's word lies within ``slop`` words of its place in the same document, if ``place`` is at ``at``."""
        first, last = self.starts[doc], self.starts[doc + 1] - 1
        return np.stack([_holds(self.listed(p), np.maximum(at + (p - place - slop), first), np.minimum(at + (p - place + slop), last)) for p in places], axis=1)


def passages(items: TestItems, count: np.ndarray, seed_place: np.ndarray, seed_item: np.ndarray, row: tuple[bytes, ...], cfg: LeakConfig) -> list[tuple[int, int, int, int, int, str]]:
    """(document, item, word in document, word in item, length, kind) of the passages in one index block."""
    block = _Block(items, row)
    docs, starts = block.docs, block.starts
    first = np.r_[0, np.cumsum(items.sizes)]
    runs: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # (document, item, alignment) -> runs of item words
    there = block.slot[seed_place] >= 0
    seed_place, seed_item = seed_place[there], seed_item[there]
    total = np.r_[0, np.cumsum(np.diff(block.cuts)[block.slot[seed_place]])]
    begin = 0
    while begin < len(seed_place):  # so many seeds that their lists stay within bounds
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + cfg.look_rows, side="right")) - 1)
        place, item = seed_place[begin:end], seed_item[begin:end]
        seed, at, left, right = block.runs(place, first[item], first[item + 1], cfg.words)
        doc = np.searchsorted(starts, at, side="right") - 1
        own = place[seed] - first[item[seed]]
        for d, i, shift, x, y in zip(docs[doc].tolist(), item[seed].tolist(), (at - starts[doc] - own).tolist(), (own - left).tolist(), (own + right + 1).tolist()):
            runs.setdefault((d, i, shift), []).append((x, y))
        begin = end
    out = []
    for (d, item, shift), found in runs.items():  # runs seen from several seeds are parts of one passage
        found.sort()
        begin, end = found[0]
        for x, y in [*found[1:], (1 << 60, 0)]:
            if x <= end:
                end = max(end, y)
                continue
            out.append((d, int(items.ids[item]), begin + shift, begin, end - begin, "exact"))
            begin, end = x, y
    if cfg.slop:
        exact: dict[int, set[int]] = {}
        for d, item, _ in runs:
            exact.setdefault(item, set()).add(d)
        for item in range(len(items.sizes)):
            found = _loose(items, count, item, block, np.array(sorted(exact.get(item, ())), np.int64), cfg)
            out += [(d, int(items.ids[item]), dw, iw, n, "near") for d, (n, dw, iw) in found.items()]
    return out


def _loose(items: TestItems, count: np.ndarray, item: int, block: _Block, without: np.ndarray, cfg: LeakConfig) -> dict[int, tuple[int, int, int]]:
    """Document -> (agreeing words, first of them in the document, in the item) of the item's best proximity match there.

    A seed may itself lie up to ``slop`` words off, so every alignment that far from it is tried; from the seed, the other
    words of such an alignment are at most twice as far off, which sorts out most of its postings at once.
    """
    lo, hi = int(items.sizes[:item].sum()), int(items.sizes[: item + 1].sum())
    best: dict[int, tuple[int, int, int]] = {}
    if cfg.least > cfg.words:
        return best
    for begin in range(lo, hi - cfg.words + 1, 64):  # so many windows at a time, however long the item
        places = range(begin, min(begin + 63 + cfg.words, hi))
        at = [np.zeros(0, np.int64)]  # of the first place
        doc = [np.zeros(0, np.int64)]
        for seed, others in items.loose_seeds(places, cfg.words, cfg.least, count):
            own = block.listed(seed).astype(np.int64)
            if len(own) and cfg.least > 1:
                company = np.sort(np.concatenate([block.listed(p).astype(np.int64) - (p - seed) for p in others]))
                own = own[_holds(company, own - 2 * cfg.slop, own + 2 * cfg.slop)]
            if len(own):
                at.append(own - (seed - begin))
                doc.append(np.searchsorted(block.starts, own, side="right") - 1)
        at, doc = _distinct(np.concatenate(at), np.concatenate(doc))
        ok = ~np.isin(block.docs[doc], without)
        at, doc = at[ok], doc[ok]
        for k in range(0, len(at), 50_000):
            _best_of(best, places, block, at[k : k + 50_000], doc[k : k + 50_000], cfg, lo)
    return best


def _distinct(at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((at, doc))
    at, doc = at[order], doc[order]
    new = np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])][: len(at)]
    return at[new], doc[new]


def _best_of(best: dict[int, tuple[int, int, int]], places: range, block: _Block, at: np.ndarray, doc: np.ndarray, cfg: LeakConfig, lo: int) -> None:
    """Enters the proximity matches at alignments up to ``slop`` off ``at`` in ``best``; equally good ones go to the first word."""

    def matched(slop: int) -> tuple[np.ndarray, np.ndarray]:
        agree = block.agree(places, places.start, at, doc, slop)
        total = np.concatenate([np.zeros((len(at), 1), np.int32), np.cumsum(agree, axis=1, dtype=np.int32)], axis=1)
        return agree, total[:, cfg.words :] - total[:, : -cfg.words]

    ok = (matched(2 * cfg.slop)[1] >= cfg.least).any(axis=1)
    shifts = np.arange(-cfg.slop, cfg.slop + 1)
    at, doc = _distinct((at[ok][:, None] + shifts).ravel(), np.repeat(doc[ok], len(shifts)))
    if not len(at):
        return
    agree, n = matched(cfg.slop)
    row, begin = np.nonzero(n >= cfg.least)
    n, at, doc = n[row, begin], at[row], doc[row]
    head = begin + np.lib.stride_tricks.sliding_window_view(agree, cfg.words, axis=1)[row, begin].argmax(axis=1)
    word = np.zeros(len(row), np.int64)
    for h in np.unique(head).tolist():
        own = np.flatnonzero(head == h)
        held, first = block.listed(places[h]), block.starts[doc[own]]
        word[own] = held[np.searchsorted(held, np.maximum(at[own] + (h - cfg.slop), first))] - first
    ids, head = block.docs[doc], head + (places.start - lo)
    order = np.lexsort((head, word, -n, ids))
    order = order[np.r_[True, ids[order][1:] != ids[order][:-1]][: len(order)]]
    for d, *now in zip(ids[order].tolist(), n[order].tolist(), word[order].tolist(), head[order].tolist()):
        best[d] = min(best.get(d, tuple(now)), tuple(now), key=lambda x: (-x[0], x[1], x[2]))


def leaked_passages(docs: DataFrame, tests: DataFrame, cfg: LeakConfig = LeakConfig(), doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words, kind) of the passages of test items in documents.

    ``kind`` is ``exact`` for a longest run of at least ``words`` consecutive words of the item, ``near`` for the best
    proximity match (with ``slop``) of an item in a document without an exact one: an alignment at which at least
    ``near_share`` of ``words`` consecutive words of the item have an equal word of the document within ``slop`` words of
    their places. ``n_words`` counts the agreeing words; the first of them is ``item_word``, in the document ``doc_word``.
    Words are runs of letters and digits in lower case. Null ids and texts, and items of fewer than ``words`` words, give
    no rows; repeated documents are reported with the same ids once. Test items are held against the stored index in
    blocks of ``query_words`` words; documents never leave their block, so a word in every document costs no shuffle.
    ``index`` is an index of ``docs`` made before (``positional_index``); without one it is made, once for all blocks.
    """
    spark = docs.sparkSession
    test = tests.select(F.col(item_id).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    schema = "doc_id long, item_id long, doc_word long, item_word long, n_words long, kind string"
    result = spark.createDataFrame([], schema)
    for items in _item_blocks(test, cfg.query_words):
        index = positional_index(docs, cfg, doc_id, text_col) if index is None else index
        count = term_counts(index, items.vocabulary)
        shared = spark.sparkContext.broadcast((items, count, *items.seeds(cfg.words, count)))

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                    found = passages(*shared.value, row, cfg)
                    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string() if i == 5 else pa.int64()) for i in range(6)], names=["doc_id", "item_id", "doc_word", "item_word", "n_words", "kind"])

        result = result.unionByName(index.mapInArrow(look, schema))
    return result.distinct()


def _item_blocks(test: DataFrame, limit: int) -> Iterator[TestItems]:
    """Test items in the order of their ids, read to the driver a bounded block of words at a time."""
    ids, texts, held = [], [], 0
    for r in test.orderBy("id").toLocalIterator():
        ids.append(r["id"])
        texts.append(r["text"])
        held += len(r["text"]) // 2 + 1
        if held >= limit:
            yield TestItems(ids, texts)
            ids, texts, held = [], [], 0
    if ids:
        yield TestItems(ids, texts)


def contaminated_documents(docs: DataFrame, tests: DataFrame, cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """(doc_id, item_id) of documents that hold an exact passage of an item."""
    return leaked_passages(docs, tests, cfg).where("kind = 'exact'").select("doc_id", "item_id").distinct()
