"""Repetition inside a document: line-first cleaning, then rejection of documents that lose too much text.

Each line is judged by rules: punctuation, navigation (links and trails), boilerplate (lines that recur over the documents of
the collection) and repetition (words that repeat what the document already said). Failing lines are removed. What a
document loses are the words of its failing lines and the repeated words of the others; if that is too large a part of
its words, it is rejected, and an exact count of its repeated words says whether repetition alone was enough. The loss is
never less than the repeated words, so the rejected documents hold all repetitive ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranksight.llm.shingles import bounded, mix, run_hashes, word_hashes
from ranksight.runtime import spread


@dataclass(frozen=True)
class CleaningRules:
    """``run``: words of a repeated run. A line fails from ``line_share`` repeated words on, a document from ``reject_share`` lost words.

    Punctuation: more than ``symbol_share`` of a line's characters. Navigation: links make up ``link_share`` of them, or at
    least ``trail`` of one of the ``separators`` cut the line into parts of at most ``trail_part`` characters (table rows,
    which begin with one, are none). Boilerplate: a line of at least ``boilerplate_words`` words that stands, up to
    letter case and punctuation, in at least ``boilerplate_share`` of all documents and in ``boilerplate_least`` of them.
    """

    run: int = 5
    line_share: float = 0.5
    reject_share: float = 0.30
    symbol_share: float = 0.5
    link_share: float = 0.5
    separators: str = "|›»→"
    trail: int = 3
    trail_part: int = 30
    boilerplate_words: int = 3
    boilerplate_share: float = 0.001
    boilerplate_least: int = 5


#: Names of the line rules, in the order of the bits in ``line_flags``.
RULES = ("punctuation", "navigation", "boilerplate", "repetition")

_SPLIT = re.compile(r"\r\n|\r|\n")
_LINK = re.compile(r"\[[^\]\n]*\]\([^)\s]*\)|\[\[[^\]\n]*\]\]|\bhttps?://\S+")
#: Signs without which a line has no link.
_LINK_SIGNS = ("](", "[[", "://")


def _lines_of(texts: list[str | None]) -> tuple[list[list[str]], list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines by text, all lines, lines of each text, the text of each line, the words of all lines and how many each has."""
    lines = [_SPLIT.split(t) if t else [] for t in texts]
    flat = [x for ls in lines for x in ls]
    per_text = np.array([len(ls) for ls in lines], np.int64)
    owner = np.repeat(np.arange(len(texts)), per_text)
    return lines, flat, per_text, owner, *word_hashes(flat)


def _line_keys(words: np.ndarray, per_line: np.ndarray) -> np.ndarray:
    """A 64-bit key of the words of each line, in order; 0 for a line without words."""
    out = np.zeros(len(per_line), np.uint64)
    filled = np.flatnonzero(per_line)
    if len(filled):
        first = np.r_[0, np.cumsum(per_line)][:-1]
        place = np.arange(len(words)) - np.repeat(first, per_line)
        out[filled] = np.add.reduceat(mix(words + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first[filled])
    return out


def recurring_lines(rows: DataFrame, rules: CleaningRules) -> np.ndarray:
    """Sorted keys of the boilerplate lines of a collection (id, text).

    Every line is counted, once for a document. At most (lines per document) / ``boilerplate_share`` keys can reach that
    share, whatever the number of documents, so they fit the driver and a broadcast; below the share's reach,
    ``boilerplate_least`` keeps them under a fifth of the lines of a few thousand documents.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in bounded(b, 1, 2_000_000):
                _, _, _, owner, words, per_line = _lines_of(part.column(1).to_pylist())
                long = per_line >= rules.boilerplate_words
                key, doc = _line_keys(words, per_line)[long], owner[long]
                o = np.lexsort((key, doc))
                key, doc = key[o], doc[o]
                new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])][: len(key)]
                keys, n = np.unique(key[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["line", "n"])

    least = max(rules.boilerplate_least, int(np.ceil(rules.boilerplate_share * rows.count())))
    found = rows.mapInArrow(count, "line long, n long").groupBy("line").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("line").toArrow()
    return np.sort(found.column("line").to_numpy().view(np.uint64))


def judge(texts: list[str | None], rules: CleaningRules, boilerplate: np.ndarray) -> dict[str, np.ndarray | list]:
    """Columns of the result for a list of texts; see ``clean_documents``."""
    lines, flat, per_text, owner, words, per_line = _lines_of(texts)
    per_doc = np.bincount(owner, weights=per_line, minlength=len(texts)).astype(np.int64)
    h, doc, place = run_hashes(words, per_doc, rules.run)
    again = np.zeros(len(h), bool)
    if len(h):  # in (text, run, place) order every run but the first of its kind is a repetition
        o = np.lexsort((place, h, doc))
        again[o[1:]] = (h[o][1:] == h[o][:-1]) & (doc[o][1:] == doc[o][:-1])
    first_word = np.r_[0, np.cumsum(per_doc)]
    mark = np.zeros(len(words) + 1, np.int64)
    at = first_word[doc[again]] + place[again]
    np.add.at(mark, at, 1)
    np.add.at(mark, at + rules.run, -1)
    repeated = np.cumsum(mark[:-1]) > 0
    line_of = np.repeat(np.arange(len(flat)), per_line)
    rep_line = np.bincount(line_of, weights=repeated, minlength=len(flat)).astype(np.int64)
    rep_doc = np.bincount(owner, weights=rep_line, minlength=len(texts)).astype(np.int64)
    size = np.fromiter((len(x) - x.count(" ") for x in flat), np.int64, len(flat))
    symbols = np.fromiter((_symbols(x) for x in flat), np.int64, len(flat))
    fails = np.zeros((len(flat), len(RULES)), bool)
    fails[:, 0] = (size > 0) & ((per_line == 0) | (symbols > rules.symbol_share * size))
    start = np.r_[0, np.cumsum(per_text)]
    for i, t in enumerate(texts):
        if t and any(c in t for c in (*rules.separators, *_LINK_SIGNS)):
            for j in range(start[i], start[i + 1]):
                fails[j, 1] = _is_navigation(flat[j], size[j], rules)
    if len(boilerplate):
        key = _line_keys(words, per_line)
        fails[:, 2] = (per_line >= rules.boilerplate_words) & (boilerplate[np.minimum(np.searchsorted(boilerplate, key), len(boilerplate) - 1)] == key)
    fails[:, 3] = (per_line > 0) & (rep_line >= rules.line_share * per_line)
    gone = fails.any(axis=1)
    by_doc = lambda x: np.bincount(owner, weights=x, minlength=len(texts)).astype(np.int64)
    lost = by_doc(np.where(gone, per_line, rep_line))
    rejected = (per_doc > 0) & (lost >= rules.reject_share * per_doc)
    # of the rejected documents: is the repeated text alone enough?
    looped = rejected & (rep_doc >= rules.reject_share * per_doc)
    share = np.where(per_doc > 0, rep_doc / np.maximum(per_doc, 1), 0.0)
    clean = [None if t is None else "\n".join(x for x, g in zip(ls, gone[start[i] : start[i + 1]]) if not g) for i, (t, ls) in enumerate(zip(texts, lines))]
    return {
        "n_words": per_doc, "repeated_words": rep_doc, "repeated_share": share, "n_lines": per_text, **{f"{r}_lines": by_doc(fails[:, k]) for k, r in enumerate(RULES)},
        "lost_words": lost, "kept_words": by_doc(np.where(gone, 0, per_line)), "verdict": np.where(looped, "repetition", np.where(rejected, "lines", "keep")).tolist(), "clean_text": clean,
    }


def _is_navigation(line: str, size: int, rules: CleaningRules) -> bool:
    if any(s in line for s in _LINK_SIGNS):
        linked = sum(len(m) - m.count(" ") for m in _LINK.findall(line))
        if linked and linked >= rules.link_share * size:
            return True
    return _is_trail(line, rules)


def _is_trail(line: str, rules: CleaningRules) -> bool:
    bare = line.strip()
    for c in rules.separators:
        if bare.count(c) >= rules.trail and not bare.startswith(c):
            return all(len(x.strip()) <= rules.trail_part for x in bare.split(c))
    return False


_SYMBOL = re.compile(r"[^\w\s]|_")


def _symbols(line: str) -> int:
    return len(_SYMBOL.findall(line))


def clean_documents(docs: DataFrame, rules: CleaningRules = CleaningRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the share of repeated words, failed lines by rule, and the cleaned text.

    A word is repeated if it lies in a run of ``run`` consecutive words that already occurred in the same text, starting
    at an earlier word; the first occurrence is not repeated. ``lost_words`` are the words of the removed lines and the
    repeated words of the lines that stay. A document that loses at least ``reject_share`` of its words is rejected: its
    ``verdict`` is ``repetition`` if its repeated words are as many, else ``lines``; all others ``keep``.
    Null and empty texts, and texts without words, have share 0 and are kept; a null text stays null. Repeated rows come
    out as often as they go in; an empty table gives no rows. Whole texts are judged, however long.
    """
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{r}_lines long" for r in RULES)
    shared = docs.sparkSession.sparkContext.broadcast(recurring_lines(rows, rules))  # bounded, see there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in bounded(b, 1, 2_000_000):
                got = judge(part.column(1).to_pylist(), rules, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(v, pa.string()) if k in ("clean_text", "verdict") else pa.array(v) for k, v in got.items()]], names=["doc_id", *got]
                )

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, repeated_words long, repeated_share double, n_lines long, {counts}, lost_words long, kept_words long, verdict string, clean_text string")
