"""Cutting oversized texts at natural boundaries, all cuts of all texts in parallel by pointer doubling.

Every boundary of a text is a possible start of a piece. ``succ`` sends it to the start of the next piece: the farthest
legal end of a piece from here, moved back by the overlap. The greedy cuts of a text are the path of ``succ`` from its
first boundary; squaring the table (succ, succ², succ⁴, ...) yields that path in a logarithmic number of array steps,
for all texts of a batch at once and with no loop over pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranksight.llm.shingles import bounded


@dataclass(frozen=True)
class SplitConfig:
    """``fill``: an end of a stronger kind is preferred if the piece is at least this part of ``limit`` long."""

    limit: int = 1_500
    overlap: int = 200
    fill: float = 0.4


#: Kinds of boundary from weak to strong.
HARD, WORD, SENTENCE, LINE, BLOCK, HEADING = range(6)

_LINE = re.compile(r"\r\n|\r|\n")
_FENCE = re.compile(r"[ \t]*(?:```|~~~)")
_HEAD = re.compile(r"#{1,6}\s")
_SENTENCE = re.compile(r"[.!?…](?=\s)\s+")
_WORD = re.compile(r"\s+")


def boundaries(text: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a piece may start or end, ascending, with their kinds; the first is 0, the last the length.

    Inside a fenced code block only line ends, word ends and hard cuts are boundaries. Where no boundary lies within
    ``limit // 4`` characters, hard cuts are added, so a piece can always be ended.
    """
    kind: dict[int, int] = {0: HEADING, len(text): HEADING}
    for m in _WORD.finditer(text):
        kind.setdefault(m.end(), WORD)
    for m in _SENTENCE.finditer(text):
        if kind.get(m.end(), 0) < SENTENCE:
            kind[m.end()] = SENTENCE
    at, fence, blank = 0, None, False
    for m in [*_LINE.finditer(text), None]:
        end = m.start() if m else len(text)
        line = text[at:end]
        mark = _FENCE.match(line)
        inside = fence is not None
        if at:
            k = LINE
            if not inside:
                k = HEADING if _HEAD.match(line) else BLOCK if blank or mark else LINE
            elif kind.get(at, 0) < LINE:
                k = LINE
            kind[at] = k
        if mark:
            tick = line.strip()[:3]
            if fence is None:
                fence = tick
            elif tick == fence:
                fence = None
        if inside:  # sentence ends mean nothing in code
            for p in [p for p in range(at + 1, end) if kind.get(p) == SENTENCE]:
                kind[p] = WORD
        blank = not line.strip()
        at = m.end() if m else at
    pos = np.fromiter(kind.keys(), np.int64, len(kind))
    o = np.argsort(pos)
    pos, strength = pos[o], np.fromiter(kind.values(), np.int64, len(kind))[o]
    step = max(1, limit // 4)
    wide = np.flatnonzero(np.diff(pos) > step)
    if len(wide):
        extra = np.concatenate([np.arange(pos[i] + step, pos[i + 1], step) for i in wide])
        pos, strength = np.r_[pos, extra], np.r_[strength, np.zeros(len(extra), np.int64)]
        o = np.argsort(pos, kind="stable")
        pos, strength = pos[o], strength[o]
    return pos, strength


def successors(pos: np.ndarray, kind: np.ndarray, text: np.ndarray, cfg: SplitConfig) -> tuple[np.ndarray, np.ndarray]:
    """(end, next) of a piece that starts at each boundary, as indices into the boundaries of all texts in a row.

    ``end`` is the farthest boundary of the strongest kind within the limit; ``next`` the strongest, then earliest
    boundary that shares at most ``overlap`` characters with it, lies behind the start and reaches beyond ``end``; without
    one it is ``end``. A start whose end is the end of its text is its own successor.
    """
    n = len(pos)
    base = np.r_[0, np.cumsum(np.bincount(text))] if n else np.zeros(1, np.int64)
    span = int(pos.max()) + cfg.limit + 2 if n else 1
    place = text * span + pos  # ascending over all texts
    last = base[text + 1] - 1
    idx = np.arange(n)
    far = np.minimum(np.searchsorted(place, place + cfg.limit, side="right") - 1, last)
    end, settled = far.copy(), far == last
    least = np.searchsorted(place, place + int(cfg.limit * cfg.fill))
    for k in range(HEADING, WORD, -1):  # the nearest boundary of this kind at or before `far`
        of = np.flatnonzero(kind == k)
        if not len(of):
            continue
        at = np.searchsorted(of, far, side="right") - 1
        cand = of[np.maximum(at, 0)]
        ok = ~settled & (at >= 0) & (cand >= least) & (cand > idx)
        end[ok] = cand[ok]
        settled |= ok
    nxt, settled = end.copy(), end == last
    nxt[settled] = idx[settled]
    low = np.maximum(np.searchsorted(place, place[end] - cfg.overlap), idx + 1)
    for k in range(HEADING, HARD, -1):
        of = np.flatnonzero(kind == k)
        if not len(of):
            continue
        at = np.searchsorted(of, low)
        cand = of[np.minimum(at, len(of) - 1)]
        ok = ~settled & (at < len(of)) & (cand <= end) & (end[cand] > end)  # a piece must bring something new
        if k > SENTENCE:
            ok &= cand < end  # a start right at the end would share nothing; look for a weaker one first
        nxt[ok] = cand[ok]
        settled |= ok
    return end, nxt


def greedy_path(nxt: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(path number, boundary) of all boundaries on the paths from ``start``, in order, by squaring the table."""
    path, node, jump = np.arange(len(start)), start.copy(), nxt
    while True:
        more = jump[node]
        # nodes already reached are fixed points of the path's end
        grown = np.unique(np.stack([np.r_[path, path], np.r_[node, more]], axis=1), axis=0)
        if len(grown) == len(node):
            return grown[:, 0], grown[:, 1]
        path, node = grown[:, 0], grown[:, 1]
        jump = jump[jump]


def split_texts(texts: list[str], cfg: SplitConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end) of the pieces of texts over the limit, in order."""
    over = [i for i, t in enumerate(texts) if t is not None and len(t) > cfg.limit]
    if not over:
        none = np.zeros(0, np.int64)
        return none, none, none
    found = [boundaries(texts[i], cfg.limit) for i in over]
    size = np.array([len(p) for p, _ in found])
    pos, kind = np.concatenate([p for p, _ in found]), np.concatenate([k for _, k in found])
    end, nxt = successors(pos, kind, np.repeat(np.arange(len(over)), size), cfg)
    path, node = greedy_path(nxt, np.r_[0, np.cumsum(size)][:-1])
    return np.array(over)[path], pos[node], pos[end[node]]


def split_oversized(records: DataFrame, cfg: SplitConfig = SplitConfig(), id_col: str = "chunk_id", text_col: str = "text", heading_col: str = "heading") -> DataFrame:
    """(chunk_id, heading, part, start, text) of the pieces of every text over ``limit`` characters.

    Pieces have at most ``limit`` characters, begin at ``start`` (from 0), cover the text and follow each other with up
    to ``overlap`` shared characters; ``part`` counts from 1. Texts within the limit, null and empty texts give no rows;
    a null id or heading is passed on. A row delivered twice (same id, text and heading) is cut once.
    """
    spark_rows = records.select(F.col(id_col).alias("chunk_id"), F.col(heading_col).alias("heading"), F.col(text_col).alias("text")).where(F.length("text") > cfg.limit).dropDuplicates()
    kind = spark_rows.schema["chunk_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in bounded(b, 2, 2_000_000):
                texts = part.column(2).to_pylist()
                row, start, end = split_texts(texts, cfg)
                first = np.searchsorted(row, row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array((np.arange(len(row)) - first + 1).astype(np.int32)), pa.array(start), pa.array([texts[r][s:e] for r, s, e in zip(row, start, end)], pa.string())],
                    names=["chunk_id", "heading", "part", "start", "text"],
                )

    return spark_rows.mapInArrow(cut, f"chunk_id {kind.simpleString()}, heading string, part int, start long, text string")
