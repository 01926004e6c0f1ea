"""Words and word-run hashes of many texts at once, shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

def bounded(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes in a string or binary column, at least one row each."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    total = np.r_[0, np.cumsum(size)]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


WORD = re.compile(r"[^\W_]+")
_CACHE_LIMIT = 1_000_000


class _Hashes(dict):
    """word -> 64-bit hash, filled on demand; emptied when it grows past its limit, so its memory is bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE_LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()


def words_of(text: str | None) -> list[str]:
    """Longest runs of letters and digits, in lower case; none for null."""
    return WORD.findall(text.lower()) if text else []


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in a row, and the number of words of each text."""
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = words_of(t)
        sizes[i] = len(w)
        parts.append(np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), sizes


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(words: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, start word in the text) of every run of n consecutive words within one text."""
    total = len(words)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    first = np.r_[0, np.cumsum(sizes)][:-1]
    place = np.arange(total) - first[text]
    h = np.zeros(total - n + 1, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : total - n + 1 + k])
    inside = text[: total - n + 1] == text[n - 1 :]
    return h[inside], text[: total - n + 1][inside], place[: total - n + 1][inside]
