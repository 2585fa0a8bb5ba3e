"""Shared pieces of the corpus operators: table access, checkpoints, words.

A word is a run of bytes outside ``20 09-0D`` (the six ASCII white-space
bytes), which is also what ``bytes.split()`` splits on.  The word tools below
work on the raw Arrow buffers of a whole slice of texts at once, so no Python
loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import cut, spread  # noqa: F401  (the operators take cut from here)

#: Java/RE2 pattern of one word.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that the word tools hold at a time.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def coefficients(n: int, seed: int) -> np.ndarray:
    """The first n of an endless fixed series of odd 64-bit numbers."""
    i = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed)
    return mix64(i) | np.uint64(1)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer row stands alone, whole."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


class Words:
    """The words of some rows: byte range, row and two 64-bit hashes of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: int = 1):
        base = offsets[0]
        data, offsets = data[base : offsets[-1]], offsets - base
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        #: Index of each row's first word; one more entry at the end.
        self.begin = np.searchsorted(self.start, offsets)
        at = np.flatnonzero(inside)
        size = self.end - self.start
        cuts = np.cumsum(size) - size
        place = np.arange(len(at)) - np.repeat(cuts, size)
        value = data[at].astype(np.uint64) + np.uint64(1)
        self.hash = []
        for lane in range(hashes):
            c = coefficients(int(size.max()) if len(size) else 0, 1 + lane)
            sums = np.add.reduceat(c[place] * value, cuts) if len(at) else np.zeros(0, dtype=np.uint64)
            self.hash.append(mix64(sums + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))

    def __len__(self) -> int:
        return len(self.start)


def run_hash(words: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hash of the ``length`` consecutive words that start at each index of ``at``."""
    c = coefficients(length, seed)
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(length):
        out += c[k] * words[at + k]
    return mix64(out)
