"""Words of whole Arrow text columns as NumPy arrays: spans, 64-bit word hashes, shingle sets.

All functions work on the UTF-8 bytes of a batch at once. Only ASCII letters are lowered, so a byte table is enough
to tell words from separators and multi-byte characters always stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 19
ROWS_PER_BATCH = 1_000

_RANDOM = np.random.Generator(np.random.PCG64(20240601))
_BYTE_VALUE = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACE = _RANDOM.integers(1, 2**64, 8, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes outside x20 and x09-x0D.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False

#: Digits, lower-case ASCII letters and everything beyond ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_batches(docs: DataFrame) -> DataFrame:
    """`docs`, after making Arrow batches of the session small enough for rows that are whole texts.

    A batch is what JVM and Python both hold at once. A number that the session has set itself stays.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name)) == 10_000:
        conf.set(name, ROWS_PER_BATCH)
    return docs


class Words:
    """Words of some texts. Row r has words `first[r]` to `first[r + 1]`; word w is `data[start[w]:end[w]]`."""

    def __init__(self, data: np.ndarray, row_offsets: np.ndarray, is_word: np.ndarray):
        self.raw, self.row_offsets = data, row_offsets
        self.data = LOWER[data]
        n = len(data)
        inside = is_word[self.data]
        begins_row = np.zeros(n + 1, bool)
        begins_row[row_offsets] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | begins_row[1:n]
        finish = inside.copy()
        finish[:-1] &= ~inside[1:] | begins_row[1:n]
        self.inside = inside
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.start, row_offsets)
        self.rows = len(row_offsets) - 1

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word, the same in every batch."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = _powers.upto(len(self.data))
        value = _BYTE_VALUE[self.data] * up
        value[~self.inside] = 0
        return mix(np.add.reduceat(value, self.start) * down[self.start])

    def text(self, first: int, count: int) -> bytes:
        """`count` words from `first`, one blank between."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(
            self.start[first:first + count], self.end[first:first + count]))


class _Powers:
    """Powers of the hash base and of its inverse, kept for the longest batch so far; never sent to tasks."""

    def __init__(self):
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __reduce__(self):
        return _Powers, ()

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            for i, base in enumerate((_BASE, _INVERSE)):
                table = np.full(max(n, SLICE_BYTES), base, np.uint64)
                table[0] = 1
                self.tables[i] = np.multiply.accumulate(table)
        return [t[:n] for t in self.tables]


_powers = _Powers()


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slices(column: pa.Array, is_word: np.ndarray) -> Iterator[tuple[int, Words]]:
    """The words of a column, some rows at a time: a single row, or rows of SLICE_BYTES together."""
    data, offsets = utf8(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        stop = min(stop, len(column))
        yield row, Words(data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row], is_word)
        row = stop


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """For every row its distinct shingle hashes, ascending. Fewer words than `size` are one shingle; none is empty."""
    word = words.hashes()
    count = max(0, len(word) - size + 1)
    full = np.zeros(count, np.uint64)
    for i in range(size):
        full += word[i:i + count] * _PLACE[i]
    full = mix(full)
    for r in range(words.rows):
        a, b = words.first[r], words.first[r + 1]
        if b - a >= size:
            yield np.unique(full[a:b - size + 1])
        elif b > a:
            short = np.sum(word[a:b] * _PLACE[:b - a], keepdims=True) + np.uint64(b - a)
            yield mix(short * _PLACE[7])
        else:
            yield np.zeros(0, np.uint64)
