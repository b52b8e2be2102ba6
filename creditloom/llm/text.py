"""Words and windows of many texts at once, as numpy arrays over Arrow buffers.

A batch of texts is cut into slices of a bounded number of bytes; within a slice
words are found by byte class, so every word pattern must be a class of ASCII
bytes plus all bytes from 0x80 (true for the patterns used here). Words get a
64-bit polynomial hash from one running sum over the bytes, windows of words one
from a running sum over the word hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


def _bytes_except(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low:high + 1] = False
    return table


#: Bytes of the words [^\x20\x09-\x0D]+.
SPACED = _bytes_except((0x20, 0x20), (0x09, 0x0D))
#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a lower-cased text.
PLAIN = _bytes_except((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Lower-cases A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __reduce__(self):
        return _Powers, (self.base,)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            grown = []
            for factor in (self.base, self.inverse):
                steps = np.full(size, factor, dtype=np.uint64)
                steps[0] = 1
                grown.append(np.multiply.accumulate(steps))
            self.up, self.down = grown
        return self.up[:n], self.down[:n]


_OF_BYTES, _OF_WORDS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the splitmix64 finalizer); returns a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Slice(NamedTuple):
    """Texts ``low:high`` of a column: their bytes and the bounds of each text in them."""

    low: int
    high: int
    data: np.ndarray
    bounds: np.ndarray


def slices(column: pa.Array, budget: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a column of texts into runs of rows of about ``budget`` bytes; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    starts = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + n + 1]
    starts = starts.astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + budget, "right")) - 1)
        high = min(high, n)
        yield Slice(low, high, data[starts[low]:starts[high]], starts[low:high + 1] - starts[low])
        low = high


class Words(NamedTuple):
    """Words of a slice: byte spans, hashes, and for each text the index of its first word.

    ``first`` has one entry more than there are texts.
    """

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        """Text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> Words:
    """Find and hash the words of the texts in ``data``; ``kind`` says which bytes belong to words."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, np.zeros(len(bounds), dtype=np.int64), np.zeros(0, dtype=np.uint64))
    inside = kind[data]
    edge = np.empty(n, dtype=bool)
    edge[0], edge[1:] = True, ~inside[:-1]
    edge[bounds[:-1][bounds[:-1] < n]] = True
    start = np.flatnonzero(inside & edge)
    edge[-1], edge[:-1] = True, ~inside[1:]
    edge[bounds[1:][bounds[1:] > 0] - 1] = True
    end = np.flatnonzero(inside & edge) + 1
    up, down = _OF_BYTES.get(n)
    run = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=run[1:])
    hashed = mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(start, end, np.searchsorted(start, bounds).astype(np.int64), hashed)


def windows(found: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (as word index) and hash of every window of ``length`` words within one text."""
    n = len(found.hash)
    if n < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    up, down = _OF_WORDS.get(n)
    run = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(found.hash * up, out=run[1:])
    last = np.repeat(found.first[1:], found.counts)[:n - length + 1] - length
    start = np.flatnonzero(np.arange(n - length + 1) <= last)
    return start, mix((run[start + length] - run[start]) * down[start] + np.uint64(length))


def shingles(found: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every shingle; a text of fewer words has one shingle, its whole sequence."""
    row = found.row
    starts, hashes = windows(found, length)
    rows, parts = [row[starts]], [hashes]
    for shorter in range(1, length):
        starts, hashes = windows(found, shorter)
        whole = found.counts[row[starts]] == shorter
        rows.append(row[starts][whole])
        parts.append(hashes[whole])
    rows, parts = np.concatenate(rows), np.concatenate(parts)
    order = np.argsort(rows, kind="stable")
    return rows[order], parts[order]


def distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once per text, ordered by text and hash."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


#: Bytes of an Arrow batch sent to a Python worker, unless the session asks for less.
BATCH_BYTES = 8 << 20


def map_batches(frame, function, schema):
    """``frame.mapInArrow`` with batches bounded in bytes, so that long texts don't fill a worker.

    The bound is a session setting; a smaller one that is already there is kept.
    """
    conf, key = frame.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)i?b?", str(conf.get(key)).strip().lower()).groups()
    current = int(number) << 10 * " kmgt".index(unit or " ")
    if current <= 0 or current > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return frame.mapInArrow(function, schema)
