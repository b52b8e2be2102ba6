"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are the windows of ``length`` consecutive words of every
benchmark item (an item of fewer words is one window). Strings of one length form
one search: a shift table tells, for a block of two words (one for strings of one
word), how far the search may jump from a position whose last words are that
block; where the shift is zero, the block's bucket gives the test strings ending
in it, their first block is compared, and what remains is confirmed by comparing
the words themselves. All search positions of a slice of texts move together.

The benchmark never comes to the driver. Long items are cut into pieces that overlap by
a window, pieces are dealt to parts of a bounded number of bytes, and tasks build each
part's tables and write them to the shared scratch folder. The tasks that search the
documents read the tables from there by path, all at once where they fit ``HELD_BYTES``,
else one part after another for a run of documents; each document passes once and
nothing of it is shuffled. The scratch folder must be one that pyarrow can open.

Defined results: a null or wordless text has no words and no hits; an item
without words or text is never found; words inside windows of an item without an id
are hit, but there is no item to count; items of equal id count once, repeated
documents are searched alike; extra columns of either table are not read.
"""

from __future__ import annotations

import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm import text as T
from creditloom.llm.components import stored

LENGTH = 10
#: Bytes of benchmark text in one part, and words in one piece of an item.
PART_BYTES, PIECE_WORDS = 1 << 20, 20_000
#: Bytes of tables that a task holds; beyond them, bytes of documents that it gathers for each part.
HELD_BYTES, RUN_BYTES = 192 << 20, 32 << 20
#: Search positions start this many words apart.
STRIDE = 64


class Strings(NamedTuple):
    """The test strings of one length by block code, with their shift table."""

    length: int
    block: int
    mask: np.uint64
    shift: np.ndarray        # by block code
    codes: np.ndarray        # by string, sorted: code of its last block
    first_block: np.ndarray  # by string
    spelled: bytes           # words of all strings, joined by spaces, one string after another
    bounds: np.ndarray       # by string: where it starts, and one entry more
    items: list[list[str]]   # by string


class Searched(NamedTuple):
    row: np.ndarray   # of each confirmed occurrence
    start: np.ndarray  # word index in the slice
    length: int
    string: np.ndarray


def _block_code(hashes: np.ndarray, last: np.ndarray, block: int) -> np.ndarray:
    """64-bit code of the ``block`` words that end at word ``last``."""
    if block == 1:
        return hashes[last]
    return T.mix(hashes[last] + np.uint64(3) * T.mix(hashes[last - 1]))


def compile_strings(rows: list[tuple[str | None, str]], length: int = LENGTH) -> list[Strings]:
    """Searches for the windows of (item id, text) rows, one per string length."""
    by_length: dict[int, dict[bytes, set[str]]] = {}
    for item, content in rows:
        for part in T.slices(pa.array([content], pa.large_string())):
            data = T.LOWER[part.data]
            found = T.words(data, part.bounds, T.PLAIN)
            spelled = [data[s:e].tobytes() for s, e in zip(found.start, found.end)]
            size = min(length, len(spelled))
            for i in range(len(spelled) - size + 1) if size else ():
                by_length.setdefault(size, {}).setdefault(
                    b" ".join(spelled[i:i + size]), set()).update([] if item is None else [item])
    return [_tables(size, strings) for size, strings in sorted(by_length.items())]


def _tables(length: int, strings: dict[bytes, set[str]]) -> Strings:
    block = min(2, length)
    spelled = sorted(strings)
    joined = pa.array([b"\n".join(spelled)], pa.large_binary())
    part = next(T.slices(joined, 1 << 62))
    found = T.words(part.data, part.bounds, T.PLAIN)
    hashes = found.hash.reshape(len(spelled), length)
    bits = max(10, int(np.ceil(np.log2(4 * len(spelled) * (length - block + 1)))))
    mask = np.uint64((1 << bits) - 1)
    shift = np.full(1 << bits, min(length - block + 1, 127), dtype=np.int8)
    for end in range(block, length + 1):
        flat = np.ascontiguousarray(hashes[:, end - block:end]).reshape(-1)
        codes = _block_code(flat, np.arange(block - 1, len(flat), block), block) & mask
        np.minimum.at(shift, codes, np.int8(min(length - end, 127)))
    ends = np.ascontiguousarray(hashes[:, length - block:]).reshape(-1)
    codes = _block_code(ends, np.arange(block - 1, len(ends), block), block) & mask
    order = np.argsort(codes, kind="stable")
    begins = np.ascontiguousarray(hashes[:, :block]).reshape(-1)
    first_block = _block_code(begins, np.arange(block - 1, len(begins), block), block)
    texts = [spelled[i] for i in order]
    return Strings(length, block, mask, shift, codes[order], first_block[order], b"".join(texts),
                   np.cumsum([0, *map(len, texts)]), [sorted(strings[t]) for t in texts])


def search(found: T.Words, data: np.ndarray, strings: Strings) -> Searched:
    """All occurrences of the test strings in the words of a slice (``data`` is lower-cased)."""
    length, block = strings.length, strings.block
    n = len(found.hash)
    row, last_of_row = found.row, np.repeat(found.first[1:], found.counts)
    offset = np.arange(n) - np.repeat(found.first[:-1], found.counts)
    # A position is the last word of a possible occurrence; each runs up to the next one's start.
    at = np.flatnonzero((offset >= length - 1) & ((offset - (length - 1)) % STRIDE == 0))
    stop = np.minimum(at + STRIDE, last_of_row[at])
    ends, which = [], []
    while len(at):
        code = _block_code(found.hash, at, block) & strings.mask
        jump = strings.shift[code].astype(np.int64)
        zero = jump == 0
        if zero.any():
            end, code = at[zero], code[zero]
            low = np.searchsorted(strings.codes, code)
            size = np.searchsorted(strings.codes, code, "right") - low
            end = np.repeat(end, size)
            string = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
            same = _block_code(found.hash, end - length + block, block) == strings.first_block[string]
            ends.append(end[same])
            which.append(string[same])
        at = at + np.maximum(jump, 1)
        going = at < stop
        at, stop = at[going], stop[going]
    end = np.concatenate(ends) if ends else np.zeros(0, dtype=np.int64)
    string = np.concatenate(which) if which else np.zeros(0, dtype=np.int64)
    at = strings.bounds
    ok = np.fromiter((_spelled(found, data, e - length + 1, length) == strings.spelled[at[s]:at[s + 1]]
                      for e, s in zip(end.tolist(), string.tolist())), bool, len(end))
    end, string = end[ok], string[ok]
    return Searched(row[end], end - length + 1, length, string)


def _spelled(found: T.Words, data: np.ndarray, start: int, length: int) -> bytes:
    return b" ".join(data[s:e].tobytes() for s, e in
                     zip(found.start[start:start + length], found.end[start:start + length]))


def _cutter(length: int):
    """Pieces of items whose windows are those of the item."""
    def run(batches):
        for batch in batches:
            names, pieces = [], []
            for part in T.slices(batch.column("text")):
                data = T.LOWER[part.data]
                found = T.words(data, part.bounds, T.PLAIN)
                for row, name in enumerate(batch.column("item").slice(part.low, part.high - part.low).to_pylist()):
                    low, high = int(found.first[row]), int(found.first[row + 1])
                    for at in range(low, max(low + 1, high - length + 1) if high > low else low, PIECE_WORDS):
                        names.append(name)
                        pieces.append(_spelled(found, data, at, min(high - at, PIECE_WORDS + length - 1)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pieces, pa.binary())], names=["item", "piece"])
    return run


def searches(benchmark: DataFrame, length: int = LENGTH, part_bytes: int = PART_BYTES) -> list[str]:
    """Files in the shared folder that hold the tables of all parts of a benchmark."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text")).where("text IS NOT NULL")
    pieces = stored(T.map_batches(items, _cutter(length), "item string, piece binary"), "pieces")
    parts = 1 + (pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0) // part_bytes

    def build(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("item").to_pylist(), (p.decode() for p in table.column("piece").to_pylist())))
        return pa.table({"tables": pa.array([pickle.dumps([tuple(s) for s in compile_strings(rows, length)], 5)], pa.binary())})

    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("item", "piece"), F.lit(parts)))
    return stored(dealt.groupBy("part").applyInArrow(build, "tables binary"), "searches").inputFiles()


def _loaded(files: list[str]):
    """The searches of one part after the other."""
    for uri in files:
        system, path = pyarrow.fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as source:
            for batch in pyarrow.parquet.ParquetFile(source).iter_batches(batch_size=1):
                yield from ([Strings(*s) for s in pickle.loads(t.as_buffer())] for t in batch.column("tables"))


class _Parts:
    """The searches of all parts, held where they fit and read again each time where they don't."""

    def __init__(self, files: list[str]):
        self.files, held, size = files, [], 0
        for part in _loaded(files):
            held.append(part)
            size += sum(s.shift.nbytes + s.codes.nbytes + s.first_block.nbytes + len(s.spelled) + s.bounds.nbytes for s in part)
            if size > HELD_BYTES:
                held = None
                break
        self.held = held

    def runs(self, batches):
        """Batches to be searched together."""
        if self.held is not None:
            yield from ([batch] for batch in batches)
            return
        run, size = [], 0
        for batch in batches:
            run.append(batch)
            size += batch.nbytes
            if size >= RUN_BYTES:
                yield run
                run, size = [], 0
        if run:
            yield run

    def __iter__(self):
        return iter(_loaded(self.files) if self.held is None else self.held)


def _occurrences(run: list[pa.RecordBatch], parts: _Parts):
    """Slices of the batches, as (batch, slice, words), and the occurrences in each by part."""
    cut = []
    for batch in run:
        for part in T.slices(batch.column("text")):
            data = T.LOWER[part.data]
            cut.append((batch.slice(part.low, part.high - part.low), data, T.words(data, part.bounds, T.PLAIN)))
    met: list[list[tuple[Strings, Searched]]] = [[] for _ in cut]
    for searched in parts:
        for found, (_, data, words) in zip(met, cut):
            found += [(strings, search(words, data, strings)) for strings in searched]
    return zip(cut, met)


_CONTAMINATION = "doc_id long, n_words long, hits array<long>, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH,
                  part_bytes: int = PART_BYTES) -> DataFrame:
    """``doc_id``, ``n_words``, ``hits`` (positions of words inside an occurrence) and ``items``."""
    files = searches(benchmark, length, part_bytes)

    def annotate(batches):
        parts = _Parts(files)
        for run in parts.runs(batches):
            for (batch, _, words), met in _occurrences(run, parts):
                n = batch.num_rows
                hits, items = [set() for _ in range(n)], [set() for _ in range(n)]
                for strings, found in met:
                    for row, start, string in zip(found.row.tolist(), found.start.tolist(), found.string.tolist()):
                        start -= int(words.first[row])
                        hits[row].update(range(start, start + found.length))
                        items[row].update(strings.items[string])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(words.counts), pa.array(map(sorted, hits), pa.list_(pa.int64())),
                     pa.array(map(sorted, items), pa.list_(pa.string()))], names=["doc_id", "n_words", "hits", "items"])

    return T.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), annotate, _CONTAMINATION)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: numbers of words, hit words and items, and a hash of the item ids."""
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with the columns they came with.

    The text passes through the search as it is, so nothing is joined back.
    """
    files = searches(benchmark)

    def clean(batches):
        parts = _Parts(files)
        for run in parts.runs(batches):
            for (batch, _, _), met in _occurrences(run, parts):
                keep = np.ones(batch.num_rows, dtype=bool)
                for _, found in met:
                    keep[found.row] = False
                yield batch.filter(pa.array(keep))

    return T.map_batches(docs, clean, docs.schema)
