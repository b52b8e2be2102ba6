"""Exact de-duplication with counting quotient filters.

Texts are equal when they are identical after replacing each run of blanks by one
space. Every text has a 64-bit fingerprint. Each task counts the fingerprints of its
rows in counting quotient filters, one per segment (the leading bits of the
fingerprint): the next bits are the quotient, kept only as a bit per run, and the
rest is a remainder of as few bits as the filter's size allows, sorted within its run
and followed by its count where that is above one. A filter gives back its
fingerprints in order, so the filters of a segment merge without loss by sorting
their remainders together, whatever their sizes. A text that a third of all rows
share is one remainder with a count in each task's filter.

Fingerprints with a count above one go to byte verification: only their texts are
aggregated, by their bytes, with a partial aggregation in each task, so a frequent
text is moved once per task and two texts of one fingerprint stay apart. All other
rows are alone in their group without having been moved.

Defined results: a null text counts as empty. Rows without an id belong to groups
like others; ``keep_id`` is the smallest id of the group, null if none has an id. Of
rows that repeat one id and text exactly one stays, and a row without an id stays
only if no row of its group has one. Extra columns are not read by ``digest`` and
kept by ``deduplicate``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm import text as T
from creditloom.llm.components import stored

#: Fingerprints that a segment is meant to hold, and the least number of segments (as bits).
PER_SEGMENT, LEAST_SEGMENT_BITS = 1 << 22, 6
#: Fingerprints that a task gathers before it writes its filters.
PER_FILTER = 1 << 18


class Header(NamedTuple):
    """Sizes of a filter: bits of quotient and remainder, used slots."""

    quotient: int
    remainder: int
    slots: int


_HEADER = np.dtype([("quotient", "u1"), ("remainder", "u1"), ("slots", "<u4")])


def _pack(values: np.ndarray, bits: int) -> bytes:
    """The lowest ``bits`` bits of unsigned values, one after the other."""
    every = np.unpackbits(values.astype(">u8").view(np.uint8)).reshape(-1, 64)
    return np.packbits(every[:, 64 - bits:]).tobytes()


def _unpack(data: np.ndarray, bits: int, n: int) -> np.ndarray:
    every = np.zeros((n, 64), dtype=np.uint8)
    every[:, 64 - bits:] = np.unpackbits(data, count=n * bits).reshape(n, bits)
    return np.packbits(every).view(">u8").astype(np.uint64)


def encode(values: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """Filter of sorted distinct values of ``width`` bits (58 at most) and their counts.

    Slots hold remainders in order. A count above one follows its remainder as digits of
    count - 1, lowest first, marked by a bit. Runs are found by two bit vectors, quotients
    that occur and slots that end a run; empty slots are not written.
    """
    quotient = max(1, int(len(values) - 1).bit_length())
    bits = width - quotient
    mask = np.uint64((1 << bits) - 1)
    more = counts.astype(np.uint64) - np.uint64(1)
    digits = (more > 0).astype(np.int64) + (more > mask)
    at = np.cumsum(1 + digits) - 1 - digits
    slots = np.zeros(int(len(values) + digits.sum()), dtype=np.uint64)
    counter, ends = np.ones(len(slots), dtype=bool), np.zeros(len(slots), dtype=bool)
    slots[at], counter[at] = values & mask, False
    slots[at[digits > 0] + 1] = more[digits > 0] & mask
    slots[at[digits > 1] + 2] = more[digits > 1] >> np.uint64(bits)
    home = (values >> np.uint64(bits)).astype(np.int64)
    last = np.append(home[1:] != home[:-1], True)
    ends[(at + digits)[last]] = True
    occupied = np.zeros(1 << quotient, dtype=bool)
    occupied[home] = True
    head = np.array([(quotient, bits, len(slots))], dtype=_HEADER)
    return head.tobytes() + b"".join(np.packbits(x).tobytes() for x in (occupied, ends, counter)) + _pack(slots, bits)


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values and counts of a filter."""
    head = Header(*np.frombuffer(data, dtype=_HEADER, count=1)[0].tolist())
    raw, at, flags = np.frombuffer(data, dtype=np.uint8), _HEADER.itemsize, []
    for n in (1 << head.quotient, head.slots, head.slots):
        flags.append(np.unpackbits(raw[at:at + (n + 7) // 8], count=n).astype(bool))
        at += (n + 7) // 8
    occupied, ends, counter = flags
    slots, bits = _unpack(raw[at:], head.remainder, head.slots), np.uint64(head.remainder)
    entry = np.flatnonzero(~counter)
    run = np.cumsum(ends) - ends
    values = (np.flatnonzero(occupied)[run[entry]].astype(np.uint64) << bits) | slots[entry]
    digits = np.diff(np.append(entry, head.slots)) - 1
    counts = np.ones(len(entry), dtype=np.uint64)
    counts[digits > 0] += slots[entry[digits > 0] + 1]
    counts[digits > 1] += slots[entry[digits > 1] + 2] << bits
    return values, counts.astype(np.int64)


def merge(filters: list[bytes], width: int) -> bytes:
    """One filter with the summed counts of several."""
    values, counts = (np.concatenate(x) for x in zip(*map(decode, filters)))
    order = np.argsort(values, kind="stable")
    values = values[order]
    begins = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return encode(values[begins], np.add.reduceat(counts[order], begins), width)


_FILTERS = "segment int, filter binary"


def _builder(segment_bits: int):
    width = 64 - segment_bits

    def of(values: np.ndarray):
        values, counts = np.unique(values, return_counts=True)
        segment = (values >> np.uint64(width)).astype(np.int32)
        values = values & np.uint64((1 << width) - 1)
        names, begins = np.unique(segment, return_index=True)
        parts = [encode(values[low:high], counts[low:high], width)
                 for low, high in zip(begins, np.append(begins[1:], len(values)))]
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(parts, pa.binary())], names=["segment", "filter"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch.column("fingerprint").to_numpy().view(np.uint64))
            n += batch.num_rows
            if n >= PER_FILTER:
                yield of(np.concatenate(held))
                held, n = [], 0
        if n:
            yield of(np.concatenate(held))
    return run


def filters(named: DataFrame, segment_bits: int) -> DataFrame:
    """Each task's filters of its rows' ``fingerprint``: ``segment`` and ``filter``."""
    return named.select("fingerprint").mapInArrow(_builder(segment_bits), _FILTERS)


def merged(parts: DataFrame, segment_bits: int) -> DataFrame:
    """One filter per segment; filters of other days or tables may be among ``parts``."""
    def run(table: pa.Table) -> pa.Table:
        whole = merge(table.column("filter").to_pylist(), 64 - segment_bits)
        return pa.table({"segment": table.column("segment").slice(0, 1), "filter": pa.array([whole], pa.binary())})
    return parts.groupBy("segment").applyInArrow(run, _FILTERS)


def repeated(whole: DataFrame, segment_bits: int) -> DataFrame:
    """Fingerprints of merged filters that were counted more than once."""
    width = 64 - segment_bits

    def run(batches):
        for batch in batches:
            for segment, data in zip(batch.column("segment").to_pylist(), batch.column("filter").to_pylist()):
                values, counts = decode(data)
                values = values[counts > 1] | np.uint64(segment << width)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], names=["fingerprint"])
    return whole.mapInArrow(run, "fingerprint long")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _named(docs: DataFrame, *more: Column) -> DataFrame:
    """Id, row number, fingerprint and SHA-256 of every row, stored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("bytes"), *more)
    return stored(rows.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64("bytes").alias("fingerprint"),
        F.unhex(F.sha2("bytes", 256)).alias("sha"), *rows.columns[2:]), "fingerprints")


def _groups(docs: DataFrame, named: DataFrame) -> DataFrame:
    """Groups of two rows or more: fingerprint, SHA-256, size, id and row number of the one that stays."""
    bits = max(LEAST_SEGMENT_BITS, (named.count() // PER_SEGMENT).bit_length())
    again = stored(repeated(merged(filters(named, bits), bits), bits), "repeated")
    texts = docs.select(normalised(F.col("text")).alias("bytes")).withColumn("fingerprint", F.xxhash64("bytes"))
    verified = (texts.join(again, "fingerprint", "left_semi").groupBy("fingerprint", "bytes")
                .agg(F.count("*").alias("group_size")).where("group_size > 1")
                .select("fingerprint", F.unhex(F.sha2("bytes", 256)).alias("sha"), "group_size"))
    first = (named.join(again, "fingerprint", "left_semi").groupBy("fingerprint", "sha")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")))
    return stored(verified.join(first, ["fingerprint", "sha"]).select(
        "fingerprint", "sha", "group_size", F.col("first.doc_id").alias("keep_id"),
        F.col("first.row").alias("keep_row")), "groups")


def _decided(docs: DataFrame, *more: Column) -> DataFrame:
    """Every row with its group; the rows of a large group lie on the side that adaptive execution splits."""
    named = _named(docs, *more)
    alone = F.col("group_size").isNull()
    return named.join(_groups(docs, named), ["fingerprint", "sha"], "left").select(
        *named.columns[4:], "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"), (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: the id that stays, the size of its group, whether it stays, its text's SHA-256."""
    return _decided(docs)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    return _decided(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")).where("kept").select("whole.*")
