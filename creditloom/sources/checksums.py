"""CRC-32 of files of any size, from ranges that tasks read side by side.

Spark's text reader deals a file's ranges to tasks by itself, wherever the file is
stored. Each task runs the checksum over its range's bytes; checksums of neighbouring
ranges are then joined: the first one is multiplied by x^(8 n) modulo the CRC
polynomial, n the bytes of the second, by matrices of bits for the powers of two in n.
The result is that of ``zlib.crc32`` over the whole file, so cuts, changed bytes and
lines in another order are found.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.sources.manifest import list_files, relative_name

POLYNOMIAL = 0xEDB88320


def _times(matrix: tuple[int, ...], vector: int) -> int:
    out = 0
    for row in matrix:
        if not vector:
            break
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


@functools.cache
def _zeros(power: int) -> tuple[int, ...]:
    """Effect of 2**power zero bytes on a checksum."""
    if power == 0:
        step = (POLYNOMIAL, *(1 << i for i in range(31)))  # one zero bit
        for _ in range(3):
            step = tuple(_times(step, row) for row in step)
        return step
    half = _zeros(power - 1)
    return tuple(_times(half, row) for row in half)


def combine(first: int, second: int, length: int) -> int:
    """Checksum of two pieces from theirs; ``length``: bytes of the second."""
    power = 0
    while length:
        if length & 1:
            first = _times(_zeros(power), first)
        length >>= 1
        power += 1
    return first ^ second


_RANGES = "name string, start long, size long, n long, crc long, open_crc long"


def _ranges(batches):
    """Checksum of each range with and without its last line break, which the file's end may lack."""
    key, state = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, *state)], names=["name", "start", "size", "n", "crc", "open_crc"])

    for batch in batches:
        names, starts, sizes, lines = (batch.column(c) for c in ("name", "start", "size", "line"))
        if not len(lines):
            continue
        wide = np.int64 if pa.types.is_large_binary(lines.type) else np.int32
        bounds = np.frombuffer(lines.buffers()[1], dtype=wide)[lines.offset:lines.offset + len(lines) + 1]
        data = memoryview(lines.buffers()[2])
        new = pc.or_(pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)),
                     pc.not_equal(starts.slice(1), starts.slice(0, len(starts) - 1)))
        begins = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), len(lines)]
        for low, high in zip(begins, begins[1:]):
            now = names[low].as_py(), starts[low].as_py(), sizes[low].as_py()
            if now != key:
                if key is not None:
                    yield done()
                key, state = now, (0, 0, 0)
            part = data[bounds[low]:bounds[high]]
            open_crc = zlib.crc32(part[:-1], state[1])
            state = state[0] + len(part), zlib.crc32(b"\n", open_crc), open_crc
    if key is not None:
        yield done()


_ENTRIES = "entry string, content long, crc32 long"


def _entry(table: pa.Table) -> pa.Table:
    """Checksum of the files of one entry, in the order of their names."""
    crc = length = 0
    rows = sorted(table.to_pylist(), key=lambda r: (r["name"], r["start"]))
    for i, row in enumerate(rows):
        n, own = row["n"], row["crc"]
        if i + 1 == len(rows) or rows[i + 1]["name"] != row["name"]:
            held = sum(r["n"] for r in rows if r["name"] == row["name"]) if row["start"] else n
            if held == row["size"] + 1:
                n, own = n - 1, row["open_crc"]
        crc, length = combine(crc, own, n), length + n
    return pa.table({"entry": pa.array([rows[0]["entry"]]), "content": pa.array([length]), "crc32": pa.array([crc])})


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``(name, length, crc32)`` of every entry of the plain folder ``path``.

    A folder of parts counts as one entry, its parts in the order of their names. Files
    with lines are expected; a line must fit an executor's memory.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    plain = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    rows = lines.select(relative_name(path, plain).alias("name"),
                        F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"),
                        F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"))
    entry = F.substring_index("name", "/", 1)
    found = (rows.mapInArrow(_ranges, _RANGES).withColumn("entry", entry)
             .groupBy("entry").applyInArrow(_entry, _ENTRIES))
    listed = list_files(spark, path).groupBy(entry.alias("name")).agg(F.sum("length").alias("length"))
    # What was read must be what the file system lists, or the checksum is of something else.
    return listed.join(found, F.col("name") == F.col("entry"), "left").select(
        "name", "length", F.when(F.col("length") == 0, F.lit(0).cast("long"))
        .when(F.col("content") == F.col("length"), F.col("crc32")).alias("crc32"))
