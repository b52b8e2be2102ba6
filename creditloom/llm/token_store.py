"""Token-id shards in training order.

Texts are tokenised and cut into sequences of a fixed stride. Each sequence gets a
gapless index, from the number of sequences its writing task and the tasks before it
produced; a keyed Feistel permutation with cycle-walking turns the index into its
global slot, so the order of training is a pseudo-random permutation that needs no
shuffle of a permutation table and can be computed for any single sequence. Rows are
range partitioned by slot and stored in blocks: shard ``s`` holds the slots from
``s * shard_slots``, block ``b`` of it a fixed number of them in one binary value of fixed stride. Reading
resumes at any slot by computing shard, block and byte offset.

The vocabulary is a byte-pair rank file; ids are little-endian uint16, so it may
have at most 65,535 entries; the id after the last rank ends a text and pads.

Defined results: null and empty texts are one sequence of padding, so every row is
in the output; repeated rows have sequences of their own; texts of any length are
tokenised whole; extra columns are not read.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import text as T
from creditloom.llm.components import stored
from creditloom.session import scratch_path

VOCABULARY = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
STRIDE, SHARD_SLOTS, BLOCK_SLOTS, KEY, ROUNDS = 1024, 65_536, 256, 0x5EED, 6
#: Ranges of slots in a shard, each written by one task.
RANGES = 16

#: The usual splitting pattern of byte-level vocabularies (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    if len(ranks) >= 65_535:
        raise ValueError("ids must fit 16 bits with one left for the end of a text")
    return ranks


def feistel(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of sequence indexes: a permutation of 0..n-1 chosen by the key.

    The network permutes the smallest even number of bits that holds n; a value that
    lands beyond n is sent round again until it does not.
    """
    half = max(1, -(-max(1, int(n - 1).bit_length()) // 2))
    low = np.uint64((1 << half) - 1)
    keys = T.mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> np.uint64(half), out[walking] & low
        for k in keys:
            left, right = right, left ^ (T.mix(right + k) & low)
        out[walking] = (left << np.uint64(half)) | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


def unfeistel(slot: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Indexes of slots: the inverse of ``feistel``."""
    half = max(1, -(-max(1, int(n - 1).bit_length()) // 2))
    low = np.uint64((1 << half) - 1)
    keys = T.mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = slot.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> np.uint64(half), out[walking] & low
        for k in keys[::-1]:
            left, right = right ^ (T.mix(left + k) & low), left
        out[walking] = (left << np.uint64(half)) | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


_RUN = re.compile(r"\s\s")


def tokenizer(ranks: dict[bytes, int]):
    """Function from a text to its ids.

    The pattern's look-ahead only matters where white space follows white space;
    other texts are split by the pattern without it, which matches about twice as fast.
    """
    import tiktoken

    exact, plain = (tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={})
                    for p in (PATTERN, PATTERN.replace(r"\s+(?!\S)|", "")))

    def ids(text: str) -> np.ndarray:
        encoding = exact if _RUN.search(text) else plain
        return encoding.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)
    return ids


def _sequencer(ranks, stride: int):
    def run(batches):
        encode, end = tokenizer(ranks.value), max(ranks.value.values()) + 1
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in T.slices(batch.column("text")):
                ids = batch.column("doc_id").slice(part.low, part.high - part.low).to_pylist()
                out = {"doc_id": [], "piece": [], "n_tokens": [], "tokens": []}
                for doc, a, b in zip(ids, part.bounds[:-1], part.bounds[1:]):
                    tokens = encode(part.data[a:b].tobytes().decode("utf-8", "replace"))
                    pieces = -(-(len(tokens) + 1) // stride)
                    padded = np.full(pieces * stride, end, dtype=np.uint16)
                    padded[:len(tokens)] = tokens
                    for piece in range(pieces):
                        out["doc_id"].append(doc)
                        out["piece"].append(piece)
                        out["n_tokens"].append(min(stride, len(tokens) - piece * stride))
                        out["tokens"].append(padded[piece * stride:(piece + 1) * stride].tobytes())
                n = len(out["piece"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, task)), pa.array(np.arange(row, row + n)), pa.array(out["doc_id"], pa.int64()),
                     pa.array(out["piece"], pa.int64()), pa.array(out["n_tokens"], pa.int64()), pa.array(out["tokens"], pa.binary())],
                    names=["task", "row", "doc_id", "piece", "n_tokens", "tokens"])
                row += n
    return run


def sequences(docs: DataFrame, vocabulary: str = VOCABULARY, stride: int = STRIDE, key: int = KEY) -> DataFrame:
    """Every sequence with its ``slot``: ``doc_id``, ``piece``, ``n_tokens`` (without padding) and ``tokens``."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    rows = stored(T.map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _sequencer(ranks, stride),
        "task long, row long, doc_id long, piece long, n_tokens long, tokens binary"), "sequences")
    # One number per writing task.
    sizes = {r.task: r.n for r in rows.groupBy("task").agg(F.count("*").alias("n")).collect()}
    total, offset, offsets = sum(sizes.values()), 0, []
    for task in sorted(sizes):
        offsets.append((task, offset))
        offset += sizes[task]
    offsets = spark.createDataFrame(offsets, "task long, offset long")
    placed = rows.join(F.broadcast(offsets), "task").select(
        (F.col("offset") + F.col("row")).alias("index"), "doc_id", "piece", "n_tokens", "tokens")

    def slots(batches):
        for batch in batches:
            slot = feistel(batch.column("index").to_numpy(), total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), *(batch.column(c) for c in ("doc_id", "piece", "n_tokens", "tokens"))],
                                             names=["slot", "doc_id", "piece", "n_tokens", "tokens"])
    return T.map_batches(placed, slots, "slot long, doc_id long, piece long, n_tokens long, tokens binary")


def in_training_order(rows: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Sequences range partitioned and sorted by slot, with their ``shard``."""
    return (rows.withColumn("shard", (F.col("slot") / shard_slots).cast("long"))
            .repartitionByRange("slot").sortWithinPartitions("slot"))


_BLOCKS = ("block long, first_slot long, n int, "
           "members array<struct<slot: bigint, doc_id: bigint, piece: bigint, n_tokens: bigint>>, payload binary")


def _packer(shard_slots: int, block_slots: int):
    """Rows sorted by slot, no block of which lies in two tasks, to one row per block."""
    member = pa.struct([(c, pa.int64()) for c in ("slot", "doc_id", "piece", "n_tokens")])

    def packed(parts):
        rows = pa.Table.from_batches(parts)
        first, n = rows.column("slot")[0].as_py(), rows.num_rows
        members = pa.StructArray.from_arrays([rows.column(f.name).combine_chunks() for f in member], fields=list(member))
        payload = b"".join(v.as_buffer() for v in rows.column("tokens"))
        return pa.RecordBatch.from_arrays(
            [pa.array([first // shard_slots], pa.int64()), pa.array([first % shard_slots // block_slots], pa.int64()),
             pa.array([first], pa.int64()), pa.array([n], pa.int32()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), members),
             pa.array([payload], pa.binary())], names=["shard", "block", "first_slot", "n", "members", "payload"])

    def run(batches):
        held, current = [], None
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            shard = slot // shard_slots
            block = np.stack([shard, (slot - shard * shard_slots) // block_slots], axis=1)
            cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]).any(axis=1)) + 1).tolist(), len(slot)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                if held and current != tuple(block[low]):
                    yield packed(held)
                    held = []
                current = tuple(block[low])
                held.append(batch.slice(low, high - low))
        if held:
            yield packed(held)
    return run


def _tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_shards(rows: DataFrame, path: str, shard_slots: int = SHARD_SLOTS, block_slots: int = BLOCK_SLOTS) -> None:
    """Store sequences as blocks of fixed-stride binary, partitioned by shard.

    A block is at most ``block_slots`` sequences; ``members`` keeps which documents they are of.
    Slots are gapless, so the ranges are known without sampling the sequences: a range is
    ``RANGES`` to a shard, whole blocks each, and ranges are dealt to tasks in turn.
    """
    per_shard = -(-shard_slots // block_slots)
    blocks = -(-per_shard // RANGES)
    slot = F.col("slot")
    number = (F.floor(slot / shard_slots) * -(-per_shard // blocks) + F.floor(slot % shard_slots / (blocks * block_slots)))
    placed = (rows.select("slot", "doc_id", "piece", "n_tokens", "tokens")
              .repartitionById(_tasks(rows.sparkSession), (number % _tasks(rows.sparkSession)).cast("int"))
              .sortWithinPartitions("slot"))
    blocks = T.map_batches(placed, _packer(shard_slots, block_slots), f"shard long, {_BLOCKS}")
    (blocks.sortWithinPartitions("shard", "block").write.option("compression", "zstd").partitionBy("shard").parquet(path))


def _members(batches):
    for batch in batches:
        shards = batch.column("shard").to_pylist()
        for i, members in enumerate(batch.column("members")):
            rows, payload = members.values, batch.column("payload")[i].as_buffer()
            n = len(rows)
            offsets = np.arange(n + 1, dtype=np.int32) * (len(payload) // n)
            tokens = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), payload])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, shards[i])), *(rows.field(c) for c in ("slot", "doc_id", "piece", "n_tokens")), tokens],
                names=["shard", "slot", "doc_id", "piece", "n_tokens", "tokens"])


def stored_order(spark: SparkSession, path: str) -> DataFrame:
    """The sequences of stored shards, cut from their blocks, in the order of their slots."""
    blocks = spark.read.schema(f"{_BLOCKS}, shard long").parquet(path).select("shard", "first_slot", "members", "payload")
    # Files are read largest first, so whole blocks are put in order again; the last slot gives the ranges.
    total, tasks = (blocks.agg(F.max(F.col("first_slot"))).first()[0] or 0) + 1, _tasks(spark)
    dealt = blocks.repartitionById(tasks, F.floor(F.col("first_slot") / total * tasks).cast("int"))
    return T.map_batches(dealt.sortWithinPartitions("first_slot"), _members,
                         "shard long, slot long, doc_id long, piece long, n_tokens long, tokens binary")


def read_from(spark: SparkSession, path: str, slot: int, n: int, stride: int = STRIDE,
              shard_slots: int = SHARD_SLOTS, block_slots: int = BLOCK_SLOTS) -> np.ndarray:
    """Token ids of ``n`` sequences from ``slot`` on; only the blocks that hold them are read."""
    last = slot + n - 1
    table = spark.read.parquet(path).where(F.col("shard").between(slot // shard_slots, last // shard_slots))
    blocks = table.where((F.col("first_slot") <= last) & (F.col("first_slot") + F.col("n") > slot)).orderBy("first_slot")
    out = []
    for row in blocks.select("first_slot", "n", "payload").toLocalIterator():
        ids = np.frombuffer(bytes(row.payload), dtype=np.uint16).reshape(row.n, stride)
        out.append(ids[max(0, slot - row.first_slot):last + 1 - row.first_slot])
    return np.concatenate(out) if out else np.zeros((0, stride), dtype=np.uint16)


def digest(docs: DataFrame) -> DataFrame:
    """All sequences in training order, read back from the blocks of the shards that this writes."""
    path = scratch_path(docs.sparkSession, "shards")
    write_shards(sequences(docs), path)
    return stored_order(docs.sparkSession, path)
