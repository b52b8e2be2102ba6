"""Sharding through a fixed number of virtual slots.

A record's id and checksum are hashed into one of ``SLOTS`` virtual slots; bytes are aggregated
by slot; a versioned map assigns slots to shards, heaviest slot first to the
lightest shard, so that shards come out near equal in bytes. Rebalancing edits
the map only: slots move one by one from the heaviest shards, everything else stays.

Rows get a gapless number in their shard without ordering the shard in one task:
slots are cut into cells of about ``CELL_ROWS`` rows, cells get offsets from their
counts, and rows are numbered within their cell. Rows that agree in id, size and
checksum are counted before that and spread out again after it; every ``COPIES`` of
them are hashed to a slot of their own, so that no record outweighs a shard.

Defined results: a null text has 0 bytes and the checksum of the empty string; rows
without an id are hashed by their checksum; repeated rows get numbers of their own;
extra columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditloom.llm.components import stored
from creditloom.session import scratch_path

SLOTS, SHARDS = 4096, 24
#: Bytes that a record takes besides its text.
ROW_BYTES = 8
CELL_ROWS = 20_000
#: Repeats of a row that share a slot.
COPIES = 512


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``virtual_slot`` and number of ``copies`` of all rows that agree in these."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    same = docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    ).groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))
    return same.select("*", part.alias("part")).select(
        "doc_id", "size", "text_crc32",
        F.pmod(F.xxhash64("doc_id", "text_crc32", "part"), F.lit(slots)).cast("int").alias("virtual_slot"),
        F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES).alias("copies")
    ).groupBy("doc_id", "size", "text_crc32", "virtual_slot").agg(F.sum("copies").alias("copies"))


def slot_weights(rows: DataFrame) -> dict[int, int]:
    """Bytes by virtual slot: at most ``SLOTS`` numbers, whatever the input."""
    return {r.virtual_slot: r.bytes for r in
            rows.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes")).collect()}


def assign(weights: dict[int, int], shards: int = SHARDS, slots: int = SLOTS) -> dict[int, int]:
    """Slot to shard, heaviest slot first to the lightest shard; empty slots are dealt out as well."""
    heap = [(0, 0, shard) for shard in range(shards)]
    placed = {}
    for slot in sorted(range(slots), key=lambda s: (-weights.get(s, 0), s)):
        load, count, shard = heapq.heappop(heap)
        placed[slot] = shard
        heapq.heappush(heap, (load + weights.get(slot, 0), count + 1, shard))
    return placed


def rebalance(placed: dict[int, int], weights: dict[int, int], shards: int) -> dict[int, int]:
    """The map after an edit for ``shards`` shards (more, or the same after loads have changed).

    Slots move from the heaviest to the lightest shard as long as that narrows the gap.
    """
    load = {shard: 0 for shard in range(shards)}
    held: dict[int, set[int]] = {shard: set() for shard in range(shards)}
    for slot, shard in placed.items():
        load[shard] += weights.get(slot, 0)
        held[shard].add(slot)
    placed = dict(placed)
    while True:
        high, low = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        half = (load[high] - load[low]) / 2
        movable = [s for s in held[high] if 0 < weights.get(s, 0) <= half]
        if not movable:
            return placed
        slot = max(movable, key=lambda s: (weights[s], -s))
        held[high].remove(slot)
        held[low].add(slot)
        load[high] -= weights[slot]
        load[low] += weights[slot]
        placed[slot] = low


def map_frame(spark: SparkSession, placed: dict[int, int], weights: dict[int, int], version: int) -> DataFrame:
    return spark.createDataFrame([(version, slot, shard, weights.get(slot, 0)) for slot, shard in sorted(placed.items())],
                                 "version int, virtual_slot int, shard int, bytes long")


def write_map(spark: SparkSession, path: str, placed: dict[int, int], weights: dict[int, int], version: int) -> None:
    """Append a version of the map; earlier versions stay readable."""
    map_frame(spark, placed, weights, version).coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, int]]:
    """A version of the map, the latest by default, as (version, slot to shard)."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return version, {r.virtual_slot: r.shard for r in table.where(F.col("version") == version).collect()}


def placed_rows(rows: DataFrame, placed: dict[int, int]) -> DataFrame:
    """Rows with their ``shard`` and a gapless ``slot`` within it."""
    spark = rows.sparkSession
    maps = map_frame(spark, placed, {}, 0).select("virtual_slot", "shard")
    per_slot = max(1, rows.count() // (len(placed) * CELL_ROWS))
    folded = rows.withColumn("cell", F.pmod(F.xxhash64("text_crc32", "size", "doc_id"), F.lit(per_slot)))
    counts = folded.groupBy("virtual_slot", "cell").agg(F.sum("copies").alias("n"))
    # Cells are few (rows over CELL_ROWS, at least one per slot); one window per shard orders them.
    by_shard = Window.partitionBy("shard").orderBy("virtual_slot", "cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.join(F.broadcast(maps), "virtual_slot")
               .withColumn("offset", F.coalesce(F.sum("n").over(by_shard), F.lit(0))).drop("n"))
    in_cell = (Window.partitionBy("virtual_slot", "cell").orderBy("doc_id", "text_crc32", "size")
               .rowsBetween(Window.unboundedPreceding, -1))
    numbered = (folded.withColumn("before", F.coalesce(F.sum("copies").over(in_cell), F.lit(0)))
                .join(offsets, ["virtual_slot", "cell"])
                .withColumn("first", F.col("offset") + F.col("before")))
    return numbered.select("doc_id", "size", "text_crc32", "virtual_slot", "shard",
                           F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)).alias("slot"))


def current_map(spark: SparkSession, path: str, weights: dict[int, int], shards: int = SHARDS) -> dict[int, int]:
    """The map in use for these loads: the latest version at ``path``, edited where loads ask for it.

    Without a map there, a first version is made. An edit that moves slots is appended as the next
    version; records of other slots stay where they are.
    """
    try:
        version, placed = read_map(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        version, placed = 0, {}
    edited = rebalance(placed, weights, shards) if placed else assign(weights, shards)
    if edited != placed:
        write_map(spark, path, edited, weights, version + 1)
        edited = read_map(spark, path, version + 1)[1]
    return edited


def digest(docs: DataFrame, map_path: str | None = None) -> DataFrame:
    """One row per document: size, checksum, shard and place in it. Bytes decide the map, so there is no grown shard.

    ``map_path`` is where the map lives on between runs; without one, a run has a map of its own.
    """
    spark, rows = docs.sparkSession, stored(records(docs), "records")
    placed = current_map(spark, map_path or scratch_path(spark, "slot-map"), slot_weights(rows))
    return placed_rows(rows, placed).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
