"""Turns of conversations in order, however long one of them is."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from creditloom.llm.components import stored


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """Rows sorted by ``conv_id`` and ``by`` over all partitions.

    Partitions are ranges of the sort key, so a conversation that holds a third of all rows
    is spread over many of them; it may start in one and end in another.
    """
    return rows.repartitionByRange("conv_id", *by).sortWithinPartitions("conv_id", *by)


def runs(ids: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal ids."""
    return np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, dtype=np.int64)


def _counter(batches):
    part, last, reached = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        begins = runs(ids)
        number = np.arange(len(ids)) - np.repeat(begins, np.diff(np.append(begins, len(ids)))) + 1
        if ids[0] == last:
            first = begins[1] if len(begins) > 1 else len(ids)
            number[:first] += reached
        last, reached = ids[-1], number[-1]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(number.astype(np.int64)), pa.array(np.full(len(ids), part, dtype=np.int32))],
            names=[*batch.schema.names, "i", "part"])


def numbered(rows: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their number ``i`` in the conversation (from 1), and ``conv_id``, ``n`` of all conversations.

    Each task numbers its own rows; the parts of conversations that start in an earlier
    partition, at most one in each, are shifted by what lies before.
    """
    schema = StructType(list(rows.schema.fields)).add("i", LongType()).add("part", IntegerType())
    own = stored(in_order(rows, *by).mapInArrow(_counter, schema), "numbered")
    pieces = own.groupBy("conv_id", "part").agg(F.max("i").alias("n"))
    sizes = stored(pieces.groupBy("conv_id").agg(F.sum("n").alias("n"), F.count("*").alias("parts")), "sizes")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (pieces.join(sizes.where("parts > 1").select("conv_id"), "conv_id", "left_semi")
             .withColumn("shift", F.sum("n").over(before)).where("shift IS NOT NULL").drop("n"))
    placed = own.join(F.broadcast(shift), ["conv_id", "part"], "left")
    return (placed.withColumn("i", F.col("i") + F.coalesce("shift", F.lit(0))).drop("part", "shift"),
            sizes.select("conv_id", "n"))
