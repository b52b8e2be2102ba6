"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.session import scratch_path


EDGES_PER_FILE = 100_000


def stored(frame: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back: cuts lineage, survives executors.

    ``files`` bounds the number of files where the rows are known to be few for their number of tasks.
    """
    path = scratch_path(frame.sparkSession, name)
    frame = frame if files is None else frame.coalesce(files)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour of a node (the larger ones, or the smaller ones and itself) to the smallest.

    Minima are aggregated before they are joined back, so the neighbours of a hub
    are never gathered; the join of a hub's edges can be split by Spark.
    """
    if large:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("m"))
    linked = around.join(least, F.col("a") == F.col("node"))
    if large:
        pairs = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        pairs = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return pairs.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every node with an edge.

    ``edges`` has columns a and b of one integer type; direction and repeats don't
    matter. A node that is the smallest of its component is not returned.
    Each round is written to shared storage; the number of rounds grows with the
    logarithm of the longest path.
    """
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = now
        edges = stored(_star(_star(edges, large=True), large=False), "stars", 1 + now[0] // EDGES_PER_FILE)
