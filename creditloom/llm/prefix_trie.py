"""Prefix trie of conversations with totals over subtrees, rolled up by bands of depth.

Conversations often start alike. A node stands for a distinct sequence of first turns;
its key is the XOR of two 64-bit hashes of each (turn, position), so that keys of
prefixes are running XORs and a parent's key is its child's without the last turn.

Totals over subtrees come from bands of ``BAND`` levels. A node adds its own value only
to its ancestors within its band, at most ``BAND`` rows, in one aggregation for all
bands. The first levels of the bands, the band roots, then form a trie that is ``BAND``
times shallower and hold the sums of their bands as values; its totals are found in the
same way. Completed totals of band roots are added to their ancestors in the band above.
The depth of the trie sets the number of rounds only by its logarithm.

Long conversations are handled in blocks of ``BLOCK`` positions: all windows and joins
on a conversation's turns have the block in their key.

Defined results: null role or text is empty. Turns of equal number are in the order of
a hash of role and text. Rows without a conversation are left out; an empty table has
no nodes, not even a root. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.components import stored
from creditloom.llm.turns import numbered, runs

BAND = 16
BLOCK = 1 << 16  # a multiple of BAND
#: Rebuilding: conversations of one group of GROUP ids share up to SHARED - 1 first turns.
GROUP, SHARED = 5, 9
KEY = ["k0", "k1"]


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(said)).alias("said"), F.octet_length(text).cast("long").alias("bytes"))


def _shared(conv_id: str) -> Column:
    return F.crc32(F.col(conv_id).cast("string")) % SHARED


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Turns (from 1) of the rebuilt conversations, and a turn 0 for each: c, pos, said, bytes, n.

    The first h turns are those of the first conversation of the group, h by a hash of the id;
    the conversation's own turns after its first h follow. ``n`` is the number of all turns.
    """
    rows, sizes = numbered(_turns(conversations), "turn", "said")
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    given = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("given"))
    convs = (sizes.withColumn("base", base).withColumn("h", _shared("conv_id")).join(given, "base", "left")
             .withColumn("head", F.least("h", F.coalesce("given", F.lit(0)))))
    convs = stored(convs.select(F.col("conv_id").alias("c"), "base", "h", "head", F.col("n").alias("own"),
                                (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "convs")
    root = convs.select("c", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("said"),
                        F.lit(0).cast("long").alias("bytes"), "n")
    first = rows.where((F.col("i") < SHARED) & (base == F.col("conv_id"))).join(
        convs, (F.col("conv_id") == F.col("base")) & (F.col("i") <= F.col("h")))
    blocks = convs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("own") / BLOCK))))
    rest = (rows.where(F.col("i") > _shared("conv_id")).withColumn("block", F.floor(F.col("i") / BLOCK))
            .join(blocks.withColumnRenamed("c", "conv_id"), ["conv_id", "block"]))
    return (root.unionByName(first.select("c", F.col("i").alias("pos"), "said", "bytes", "n"))
            .unionByName(rest.select(F.col("conv_id").alias("c"), (F.col("i") - F.col("h") + F.col("head")).alias("pos"),
                                     "said", "bytes", "n")))


def prefixes(turns: DataFrame) -> DataFrame:
    """Key of the prefix that ends in each turn, and that of its parent."""
    own = (F.xxhash64("said", "pos"), F.xxhash64("pos", "said", F.lit(1)))
    rows = turns.select("c", "pos", "bytes", "n", *(F.when(F.col("pos") == 0, F.lit(0).cast("long")).otherwise(x).alias(f"a{j}")
                                                    for j, x in enumerate(own)))
    rows = stored(rows.withColumn("block", F.floor(F.col("pos") / BLOCK)), "turns")
    earlier = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (rows.where(F.col("n") >= BLOCK).groupBy("c", "block")
               .agg(*(F.bit_xor(f"a{j}").alias(f"t{j}") for j in (0, 1)))
               .select("c", "block", *(F.coalesce(F.bit_xor(f"t{j}").over(earlier), F.lit(0)).alias(f"o{j}") for j in (0, 1))))
    so_far = Window.partitionBy("c", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    keyed = rows.select("*", *(F.bit_xor(f"a{j}").over(so_far).alias(f"k{j}") for j in (0, 1))).join(carried, ["c", "block"], "left")
    keys = [F.col(f"k{j}").bitwiseXOR(F.coalesce(f"o{j}", F.lit(0))) for j in (0, 1)]
    return keyed.select("c", "pos", "bytes", (F.col("pos") == F.col("n")).alias("ends"),
                        *(k.alias(f"k{j}") for j, k in enumerate(keys)),
                        *(k.bitwiseXOR(F.col(f"a{j}")).alias(f"p{j}") for j, k in enumerate(keys)))


def _above(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with the keys ``above`` each, from the first level of its parent's band to its parent.

    They are read off the node's smallest member, whose prefixes are ``rows`` (c, d, k0, k1).
    """
    start = F.floor((F.col("d") - 1) / BLOCK)
    blocks = rows.withColumn("block", F.greatest(start, F.lit(0)))
    # The last level of a block begins a band of the next one.
    blocks = blocks.unionByName(rows.where((F.col("d") > 0) & (F.col("d") % BLOCK == 0)).withColumn("block", start + 1))
    seen = Window.partitionBy("c", "block").orderBy("d").rowsBetween(-BAND, -1)
    length = (F.col("d") - 1) % BAND + 1
    listed = blocks.select("c", "d", "block", F.collect_list(F.struct(*KEY)).over(seen).alias("above")).where(
        (F.col("d") > 0) & (F.col("block") == start))
    listed = listed.select("c", "d", F.slice("above", -length.cast("int"), length.cast("int")).alias("above"))
    return (nodes.join(listed, (F.col("conv_id") == F.col("c")) & (nodes["d"] == listed["d"]), "left")
            .select(*(nodes[x] for x in nodes.columns), "above"))


def rollup(rows: DataFrame, nodes: DataFrame, depth: int, values: tuple[str, ...]) -> DataFrame:
    """Key and ``values`` summed over the subtree of every node.

    ``rows``: c, d, k0, k1, the prefixes of all members; ``nodes``: k0, k1, d, conv_id (the
    smallest member) and the values; ``depth``: the greatest d.
    """
    nodes = stored(_above(rows, nodes), "band-nodes")
    begins = F.col("d") % BAND == 0
    self = F.array(F.struct(*KEY))
    held = nodes.select(F.explode(F.when(begins, self).otherwise(F.concat(self, "above"))).alias("k"), *values)
    inner = held.groupBy("k").agg(*(F.sum(v).alias(v) for v in values)).select("k.*", *values)
    if depth < BAND:
        return inner
    inner = stored(nodes.drop(*values).join(inner, KEY), "band-sums")
    roots = inner.where(begins).select(*KEY, (F.col("d") / BAND).cast("long").alias("d"), "conv_id", *values)
    above = rows.where(begins).withColumn("d", (F.col("d") / BAND).cast("long"))
    whole = stored(rollup(above, roots, depth // BAND, values), "band-totals")
    below = nodes.where(begins & (F.col("d") > 0)).select(*KEY, F.slice("above", 2, BAND).alias("above"))
    passed = (below.join(whole, KEY).select(F.explode("above").alias("k"), *values)
              .groupBy("k").agg(*(F.sum(v).alias(f"{v}_below") for v in values)).select("k.*", *(f"{v}_below" for v in values)))
    rest = inner.where(~begins).join(passed, KEY, "left").select(
        *KEY, *((F.col(v) + F.coalesce(f"{v}_below", F.lit(0))).alias(v) for v in values))
    return rest.unionByName(whole.select(*rest.columns))


#: Ids in one chunk of a node's ids.
CHUNK = 1 << 16
_CHUNKS = "k0 long, k1 long, task int, seq int, ids string, ends_sha256 string"


def _sha(ids: str) -> str:
    return hashlib.sha256(ids.encode()).hexdigest()


def _end_chunks(batches):
    """The hash of each node whose ids, in order, lie in one task; ids of a task's first and last node, or of many, in chunks."""
    task, key, held, seq, opening, out = TaskContext.get().partitionId(), None, [], 0, True, []

    def add(whole: bool):
        ids = ",".join(held)
        out.append((*key, task, seq, None if whole else ids, _sha(ids) if whole else None))

    def batch_of():
        return pa.RecordBatch.from_arrays(
            [pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()))],
            names=[*KEY, "task", "seq", "ids", "ends_sha256"])

    for batch in batches:
        k0, k1, c = (batch.column(x).to_numpy() for x in (*KEY, "c"))
        begins = np.union1d(runs(k0), runs(k1))
        for low, high in zip(begins, np.append(begins[1:], len(c))):
            if key != (k0[low], k1[low]):
                if held:
                    add(whole=not opening and seq == 0)
                opening = key is None
                key, held, seq = (k0[low], k1[low]), [], 0
            for at in range(low, high, CHUNK):
                held += map(str, c[at:min(at + CHUNK, high)].tolist())
                if len(held) >= CHUNK:
                    add(whole=False)
                    held, seq = [], seq + 1
        if out:
            yield batch_of()
            out.clear()
    if held:
        add(whole=False)
        yield batch_of()


def _join_chunks(batches):
    """Hashes of the nodes whose chunks follow each other."""
    key, digest = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([digest.hexdigest()])],
                                          names=[*KEY, "ends_sha256"])
    for batch in batches:
        for k0, k1, ids in zip(*(batch.column(x).to_pylist() for x in (*KEY, "ids"))):
            if key == (k0, k1):
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                yield done()
            key, digest = (k0, k1), hashlib.sha256(ids.encode())
    if key is not None:
        yield done()


def _end_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ids in ascending order. It is sequential, but what passes through one task are chunks of many ids."""
    order = [*KEY, "c"]
    chunks = stored(ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_end_chunks, _CHUNKS), "ends")
    open_ = (chunks.where("ids IS NOT NULL").select(*KEY, "task", "seq", "ids").repartition(*KEY)
             .sortWithinPartitions(*KEY, "task", "seq").mapInArrow(_join_chunks, "k0 long, k1 long, ends_sha256 string"))
    return chunks.where("ids IS NULL").select(*KEY, "ends_sha256").unionByName(open_)


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: members, parent, children, leaves below, tokens saved below, hash of the members that end here."""
    rows = stored(prefixes(rebuilt(conversations)), "prefixes")
    nodes = rows.groupBy("k0", "k1").agg(
        F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), F.max("pos").alias("d"), F.max("bytes").alias("bytes"),
        F.max("p0").alias("p0"), F.max("p1").alias("p1"))
    nodes = stored(nodes, "nodes")
    children = (nodes.where("d > 0").groupBy(F.col("p0").alias("k0"), F.col("p1").alias("k1"))
                .agg(F.count("*").alias("n_children")))
    nodes = stored(nodes.join(children, KEY, "left").fillna(0, ["n_children"]), "counted")
    depth = nodes.agg(F.max("d")).first()[0]
    values = nodes.select(*KEY, "d", "conv_id", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                          ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = rollup(rows.select("c", F.col("pos").alias("d"), *KEY), values, depth or 0, ("n_leaves", "saved_tokens"))
    ends = _end_hashes(rows.where("ends").select(*KEY, "c"))
    parents = nodes.select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("parent"))
    # The children of one node lie on the side that adaptive execution splits.
    return (nodes.join(totals, KEY).join(ends, KEY, "left").join(parents, ["p0", "p1"], "left")
            .select("conv_id", F.col("d").alias("depth"), F.when(F.col("d") > 0, F.col("parent")).alias("parent_conv_id"),
                    "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))
