"""Variable-capacity best-fit packing of texts into training sequences.

Texts become pieces of at most the largest permitted length. Within a block of
pieces, taken from longest to shortest, a piece goes into the open bin it leaves
least room in; if none has room, the bin size with the least cost per token
that holds it is opened. Every ceiling on the sizes that may be opened is tried
and the cheapest outcome kept, so the permitted lengths are optimised jointly; at the end
each bin shrinks to the cheapest size that holds its contents. A bin of length c
costs c plus ``OVERHEAD`` for the sequence itself by default.

Blocks are runs of at most ``BLOCK`` pieces of one input partition: nothing is
shuffled, memory is bounded by the block, and only the last bins of a block can
suffer from its end. Bins depend on how the input is partitioned; which pieces
exist does not.

The unit is the token of a byte-pair vocabulary, so a text without blanks has its real
length and is cut like any other: the length of a text is its number of tokens plus one
for the end mark.

Defined results: null and empty texts have no pieces; repeated rows are packed
as often as they occur; rows without an id are packed with a null id; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm import text as T
from creditloom.llm.token_store import VOCABULARY, read_ranks, tokenizer

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 16
#: Pieces packed together.
BLOCK = 16_384


def linear_cost(capacity: int) -> float:
    return capacity + OVERHEAD


def best_fit(lengths: np.ndarray, sizes: Sequence[int], cost: Callable[[int], float]) -> tuple[np.ndarray, list[int]]:
    """Bin of every piece and the capacity of every bin, for pieces no longer than the largest size."""
    sizes = sorted(sizes)
    options = [_pack(lengths, sizes, ceiling, cost) for ceiling in sizes]
    shrunk = [(bins, [min((s for s in sizes if s >= u), key=lambda s: (cost(s), s)) for u in used])
              for bins, used in options]
    return min(shrunk, key=lambda option: sum(map(cost, option[1])))


def _pack(lengths: np.ndarray, sizes: list[int], ceiling: int, cost) -> tuple[np.ndarray, list[int]]:
    """Best fit decreasing that opens bins up to ``ceiling`` (beyond it only for longer pieces)."""
    opened = {}
    for n in np.unique(lengths).tolist():
        fitting = [s for s in sizes if s >= n]
        allowed = [s for s in fitting if s <= ceiling] or fitting[:1]
        opened[n] = min(allowed, key=lambda s: (cost(s) / s, -s))
    bins = np.empty(len(lengths), dtype=np.int64)
    used: list[int] = []
    room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]
    mask = 0  # bit r: some bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            chosen = room[left].pop()
            if not room[left]:
                mask &= ~(1 << left)
            used[chosen] += n
        else:
            left, chosen = opened[n], len(used)
            used.append(n)
        left -= n
        if left:
            room[left].append(chosen)
            mask |= 1 << left
        bins[i] = chosen
    return bins, used


_MEMBERS = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))
_SCHEMA = ("capacity long, used long, members array<struct<doc_id: bigint, piece: bigint, start: bigint, length: bigint>>")


def _packer(sizes, cost, block, ranks):
    longest = max(sizes)

    def pieces(batches):
        encode = tokenizer(ranks.value)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if n := len(encode(text.as_py() or "")):
                    for piece, start in enumerate(range(0, n + 1, longest)):
                        yield doc, piece, start, min(longest, n + 1 - start)

    def packed(rows):
        bins, capacities = best_fit(np.array([r[3] for r in rows]), sizes, cost)
        members: list[list[dict]] = [[] for _ in capacities]
        for row, chosen in zip(rows, bins.tolist()):
            members[chosen].append(dict(zip(("doc_id", "piece", "start", "length"), row)))
        used = [sum(m["length"] for m in bin_) for bin_ in members]
        return pa.RecordBatch.from_arrays([pa.array(capacities, pa.int64()), pa.array(used, pa.int64()),
                                           pa.array(members, _MEMBERS)], names=["capacity", "used", "members"])

    def run(batches):
        rows = []
        for piece in pieces(batches):
            rows.append(piece)
            if len(rows) == block:
                yield packed(rows)
                rows = []
        if rows:
            yield packed(rows)
    return run


def pack(docs: DataFrame, sizes: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = linear_cost,
         block: int = BLOCK, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per sequence: ``bin``, its ``capacity``, tokens ``used`` and ``members``.

    A member is a run of ``length`` tokens of a document from token ``start``; the
    end mark is the last token of its document. ``vocabulary`` is a byte-pair rank file.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    bins = T.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                         _packer(tuple(sizes), cost, block, ranks), _SCHEMA)
    return bins.select(F.monotonically_increasing_id().alias("bin"), "capacity", "used",
                       F.size("members").cast("long").alias("n_members"), "members")
