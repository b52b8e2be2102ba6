"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in slices by numpy. The trees are grown
level by level on histograms of binned statistics, with the second-order gain of
the logistic loss, and kept as flat arrays (one row per tree, nodes in heap
order), which numpy walks for all documents of a slice at once.

Labels are learnt from a bounded sample: at most ``MAX_ROWS`` labelled documents
outside the held-out fold, taken in the order of a hash of their id and cut off
at ``MAX_BYTES`` of text. Everything else covers all documents.

Defined results: null is an empty text and gets the score of one; without any
usable label nothing can be learnt and every score is 1; if all labels agree the
score is their smoothed share. An id labelled more than once counts as 1 if most
of its labels are 1. Rows without an id are scored and never held out or learnt
from. Extra columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm import text as T

#: Bounds of the training sample.
MAX_ROWS, MAX_BYTES = 12_000, 48 << 20
#: Longer texts are sampled only if there is room beside all others.
LONG_BYTES = MAX_BYTES // 100
TREES, DEPTH, BINS, RATE, RIDGE, MIN_WEIGHT = 80, 4, 64, 0.15, 1.0, 1.0
THRESHOLD = 0.7

#: Characters that mark tables, markup and symbol noise.
SYMBOLS = b"#*$%&|<>{}[]\\^~=_@"

NAMES = ("log_bytes", "log_words", "mean_word", "deviation_word", "longest_word", "symbols", "bangs", "bars",
         "upper", "digits", "punctuation", "foreign", "breaks", "distinct_words", "repeated_next",
         "distinct_triples", "repeated_lines", "line_words")


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_CLASSES = {
    "symbols": _class(SYMBOLS), "bangs": _class(b"!?"), "bars": _class(b"|"),
    "upper": _class(bytes(range(65, 91))), "digits": _class(b"0123456789"),
    "punctuation": _class(b".,;:-'\"()"), "foreign": _class(bytes(range(128, 256))), "breaks": _class(b"\n"),
}
_LINES = np.ones(256, dtype=bool)
_LINES[10] = False


def _distinct_share(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    size = np.bincount(rows, minlength=n)
    once, _ = T.distinct(rows, hashes)
    return np.bincount(once, minlength=n) / np.maximum(size, 1)


def statistics(part: T.Slice) -> np.ndarray:
    """One row of ``NAMES`` per text of a slice."""
    n = part.high - part.low
    found = T.words(part.data, part.bounds, T.SPACED)
    row, count = found.row, np.maximum(found.counts, 1)
    size = np.maximum(np.diff(part.bounds), 1)
    length = (found.end - found.start).astype(np.float64)
    mean = np.bincount(row, length, minlength=n) / count
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    share = {}
    for name, kind in _CLASSES.items():
        run = np.concatenate([[0], np.cumsum(kind[part.data])])
        share[name] = run[part.bounds[1:]] - run[part.bounds[:-1]]
    same = np.zeros(len(row), dtype=bool)
    same[1:] = (found.hash[1:] == found.hash[:-1]) & (row[1:] == row[:-1])
    triple, triple_hash = T.windows(found, 3)
    lines = T.words(part.data, part.bounds, _LINES)
    columns = [
        np.log1p(np.diff(part.bounds)), np.log1p(found.counts), mean,
        np.sqrt(np.maximum(np.bincount(row, length ** 2, minlength=n) / count - mean ** 2, 0)), np.log1p(longest),
        share["symbols"] / count, share["bangs"] / count, share["bars"] / count,
        share["upper"] / size, share["digits"] / size, share["punctuation"] / count, share["foreign"] / size,
        share["breaks"] / count, _distinct_share(row, found.hash, n), np.bincount(row[same], minlength=n) / count,
        _distinct_share(row[triple], triple_hash, n), 1 - _distinct_share(lines.row, lines.hash, n),
        np.log1p(found.counts / np.maximum(lines.counts, 1)),
    ]
    return np.stack(columns, axis=1)


class Forest(NamedTuple):
    """Flat trees: heap-ordered nodes; a value goes right if its bin is above the node's."""

    edges: list[np.ndarray]   # by statistic: upper bounds of all bins but the last
    statistic: np.ndarray     # tree x inner node
    bin: np.ndarray           # tree x inner node
    leaf: np.ndarray          # tree x leaf
    start: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x).astype(np.int32) if len(self.statistic) else None
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for statistic, cut, leaf in zip(self.statistic, self.bin, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (bins[rows, statistic[node]] > cut[node])
            total += leaf[node - (2 ** DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Fit a forest to statistics and 0/1 labels."""
    ones, n = float(y.sum()), len(y)
    start = float(np.log((ones + 0.25) / (n - ones + 0.25))) if n else 40.0
    if ones in (0, n):
        none = np.zeros((0, 2 ** DEPTH - 1), dtype=np.int64)
        return Forest([], none, none, np.zeros((0, 2 ** DEPTH)), start)
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, i], quantiles)) for i in range(x.shape[1])]
    forest = Forest(edges, None, None, None, start)
    bins = forest.binned(x)
    flat = bins + np.arange(x.shape[1]) * BINS
    total = np.full(n, start)
    statistic, cut, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        tree = _tree(flat, bins, p - y, p * (1 - p))
        statistic.append(tree[0])
        cut.append(tree[1])
        leaves.append(tree[2])
        total += tree[2][tree[3]]
    return Forest(edges, np.array(statistic), np.array(cut), np.array(leaves), start)


def _tree(flat, bins, gradient, weight):
    n, width = bins.shape
    node = np.zeros(n, dtype=np.int64)
    statistic = np.zeros(2 ** DEPTH - 1, dtype=np.int64)
    cut = np.full(2 ** DEPTH - 1, BINS, dtype=np.int64)  # nothing goes right
    for level in range(DEPTH):
        first, nodes = 2 ** level - 1, 2 ** level
        at = ((node - first)[:, None] * (width * BINS) + flat).ravel()
        g, h = (np.bincount(at, np.repeat(v, width), minlength=nodes * width * BINS)
                .reshape(nodes, width, BINS).cumsum(axis=2) for v in (gradient, weight))
        all_g, all_h = g[:, :, -1:], h[:, :, -1:]
        gain = g ** 2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g ** 2 / (all_h + RIDGE)
        gain[(h < MIN_WEIGHT) | (all_h - h < MIN_WEIGHT)] = 0
        best = gain.reshape(nodes, -1).argmax(axis=1)
        useful = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
        statistic[first:first + nodes] = np.where(useful, best // BINS, 0)
        cut[first:first + nodes] = np.where(useful, best % BINS, BINS)
        node = 2 * node + 1 + (bins[np.arange(n), statistic[node]] > cut[node])
    leaf = node - (2 ** DEPTH - 1)
    g, h = (np.bincount(leaf, v, minlength=2 ** DEPTH) for v in (gradient, weight))
    return statistic, cut, -RATE * g / (h + RIDGE), leaf


def held_out(modulus: int, remainder: int):
    """Whether a row's id falls into the fold that labels are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sample_frame(docs: DataFrame, labels: DataFrame, label: str, held, max_rows: int,
                 max_bytes: int) -> DataFrame:
    """``doc_id``, label ``y`` and ``text`` of a bounded sample of labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    voted = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held)
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label) > 0.5).cast("int").alias("y"))
             .orderBy(*order).limit(max_rows))
    chosen = spark.createDataFrame([tuple(r) for r in voted.collect()], "doc_id long, y int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    # At most max_rows ids of 8 bytes, so this side may be broadcast.
    met = texts.join(F.broadcast(chosen), "doc_id")
    sizes = sorted((r.h, r.doc_id, r.n) for r in
                   met.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("n"))
                   .select("doc_id", "n", F.xxhash64("doc_id").alias("h")).collect())
    kept, room = [], max_bytes
    for _, doc, n in sorted(sizes, key=lambda s: s[2] > LONG_BYTES):
        if n <= room:
            kept.append(doc)
            room -= n
    ids = spark.createDataFrame([(i,) for i in sorted(kept)], "doc_id long")
    return met.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held, max_rows: int,
                    max_bytes: int) -> list[tuple[int, str]]:
    """(label, text) of the sample, by id."""
    rows = sample_frame(docs, labels, label, held, max_rows, max_bytes).collect()
    return [(r.y, r.text) for r in sorted(rows, key=lambda r: r.doc_id)]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Forest:
    """A forest learnt from the sample; only its statistics come to the driver, not its texts."""
    def run(batches):
        for batch in batches:
            for part in T.slices(batch.column("text")):
                rows = batch.slice(part.low, part.high - part.low)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("y"), pa.array(list(statistics(part)), pa.list_(pa.float64()))],
                    names=["doc_id", "y", "x"])
    sample = sample_frame(docs, labels, "quality", held_out(4, 2), max_rows, max_bytes)
    rows = T.map_batches(sample.select("doc_id", "y", "text"), run, "doc_id long, y int, x array<double>").collect()
    rows = sorted(rows, key=lambda r: r.doc_id)
    x = np.array([r.x for r in rows]).reshape(len(rows), len(NAMES))
    return grow(x, np.array([r.y for r in rows], dtype=np.float64))


def _scores(batch: pa.RecordBatch, forest: Forest) -> np.ndarray:
    parts = [forest.score(statistics(part)) for part in T.slices(batch.column("text"))]
    return np.concatenate(parts) if parts else np.zeros(0)


def scored(docs: DataFrame, forest: Forest) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(batch, forest))],
                                             names=["doc_id", "score"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return T.map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: the fold, the score and the decision."""
    return scored(docs, fit(docs, labels)).select(
        "doc_id", held_out(4, 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, training: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts; it learns from ``training``."""
    forest = fit(training, labels)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch, forest) >= THRESHOLD))
    return T.map_batches(docs, run, docs.schema)
