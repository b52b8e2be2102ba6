"""Toxicity: averaged subword embeddings into a linear softmax, trained jointly in numpy.

A word is the average of the vectors of its character n-grams (3 to 5 bytes of
UTF-8, with marks for its start and end, hashed into buckets), a passage of
``SPAN`` words the average of its words, and a linear softmax of two classes scores
the passage. A text is scored by its passages pooled with weights that favour the
most toxic one, so that a few words in a long text aren't averaged away; embeddings,
softmax and pooled score are trained together by gradient steps. As n-grams of
misspelt or inflected words overlap with those seen, their vectors do too.

For scoring, the softmax is folded into the embeddings, which leaves one number
per bucket; whole texts are scored in slices.

Labels are learnt from a bounded sample (``MAX_ROWS`` labelled documents outside the
held-out fold, ``MAX_BYTES`` of text), as for the quality classifier.

Defined results: null and wordless texts get the score of the bias alone; without
any usable label every score is 0; rows without an id are scored and never held
out or learnt from. Extra columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm import text as T
from creditloom.llm.quality_trees import held_out, labelled_sample

#: Bounds of the training sample.
MAX_ROWS, MAX_BYTES = 8_000, 32 << 20
BITS, WIDTH, NGRAMS, SPAN = 16, 8, (3, 4, 5), 2
BATCH, STEPS, RATE, DECAY, SHARPNESS = 128, 300, 0.1, 1e-4, 4.0
#: An n-gram of fewer training texts keeps a zero vector.
MIN_TEXTS = 5
THRESHOLD = 0.5

_START, _END = 0x02, 0x03
_HASH = np.uint64(0x9E3779B97F4A7C15)


def ngrams(data: np.ndarray, found: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word and bucket of every character n-gram of the words of a slice, by word for each length."""
    size = found.end - found.start
    place = np.cumsum(size + 2) - (size + 2)  # where each marked word starts
    total = int((size + 2).sum())
    marked = np.zeros(total + max(NGRAMS), dtype=np.uint64)
    marked[place] = _START
    marked[place + size + 1] = _END
    offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    marked[np.repeat(place + 1, size) + offset] = data[np.repeat(found.start, size) + offset]
    word = np.repeat(np.arange(len(size)), size + 2)
    stop = (place + size + 2)[word]
    at = np.arange(total)
    words, buckets = [], []
    code = np.zeros(total, dtype=np.uint64)
    for i in range(max(NGRAMS)):
        code = code | (marked[i:total + i] << np.uint64(8 * i))
        if i + 1 in NGRAMS:
            inside = np.flatnonzero(at + i + 1 <= stop)
            words.append(word[inside])
            buckets.append((((code[inside] + np.uint64(i)) * _HASH) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(words), np.concatenate(buckets)


class Model(NamedTuple):
    """What each bucket adds to the log-odds, and the bias."""

    bucket: np.ndarray
    bias: float


def _spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage of each word, and text of each passage."""
    n = -(-counts // SPAN)
    text = np.repeat(np.arange(len(counts)), n)
    first = np.cumsum(n) - n
    offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(first, counts) + offset // SPAN, text


def _pooled(z: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean of the passages of each text, and the weights (a softmax of the passages' scores)."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, text, z)
    weight = np.exp(SHARPNESS * (z - top[text]))
    weight /= np.bincount(text, weight, minlength=n)[text]
    return np.bincount(text, weight * z, minlength=n), weight


def score(data: np.ndarray, bounds: np.ndarray, model: Model) -> np.ndarray:
    data = T.LOWER[data]
    found = T.words(data, bounds, T.SPACED)
    n = len(bounds) - 1
    total = np.full(n, model.bias)
    if len(found.start):
        word, bucket = ngrams(data, found)
        size = np.bincount(word, minlength=len(found.start))
        value = np.bincount(word, model.bucket[bucket], minlength=len(found.start)) / size
        span, text = _spans(found.counts)
        z = np.bincount(span, value) / np.bincount(span)
        total += _pooled(z, text, n)[0]
    return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


class _Sample(NamedTuple):
    """The training texts as distinct words: n-grams of each word, words of each text."""

    first: np.ndarray   # by distinct word: where its n-grams start, one entry more
    bucket: np.ndarray
    text_first: np.ndarray
    word: np.ndarray


def _sample(texts: list[str]) -> _Sample:
    seen: dict[int, int] = {}
    firsts, buckets, words, counts, at = [np.zeros(1, dtype=np.int64)], [], [], [], 0
    for part in T.slices(pa.array(texts, pa.large_string())):
        data = T.LOWER[part.data]
        found = T.words(data, part.bounds, T.SPACED)
        kinds, index, inverse = np.unique(found.hash, return_index=True, return_inverse=True)
        new = np.array([seen.setdefault(int(k), len(seen)) for k in kinds], dtype=np.int64)
        fresh = np.flatnonzero(new >= at)
        order = fresh[np.argsort(new[fresh])]
        chosen = index[order]
        word, bucket = ngrams(data, T.Words(found.start[chosen], found.end[chosen], found.first, found.hash[chosen]))
        by = np.argsort(word, kind="stable")
        firsts.append(firsts[-1][-1] + np.cumsum(np.bincount(word, minlength=len(chosen))))
        buckets.append(bucket[by])
        words.append(new[inverse].astype(np.int32))
        counts.append(found.counts)
        at = len(seen)
    return _Sample(np.concatenate(firsts), np.concatenate(buckets),
                   np.concatenate([[0], np.cumsum(np.concatenate(counts))]), np.concatenate(words))


def _texts_with(sample: _Sample) -> np.ndarray:
    """Number of training texts that each bucket occurs in."""
    texts = np.zeros(1 << BITS, dtype=np.int64)
    for a, b in zip(sample.text_first[:-1], sample.text_first[1:]):
        kinds = np.unique(sample.word[a:b])
        size = sample.first[kinds + 1] - sample.first[kinds]
        grams = sample.bucket[np.arange(int(size.sum())) + np.repeat(sample.first[kinds] - (np.cumsum(size) - size), size)]
        texts[np.unique(grams)] += 1
    return texts


def train(rows: list[tuple[int, str]], steps: int = STEPS, seed: int = 7) -> Model:
    """Fit embeddings and softmax to (label, text) rows."""
    y = np.array([label for label, _ in rows], dtype=np.float64)
    if not len(y):
        return Model(np.zeros(1 << BITS), -60.0)
    start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if y.sum() in (0, len(y)):
        return Model(np.zeros(1 << BITS), start)
    sample = _sample([t for _, t in rows])
    random = np.random.default_rng(seed)
    common = (_texts_with(sample) >= MIN_TEXTS)[:, None]
    table = (random.normal(0, 0.1, (1 << BITS, WIDTH)) * common).astype(np.float32)
    out = random.normal(0, 1, (WIDTH, 2)).astype(np.float32)
    bias = np.array([0.0, start])
    squares = [np.full(p.shape, 1e-8) for p in (table, out, bias)]
    length = np.diff(sample.first)
    for step in range(steps):
        if step % max(1, -(-len(y) // BATCH)) == 0:
            order = random.permutation(len(y))
        at = step % max(1, -(-len(y) // BATCH)) * BATCH
        chosen = order[at:at + BATCH]
        counts = sample.text_first[chosen + 1] - sample.text_first[chosen]
        chosen, counts = chosen[counts > 0], counts[counts > 0]
        if not len(chosen):
            continue
        tokens = np.concatenate([sample.word[sample.text_first[i]:sample.text_first[i + 1]] for i in chosen])
        kinds, inverse = np.unique(tokens, return_inverse=True)
        size = length[kinds]
        begin = np.cumsum(size) - size
        grams = sample.bucket[np.arange(int(size.sum())) + np.repeat(sample.first[kinds] - begin, size)]
        vector = np.add.reduceat(table[grams], begin, axis=0) / size[:, None]
        span, text = _spans(counts)
        in_span = np.bincount(span)
        passage = np.add.reduceat(vector[inverse], np.cumsum(in_span) - in_span, axis=0) / in_span[:, None]
        z = passage @ (out[:, 1] - out[:, 0])
        pooled, weight = _pooled(z, text, len(chosen))
        p = 1 / (1 + np.exp(-np.clip(pooled + bias[1] - bias[0], -60, 60)))
        error = p - y[chosen]
        dz = error[text] * weight * (1 + SHARPNESS * (z - pooled[text]))
        d_out = passage.T @ dz
        d_word = (dz / in_span)[span]
        per_kind = np.bincount(inverse, d_word, minlength=len(kinds)) / size
        d_gram = np.bincount(grams, np.repeat(per_kind, size), minlength=1 << BITS)
        d_table = d_gram[:, None] * (out[:, 1] - out[:, 0])[None, :] / len(chosen) * common + DECAY * table
        grads = (d_table, np.stack([-d_out, d_out], axis=1) / len(chosen),
                 np.array([-error.mean(), error.mean()]))
        for parameter, gradient, square in zip((table, out, bias), grads, squares):
            square += gradient ** 2
            parameter -= RATE * gradient / np.sqrt(square)
    return Model((table @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    return train(labelled_sample(docs, labels, "toxic", held_out(5, 0), max_rows, max_bytes))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    def run(batches):
        for batch in batches:
            parts = [score(part.data, part.bounds, model) for part in T.slices(batch.column("text"), T.SLICE_BYTES // 2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(parts) if parts else np.zeros(0))],
                names=["doc_id", "score"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return T.map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: the fold, the score and the decision."""
    return scored(docs, fit(docs, labels)).select(
        "doc_id", held_out(5, 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
