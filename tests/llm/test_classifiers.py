import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import crc, prose, vocabulary

from creditloom.llm import quality_trees as Q
from creditloom.llm import text as T
from creditloom.llm import toxicity as X


def quality_rows(n=400):
    rng, words = random.Random(2), vocabulary()
    docs, marks = [], []
    for i in range(n):
        text, good = prose(rng, words, rng.randint(5, 120)), i % 4 != 0
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", "$$$ "), (words[i % 9] + " ") * 40])
        docs.append((i, text))
        marks.append((i, int(good), 0))
    return docs, marks


def toxic_rows(n=900):
    rng, words = random.Random(4), vocabulary()
    stems = ["grumbl", "vexor"]
    docs, marks = [], []
    for i in range(n):
        w, bad = prose(rng, words, rng.randint(5, 80)).split(" "), i % 5 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(stems) + rng.choice(words)
        docs.append((i, " ".join(w)))
        marks.append((i, 1, int(bad)))
    return docs, marks


EDGES = [(5000, None), (5001, ""), (5002, " \n"), (None, "$$$ a b"), (5003, "word " * 30_000), (5004, "z" * 60_000)]


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy_and_edges(frame, labels, kind):
    module, rows, modulus, fold, least = ((Q, quality_rows, 4, 2, 0.97) if kind == "quality" else (X, toxic_rows, 5, 0, 0.9))
    docs, marks = rows()
    docs = docs + EDGES + docs[:3]
    marks = marks + [(None, 1, 1), (77777, 1, 1), (3, None, None)]
    got = module.digest(frame(docs), labels(marks)).collect()
    assert len(got) == len(docs)
    truth = {m[0]: m[1] if kind == "quality" else m[2] for m in marks[:-3]}
    threshold = 0.7 if kind == "quality" else 0.5
    right = []
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        assert r.held_out == (r.doc_id is not None and crc(r.doc_id, modulus) == fold)
        if r.held_out and r.doc_id in truth:
            right.append(r.predicted == truth[r.doc_id])
    assert np.mean(right) >= least
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert by_id[5000] == by_id[5001] and len(by_id[docs[0][0]]) == 1


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_labels_are_never_learnt(frame, labels, kind):
    module, rows, modulus, fold = (Q, quality_rows, 4, 2) if kind == "quality" else (X, toxic_rows, 5, 0)
    docs, marks = rows(60)
    flipped = [(i, 1 - q if crc(i, modulus) == fold else q, 1 - t if crc(i, modulus) == fold else t) for i, q, t in marks]
    runs = [{r.doc_id: r.score for r in module.digest(frame(docs), labels(m)).collect()} for m in (marks, flipped)]
    assert runs[0] == runs[1]


def test_without_labels(frame, labels):
    docs = [(1, "a b"), (2, None)]
    assert {r.score for r in Q.digest(frame(docs), labels([])).collect()} == {1.0}
    assert all(r.score < 1e-9 for r in X.digest(frame(docs), labels([])).collect())
    assert all(r.predicted == 1 for r in Q.digest(frame(docs), labels([(1, 1, 0), (2, 1, 0)] * 3)).collect())
    assert Q.digest(frame([]), labels([(1, 1, 1)])).count() == 0
    assert X.digest(frame([]), labels([(1, 1, 1)])).count() == 0


def test_sample_is_bounded(frame, labels):
    docs, marks = quality_rows(100)
    held = Q.held_out(4, 2)
    full = Q.labelled_sample(frame(docs), labels(marks), "quality", held, 1000, 1 << 20)
    assert len(full) == sum(crc(i, 4) != 2 for i, _ in docs)
    assert len(Q.labelled_sample(frame(docs), labels(marks), "quality", held, 10, 1 << 20)) == 10
    small = Q.labelled_sample(frame(docs), labels(marks), "quality", held, 1000, 2000)
    assert 0 < sum(len(t.encode()) for _, t in small) <= 2000


def test_long_texts_do_not_end_the_sample(frame, labels, monkeypatch):
    docs, marks = quality_rows(100)
    held, allowed = Q.held_out(4, 2), sum(crc(i, 4) != 2 for i, _ in docs)
    size = sum(len(t.encode()) for i, t in docs if crc(i, 4) != 2)
    for i in range(1000, 1040):
        docs.append((i, "w" * (size + 1)))
        marks.append((i, 1, 0))
    assert len(Q.labelled_sample(frame(docs), labels(marks), "quality", held, 1000, size)) == allowed
    # Texts that fit alone come after the others.
    monkeypatch.setattr(Q, "LONG_BYTES", size)
    for bound, extra in ((2 * size, 0), (2 * size + 1, 1)):
        assert len(Q.labelled_sample(frame(docs), labels(marks), "quality", held, 1000, bound)) == allowed + extra


def test_keep_good_keeps_columns(frame, labels):
    docs, marks = quality_rows(200)
    kept = Q.keep_good(frame(docs), frame(docs), labels(marks))
    assert kept.columns == frame(docs).columns
    accepted = {r.doc_id for r in Q.digest(frame(docs), labels(marks)).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == accepted and 140 <= len(accepted) <= 155


def test_flat_traversal_equals_recursive_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    forest = Q.grow(x, y)

    def walk(row, tree, node=0, level=0):
        if level == Q.DEPTH:
            return forest.leaf[tree][node - (2 ** Q.DEPTH - 1)]
        i = forest.statistic[tree][node]
        right = int(sum(row[i] > forest.edges[i]) > forest.bin[tree][node])
        return walk(row, tree, 2 * node + 1 + right, level + 1)

    total = [forest.start + sum(walk(r, t) for t in range(len(forest.leaf))) for r in x]
    assert np.allclose(forest.score(x), 1 / (1 + np.exp(-np.array(total))))
    assert ((forest.score(x) > 0.5) == y).mean() > 0.97


def test_ngrams_of_words():
    part = next(T.slices(pa.array(["ab ü", "abcd"])))
    found = T.words(part.data, part.bounds, T.SPACED)
    word, bucket = X.ngrams(part.data, found)
    marked = [b"\x02" + w.encode() + b"\x03" for w in ("ab", "ü", "abcd")]
    want = {(k, m[i:i + n]) for k, m in enumerate(marked) for n in X.NGRAMS for i in range(len(m) - n + 1)}
    assert len(word) == len(want)
    shared = set(bucket[word == 0]) & set(bucket[word == 2])
    assert len(shared) == 1  # the start mark and "ab"


def test_every_split_is_the_best_of_all():
    """Exhaustive search over all statistics and cuts at every node, on real-valued gradients."""
    rng = np.random.default_rng(5)
    n, width = 120, 3
    x = np.round(rng.normal(size=(n, width)), 1)
    bins = np.stack([np.searchsorted(np.unique(x[:, i]), x[:, i]) for i in range(width)], axis=1)
    gradient, weight = rng.normal(size=n) + (x[:, 1] > 0.3), rng.uniform(0.1, 0.3, n)
    statistic, cut, leaf, at = Q._tree(bins + np.arange(width) * Q.BINS, bins, gradient, weight)

    def term(rows):
        return sum(gradient[i] for i in rows) ** 2 / (sum(weight[i] for i in rows) + Q.RIDGE)

    def check(node, rows):
        if node >= 2 ** Q.DEPTH - 1:
            g, h = sum(gradient[i] for i in rows), sum(weight[i] for i in rows)
            assert leaf[node - (2 ** Q.DEPTH - 1)] == pytest.approx(-Q.RATE * g / (h + Q.RIDGE))
            assert all(at[i] == node - (2 ** Q.DEPTH - 1) for i in rows)
            return
        gains = {}
        for s in range(width):
            for c in range(Q.BINS):
                low, high = [i for i in rows if bins[i, s] <= c], [i for i in rows if bins[i, s] > c]
                if min(sum(weight[i] for i in low), sum(weight[i] for i in high)) >= Q.MIN_WEIGHT:
                    gains[s, c] = term(low) + term(high) - term(rows)
        best = max(gains.values(), default=0)
        if best > 1e-6:
            assert gains[int(statistic[node]), int(cut[node])] == pytest.approx(best)
        low = [i for i in rows if bins[i, statistic[node]] <= cut[node]]
        check(2 * node + 1, low)
        check(2 * node + 2, [i for i in rows if i not in set(low)])

    check(0, list(range(n)))


def test_statistics_equal_plain_python():
    texts = ["Ab ab  AB|!\nab ab ab\n\nab ab ab", "", " \n", "x", "Füße 12,5 $#? «q» a.b", "one two three one two three\none two three"]
    got = Q.statistics(next(T.slices(pa.array(texts))))
    for row, text in zip(got, texts):
        data, words = text.encode(), [w.encode() for w in text.split()]
        n, size = max(1, len(words)), max(1, len(data))
        lengths, lines = [len(w) for w in words] or [0], [line for line in text.split("\n") if line]
        triples = list(zip(words, words[1:], words[2:]))
        mean = sum(map(len, words)) / n
        count = lambda chars: sum(b in chars for b in data)
        share = lambda items: len(set(items)) / max(1, len(items))
        want = [np.log1p(len(data)), np.log1p(len(words)), mean,
                np.sqrt(max(0.0, sum(len(w) ** 2 for w in words) / n - mean ** 2)), np.log1p(max(lengths)),
                count(Q.SYMBOLS) / n, count(b"!?") / n, count(b"|") / n, count(bytes(range(65, 91))) / size, count(b"0123456789") / size,
                count(b".,;:-'\"()") / n, sum(b > 127 for b in data) / size, count(b"\n") / n, share(words),
                sum(a == b for a, b in zip(words, words[1:])) / n, share(triples), 1 - share(lines),
                np.log1p(len(words) / max(1, len(lines)))]
        assert row == pytest.approx(want, abs=1e-9), text


def test_forward_pass_equals_plain_python():
    rng = np.random.default_rng(8)
    model = X.Model(rng.normal(size=1 << X.BITS), -0.7)

    def bucket(gram):
        code = int.from_bytes(gram, "little") + len(gram) - 1
        return (code * int(X._HASH) % 2 ** 64) >> (64 - X.BITS)

    def plain(text):
        values = []
        for word in text.lower().split():
            marked = b"\x02" + word.encode() + b"\x03"
            grams = [marked[i:i + n] for n in X.NGRAMS for i in range(len(marked) - n + 1)]
            values.append(sum(model.bucket[bucket(g)] for g in grams) / len(grams))
        z = [np.mean(values[i:i + X.SPAN]) for i in range(0, len(values), X.SPAN)]
        if not z:
            return 1 / (1 + np.exp(-model.bias))
        weight = np.exp(X.SHARPNESS * (np.array(z) - max(z)))
        return 1 / (1 + np.exp(-(model.bias + float(weight @ z / weight.sum()))))

    texts = ["", "a", "one TWO three", "Grüße an alle und noch mehr", "x " * 50 + "grumbler"]
    part = next(T.slices(pa.array(texts)))
    assert X.score(part.data, part.bounds, model) == pytest.approx([plain(t) for t in texts], rel=1e-9)


def test_gradient_of_the_pooling_equals_differences():
    rng = np.random.default_rng(9)
    z, text = rng.normal(size=7), np.array([0, 0, 0, 1, 2, 2, 2])
    pooled, weight = X._pooled(z, text, 3)
    claimed = weight * (1 + X.SHARPNESS * (z - pooled[text]))
    for j in range(len(z)):
        up, down = z.copy(), z.copy()
        up[j] += 1e-6
        down[j] -= 1e-6
        slope = (X._pooled(up, text, 3)[0] - X._pooled(down, text, 3)[0]) / 2e-6
        assert slope == pytest.approx(claimed[j] * (np.arange(3) == text[j]), abs=1e-6)
