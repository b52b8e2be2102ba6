import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import prose, vocabulary

from creditloom.llm import setsketch as S
from creditloom.llm import text as T
from creditloom.llm.components import components

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    least = {}
    nodes = {i: i for i, _ in docs if i is not None}

    def root(x):
        while nodes[x] != x:
            x = nodes[x]
        return x

    for a, (i, _) in enumerate(docs):
        for b in range(a):
            j = docs[b][0]
            if i is not None and j is not None and sets[a] and sets[b]:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    x, y = root(i), root(j)
                    nodes[max(x, y)] = min(x, y)
    for k, (i, _) in enumerate(docs):
        component = None if i is None else root(i)
        least.setdefault((str(i), len(sets[k]), component, i is None or component == i), 0)
        least[(str(i), len(sets[k]), component, i is None or component == i)] += 1
    return least


def result(frame):
    found = {}
    for r in frame.collect():
        key = (str(r.doc_id), r.n_shingles, r.component_id, r.kept)
        found[key] = found.get(key, 0) + 1
    return found


def chain():
    """Near copies at all distances, with neighbours in a chain linked and its ends not."""
    rng, words = random.Random(3), vocabulary()
    text, rows = prose(rng, words, 300).split(" "), []
    for i in range(300, 360):
        rows.append((i, " ".join(text)))
        for _ in range(rng.randint(1, 8)):
            text[rng.randrange(300)] = rng.choice(words)
    return rows


def test_equals_brute_force(frame, corpus):
    docs = corpus + chain() + [(400, "Alpha BETA gamma"), (401, "alpha beta GAMMA"), (402, "alpha beta")]
    assert result(S.digest(frame(docs).repartition(3))) == brute(docs)


def test_near_copies_beyond_their_pivot(frame):
    """Copies with few to many edits of one text, some of them near copies of an edited copy."""
    rng, words = random.Random(17), vocabulary()
    text, docs = prose(rng, words, 150).split(" "), []

    def edited(source, n):
        out = list(source)
        for _ in range(n):
            out[rng.randrange(len(out))] = rng.choice(words)
        return out

    for i in range(0, 240, 4):
        copy = edited(text, rng.randint(0, 6))
        docs += [(i, " ".join(copy)), (i + 1, " ".join(edited(copy, rng.randint(0, 3)))),
                 (i + 2, " ".join(copy[rng.randint(0, 20):])), (i + 3, " ".join(edited(text, 3) + copy[:rng.randint(0, 30)]))]
    want = brute(docs)
    assert result(S.digest(frame(docs))) == want
    assert 5 < sum(k[3] for k in want) < 200


def families(n, nested):
    """Families of ``n`` near copies each that share bands: 200 words, a second and third family with 20 other words each."""
    rng, words, docs = random.Random(5), vocabulary(), []
    base = prose(rng, words, 200).split(" ")
    for k in range(3 if nested else 2):
        for _ in range(n):
            copy = list(base)
            copy[rng.randrange(200)] = rng.choice(words)
            docs.append((len(docs), " ".join(copy)))
        for at in rng.sample(range(200), 20):
            base[at] = f"other{k}{at}"
    return docs


def _met(frame, docs, monkeypatch):
    """The result's number of groups, and how many pairs were proposed."""
    pairs = {}

    def counted(found, name, *more):
        found = stored(found, name, *more)
        pairs[name] = pairs.get(name, 0) + (found.count() if name in ("met", "elected", "pairs") else 0)
        return found

    stored = S.stored
    with monkeypatch.context() as patch:
        patch.setattr(S, "stored", counted)
        kept = S.digest(frame(docs)).where("kept").count()
    return kept, sum(pairs.values())


@pytest.mark.parametrize("nested", [False, True])
def test_large_families_in_one_bucket_do_not_meet_pair_by_pair(frame, monkeypatch, nested):
    small, large = (_met(frame, families(n, nested), monkeypatch) for n in (60, 240))
    assert small[0] == large[0] == 3 - (not nested)
    assert large[1] < 8 * 240 * (2 + nested)


def test_families_equal_brute_force(frame, monkeypatch):
    monkeypatch.setattr(S, "FEW", 2)
    docs = families(25, True)
    assert result(S.digest(frame(docs))) == brute(docs)
    docs = chain()
    assert result(S.digest(frame(docs))) == brute(docs)


def test_empty_tables(frame):
    assert S.digest(frame([])).count() == 0
    assert result(S.digest(frame([(1, None), (2, "")]))) == {("1", 0, 1, True): 1, ("2", 0, 2, True): 1}


def test_one_of_each_group_stays(frame, corpus):
    left = S.keep_one(frame(corpus))
    assert left.columns == frame(corpus).columns
    ids = [r.doc_id for r in left.collect()]
    want = {int(k[0]) for k in brute(corpus) if k[3] and k[0] != "None"}
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert sum(i is None for i in ids) == sum(i is None for i, _ in corpus)


def test_different_texts_of_an_id_stay(frame, corpus):
    texts = [t for i, t in corpus if i is not None and i < 60]
    docs = [(7, t) for t in texts] + [(7, texts[0])] * 3 + [(7, None)] * 2 + [(8, "other words here")]
    left = sorted((r.doc_id, r.text or "") for r in S.keep_one(frame(docs)).collect())
    assert left == sorted([(7, t) for t in set(texts)] + [(7, ""), (8, "other words here")])


def test_keep_one_with_clashing_names(frame):
    docs = frame([(1, "a b"), (1, "a b"), (2, "a b"), (None, "a b")]).selectExpr(
        "*", "1 AS _nth", "2 AS _gone", "3 AS nth", "4 AS whole")
    left = S.keep_one(docs)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "None"]


def _sketch(values):
    part = T.mix(np.array(sorted(values), dtype=np.uint64))
    return S.sketch(part, np.zeros(1, dtype=np.int64))[0]


def test_sketches_merge_and_estimate():
    errors = []
    for seed in range(30):
        base = seed * 100_000
        a, b = set(range(base, base + 900)), set(range(base + 50, base + 1000))
        assert (S.merge(_sketch(a), _sketch(b)) == _sketch(a | b)).all()
        x, y = _sketch(a), _sketch(b)
        got = S.estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([900.0]), np.array([950.0]))[0]
        errors.append(got - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.2


def test_shingle_sets_are_sets_of_words():
    texts = ["a b c d e f A B C D E", "x", "", "a  b\tc\nd e"]
    part = next(T.slices(pa.array(texts)))
    rows, _ = S.shingle_sets(part)
    assert np.bincount(rows, minlength=4).tolist() == [len(shingles(t)) for t in texts]


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(200, 200), (301, 300)]
    rng.shuffle(edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 180)}, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
