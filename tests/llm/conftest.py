import random
import zlib

import pytest

#: Columns of documents plus names that operators use for results or internally.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, n_words int, kept int, "
          "shard string, slot int, spans string, ref int, doc string, id string, component string, level int, a int, b int")


@pytest.fixture
def frame(spark):
    """A documents table with extra columns from (doc_id, text) rows."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "s", None if t is None else len(t), 0.5, 1, 2, "x", 3, "y", 4, "z", "i", "c", 5, 6, 7)
             for i, t in rows], SCHEMA)
    return make


@pytest.fixture
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    return make


def vocabulary(seed=3, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghiklmnoprstué") for _ in range(rng.randint(1, 8))) for _ in range(n)]


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture
def corpus():
    """Random texts with exact and near copies, shared passages, odd white space and the edge cases."""
    rng, words = random.Random(11), vocabulary()
    rows = []
    shared = prose(rng, words, 60)
    for i in range(60):
        rows.append((i, prose(rng, words, rng.choice([1, 3, 9, 25, 80, 200]))))
    for i in range(60, 80):
        rows.append((i, prose(rng, words, 40) + "\n" + shared + "\t" + prose(rng, words, 30)))
    base = prose(rng, words, 150).split(" ")
    for i in range(80, 110):
        copy = list(base)
        copy[rng.randrange(150)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(i, " ".join(base)) for i in range(110, 130)]
    rows += [(130, None), (131, ""), (132, " \n\t "), (None, shared), (None, None), (None, shared),
             (133, prose(rng, words, 30_000)), (134, "w " * 500), (135, "Grüße  aus\x0bKöln\x0c!\r\n" * 30),
             (136, shared), (136, shared), (136, shared), (137, "a"), (137, shared + " b"), (138, "x" * 50_000)]
    return rows


def crc(value, modulus):
    return zlib.crc32(str(value).encode()) % modulus
