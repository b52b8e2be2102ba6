import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from creditloom.llm import prefix_trie as P
from creditloom.llm.turns import numbered

SCHEMA = "conv_id long, turn long, role string, text string, c long, i int, n string, k0 long, d string, block int, part long"
EXTRA = (1, 2, "n", 4, "d", 6, 7)


@pytest.fixture
def talk(spark):
    return lambda rows: spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, said, (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        value = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += value
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        yield (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
               hashlib.sha256(ends.encode()).hexdigest())


def check(frame, rows):
    got = sorted(map(str, map(tuple, P.trie(frame).collect())))
    assert got == sorted(map(str, brute(rows)))


def conversations(rng, n, longest):
    words = ["ja", "nein", "vielleicht", "", None, "é" * 7]
    for c in rng.sample(range(3 * n), n):
        for turn in range(rng.randint(1, longest)):
            yield c, turn, ["user", "assistant"][turn % 2], rng.choice(words)


def test_short_conversations(talk):
    rows = list(conversations(random.Random(1), 200, 6))
    check(talk(rows).repartition(5), rows)


@pytest.mark.parametrize("band,block", [(2, 8), (3, 27), (4, 1 << 16)])
def test_deep_conversations_over_bands_and_blocks(talk, monkeypatch, band, block):
    monkeypatch.setattr(P, "BAND", band)
    monkeypatch.setattr(P, "BLOCK", block)
    rng = random.Random(band)
    rows = list(conversations(rng, 30, 12))
    long = [(turn, "user", rng.choice("ab")) for turn in range(90)]
    for c in (10_000, 10_001, 10_007, 10_010):
        rows += [(c, *t) for t in long[:rng.randint(40, 90)]]
    check(talk(rows).repartition(5), rows)


def test_nulls_ties_repeats_and_missing_groups(talk):
    rows = [(7, None, "user", "x"), (7, None, "user", "y"), (7, 3, None, None), (7, 3, "a", "b"), (7, 3, "a", "b"),
            (None, 1, "user", "lost"), (5, 1, "user", "q"), (11, -4, "system", "z"), (11, None, "u", ""), (-3, 1, "u", "t"),
            (0, 0, "u", "t"), (2, 0, "u", "t"), (2, 0, "ut", "")]
    check(talk([r for r in rows if r[0] is None or r[0] >= 0]), [r for r in rows if r[0] is None or r[0] >= 0])
    assert P.trie(talk(rows)).where("depth = 0").first()["conv_id"] == -3


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_copies_of_one_conversation(talk, monkeypatch, chunk):
    monkeypatch.setattr(P, "CHUNK", chunk)
    rows = [(5 * c, t, "user", f"turn {t}") for c in range(300) for t in range(3)]
    check(talk(rows), rows)


def test_empty(talk):
    assert P.trie(talk([])).count() == 0


def test_numbers_of_a_conversation_over_partitions(talk, spark):
    frame = talk([(c, t, "user", "x") for c, n in ((1, 3), (2, 900), (3, 2)) for t in range(n)])
    rows, sizes = numbered(frame.select("conv_id", "turn").repartition(40), "turn")
    assert rows.where(F.col("i") != F.col("turn") + 1).count() == 0 and rows.count() == 905
    assert sorted(map(tuple, sizes.collect())) == [(1, 3), (2, 900), (3, 2)]
