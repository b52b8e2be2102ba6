import itertools

import numpy as np
import pytest

from creditloom.llm import packing as P
from creditloom.llm.token_store import VOCABULARY, read_ranks, tokenizer


def optimum(lengths, sizes):
    """Least cost over all partitions of a few pieces."""
    best = float("inf")
    for assignment in itertools.product(range(len(lengths)), repeat=len(lengths)):
        loads = {}
        for b, n in zip(assignment, lengths):
            loads[b] = loads.get(b, 0) + n
        if max(loads.values()) <= max(sizes):
            best = min(best, sum(min(P.linear_cost(s) for s in sizes if s >= n) for n in loads.values()))
    return best


@pytest.mark.parametrize("seed", range(8))
def test_near_the_optimum_of_small_cases(seed):
    rng = np.random.default_rng(seed)
    lengths, sizes = rng.integers(1, 60, 6), (16, 32, 64)
    bins, capacities = P.best_fit(lengths, sizes, P.linear_cost)
    for b, capacity in enumerate(capacities):
        used = lengths[bins == b].sum()
        assert 0 < used <= capacity == min(s for s in sizes if s >= used)
    assert sum(map(P.linear_cost, capacities)) <= 1.35 * optimum(lengths.tolist(), sizes)


def test_smaller_sizes_are_used_when_sequences_get_dear():
    lengths = np.full(64, 100)
    _, linear = P.best_fit(lengths, (128, 1024), P.linear_cost)
    _, square = P.best_fit(lengths, (128, 1024), lambda c: c * c)
    assert set(square) == {128} and set(linear) == {1024, 512}.intersection(linear) | {1024}


@pytest.mark.parametrize("block", [P.BLOCK, 7])
def test_every_token_is_packed_once(frame, corpus, block):
    sizes = (64, 256, 1024)
    bins = P.pack(frame(corpus).repartition(3), sizes, block=block).collect()
    assert len({b.bin for b in bins}) == len(bins)
    spans = {}
    for b in bins:
        assert b.used == sum(m.length for m in b.members) <= b.capacity == min(s for s in sizes if s >= b.used)
        assert b.n_members == len(b.members)
        for m in b.members:
            spans.setdefault(m.doc_id, []).append((m.start, m.length, m.piece))
    want, encode = {}, tokenizer(read_ranks(VOCABULARY))
    for doc, text in corpus:
        if n := len(encode(text or "")):
            want.setdefault(doc, []).extend((s, min(1024, n + 1 - s), i) for i, s in enumerate(range(0, n + 1, 1024)))
    assert {d: sorted(s) for d, s in spans.items()} == {d: sorted(s) for d, s in want.items()}


def test_text_without_blanks_is_cut(frame):
    text = "".join(chr(0x4E00 + i * 37 % 20_000) for i in range(50_000))
    bins = P.pack(frame([(1, text), (2, "a"), (3, "")])).collect()
    pieces = sorted((m.start, m.length) for b in bins for m in b.members if m.doc_id == 1)
    assert len(pieces) > 12 and all(n == 4096 for _, n in pieces[:-1])
    assert sum(n for _, n in pieces) == len(tokenizer(read_ranks(VOCABULARY))(text)) + 1
    assert {m.doc_id for b in bins for m in b.members} == {1, 2}


def test_empty_table(frame):
    assert P.pack(frame([])).count() == 0
