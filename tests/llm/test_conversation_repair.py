import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from creditloom.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, part int, seq int, gone string, said long, cost int, audit int, q int"
EXTRA = (1, 2, "g", 3, 4, 5, 6)


@pytest.fixture
def talk(spark):
    return lambda rows: spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def cheapest(rows):
    """Least cost and audit, and the turns left, from all audits that are cheapest up to some row and state."""
    every = [(0, 0, "", [])]
    for role, text, fault in rows:
        every, now = _with_insertions(every), []
        for q, cost, audit, lines in every:
            now.append((q, cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            want = "assistant" if q == 2 else "user"
            to = 3 if q == 2 else 2
            if role[:1] == want[0]:
                now.append((to, cost + more, audit + "K", lines + [(role, text)]))
            elif role[:1] == "s" and q == 0:
                now.append((1, cost + more, audit + "K", lines + [(role, text)]))
            now.append((to, cost + 1 + more, audit + "R", lines + [(want, text)]))
        every = _pruned(now)
    every = [x for x in _with_insertions(every) if x[0] in (0, 3)]
    return min((cost, audit, lines) for _, cost, audit, lines in every)


def _with_insertions(every):
    out = list(every)
    for q, cost, audit, lines in every:
        for _ in range(2):
            role = "assistant" if q == 2 else "user"
            q, cost, audit, lines = 3 if q == 2 else 2, cost + 5, audit + "I", lines + [(role, "")]
            out.append((q, cost, audit, lines))
    return out


def _pruned(every):
    """Without those that cost more than the cheapest of their state."""
    least = defaultdict(lambda: 10 ** 9)
    for q, cost, *_ in every:
        least[q] = min(least[q], cost)
    return [x for x in every if x[1] == least[x[0]]]


def brute(rows):
    conversations = defaultdict(list)
    for c, turn, role, text in rows:
        if c is None:
            continue
        kept = conversations[c]
        kind = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        said = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
        kept += [(turn is not None, turn or 0, said, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for c, kept in conversations.items():
        kept.sort()
        seen, faults = set(), []
        for *_, role, text in kept:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else
                          "truncated" if said[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for known, t, *_ in kept if known]
        illegal = sum(a[3][:1] + b[3][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, lines = cheapest([(k[3], k[4], f) for k, f in zip(kept, faults)])
        roles = "".join(r[:1] for r, _ in lines)
        assert re.fullmatch("(s?(ua)+)?", roles)
        yield (c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"),
               faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
               hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())


def check(frame, rows):
    got = sorted(map(tuple, R.digest(frame).collect()))
    assert got == sorted(brute(rows))


def conversations(rng, n, longest):
    texts = ["Yes.", "No!", "and", "", " ", "Why? ", "é.", None]
    for c in range(n):
        for turn in range(rng.randint(1, longest)):
            yield (c, rng.choice([turn, turn, turn, 2 * turn, None]),
                   rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(texts))


def exhaustive(signs, start, ends):
    """All paths of the lattice with at most two insertions in a row."""
    found = []

    def walk(i, q, cost, audit):
        if i == len(signs) and q in ends:
            found.append((cost, audit))
        if len(audit) < 2 or not audit.endswith("II"):
            walk(i, R.NEXT[q], cost + 5, audit + "I")
        if i < len(signs):
            walk(i + 1, q, cost + 2, audit + "D")
            sign, more = signs[i].lower(), 5 * signs[i].isupper()
            if sign != "x":
                if sign == R.ROLE[q][0]:
                    walk(i + 1, R.NEXT[q], cost + more, audit + "K")
                if sign == "s" and q == 0:
                    walk(i + 1, 1, cost + more, audit + "K")
                walk(i + 1, R.NEXT[q], cost + more + 1, audit + "R")
    walk(0, start, 0, "")
    return min(found, default=None)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_search_finds_the_least_of_all_paths(n):
    for signs in itertools.product("suaSUox", repeat=n):
        assert R.solve("".join(signs)) == exhaustive(signs, 0, (0, 3))


@given(st.text("suaoSUAx", max_size=5), st.integers(0, 3), st.integers(0, 3))
@settings(max_examples=150, deadline=None)
def test_search_between_any_states(signs, start, end):
    assert R.solve(signs, start, (end,)) == exhaustive(signs, start, (end,))


@given(st.lists(st.text("suaoSUAx", max_size=12), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_blocks_join_to_the_whole(parts):
    import pyarrow as pa
    rows = [R._to_batch([{"conv_id": 1, "part": 0, "seq": k, **{
        name: [x and x[j] for x in (R.solve(p, q, (r,)) for q in range(4) for r in range(4))]
        for j, name in enumerate(("costs", "audits"))}}], R._arrow(R._BLOCKS)) for k, p in enumerate(parts)]
    joined = R._joined(pa.Table.from_batches(rows)).to_pylist()
    whole = R.solve("".join(parts))
    assert (sum(x["spent"] for x in joined), "".join(x["chosen"] for x in joined)) == whole


def test_report_matches_brute_force(talk):
    rows = list(conversations(random.Random(5), 300, 9))
    rows += [(None, 1, "user", "x"), (900, None, None, None), (901, -3, "assistant", "a" * 100_000)]
    check(talk(rows).repartition(6), rows)


@pytest.mark.parametrize("block", [1, 3, 7])
def test_long_conversations_in_blocks(talk, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    rng = random.Random(block)
    rows = list(conversations(rng, 12, 30))
    rows += [(50, t, "user", f"{t}.") for t in range(70)] + [(51, 1, "user", "same.")] * 5
    check(talk(rows).repartition(30), rows)


def test_repaired_turns(talk):
    rows = [(1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "tool", "Yes."), (2, 1, "assistant", "."), (3, 1, "user", "")]
    frame = talk(rows).selectExpr("conv_id", "turn", "role", "text", "false AS gone")
    got = sorted(map(tuple, R.repaired(frame).collect()))
    assert got == [(1, 1, "user", "Hi."), (1, 2, "assistant", "Yes.")]
    assert {r.conv_id: (r.cost, r.audit) for r in R.report(frame).collect()} == {1: (3, "KDR"), 2: (2, "D"), 3: (2, "D")}


def test_empty(talk):
    assert R.digest(talk([])).count() == 0
