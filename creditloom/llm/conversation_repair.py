"""Repair of the turn structure of conversations at the least cost.

A repaired conversation has role initials ``(s?(ua)+)?``. The edits of its rows, in
order, are K keep (cost 0), R rerole to user or assistant (1), D delete (2; required
for blank and duplicate rows) and I insert an empty turn of user or assistant (5); a
truncated row that is not deleted adds 5. The edits span a lattice of (rows consumed,
state of the pattern), in which a letter leads to one node only. Dijkstra's search runs
from both ends, always on the side whose heap has the smaller top, until the two tops
exceed the best crossing together and both have settled their last cost in full. Every
cheapest path then crosses from a node settled from the front to one settled from the
back, and the least audit is read along the edges that lie on such paths.

Rows are sorted over all partitions, so a long conversation is spread over tasks. What
lies whole in one task, in at most ``BLOCK`` rows, is repaired there. Of other
conversations each task solves its blocks between any two states of the pattern; the
blocks of a conversation are joined from the back by cost, then audit, without their
texts (at most sixteen audits of a block). Two audits of a block between the same
states and of the same cost never begin with one another, so the least ones join to the
least. The texts then pass in order through the hash of the result, which is sequential,
and are not gathered.

Defined results: null role or text is one space. Rows of one turn are in the order of a
hash of role and text, equal rows next to each other. Rows without a conversation are
left out. Extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm import text as T
from creditloom.llm.components import stored
from creditloom.llm.turns import in_order, numbered, runs

#: Rows and bytes of text of a block.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
#: States of the pattern: 0 at the start, 1 after a system turn, 2 after user, 3 after assistant.
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
ACCEPTED = (0, 3)
LEGAL = ("su", "ua", "au")


def _edges(signs: str, node: tuple[int, int]) -> Iterator[tuple[str, int, tuple[int, int]]]:
    """Letter, cost and end of the edits that may follow at a node of the lattice, by letter."""
    i, q = node
    if i < len(signs):
        yield "D", DELETE, (i + 1, q)
    yield "I", INSERT, (i, NEXT[q])
    if i < len(signs) and signs[i] != "x":
        more = TRUNCATED if signs[i].isupper() else 0
        sign = signs[i].lower()
        if sign == ROLE[q][0]:
            yield "K", more, (i + 1, NEXT[q])
        elif sign == "s" and q == 0:
            yield "K", more, (i + 1, 1)
        yield "R", REROLE + more, (i + 1, NEXT[q])


def _back(signs: str, node: tuple[int, int]) -> Iterator[tuple[int, tuple[int, int]]]:
    """Cost and start of the edits that end at a node."""
    i, q = node
    starts = [(i, p) for p in range(4) if NEXT[p] == q]
    if i:
        starts += [(i - 1, p) for p in range(4)]
    for start in starts:
        for _, cost, end in _edges(signs, start):
            if end == node:
                yield cost, start


class _Search:
    """Dijkstra's search from one end: nodes with their final costs, and a heap."""

    def __init__(self, starts):
        self.done: dict[tuple[int, int], int] = {}
        self.label = dict.fromkeys(starts, 0)
        self.heap = [(0, s) for s in starts]
        self.level = 0

    @property
    def top(self) -> float:
        while self.heap and self.heap[0][1] in self.done:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self, around) -> tuple[int, tuple[int, int]]:
        cost, node = heappop(self.heap)
        self.done[node], self.level = cost, cost
        for step, other in around(node):
            if other not in self.done and cost + step < self.label.get(other, float("inf")):
                self.label[other] = cost + step
                heappush(self.heap, (cost + step, other))
        return cost, node


@functools.lru_cache(maxsize=1 << 16)
def solve(signs: str, start: int = 0, ends: tuple[int, ...] = ACCEPTED) -> tuple[int, str] | None:
    """Least cost and least audit of the edits from state ``start`` to one of ``ends``; None if there are none.

    ``signs``: for each row s, u, a or o (another initial), upper case where truncated, or x where it must go.
    """
    front, back = _Search([(0, start)]), _Search([(len(signs), q) for q in ends])
    ahead = lambda node: ((cost, end) for _, cost, end in _edges(signs, node))
    behind = functools.partial(_back, signs)
    best = float("inf")
    while front.top + back.top <= best and min(front.top, back.top) < float("inf"):
        one, other, around = (front, back, ahead) if front.top <= back.top else (back, front, behind)
        cost, node = one.settle(around)
        best = min(best, cost + other.label.get(node, float("inf")))
    if best == float("inf"):
        return None
    for one, around in ((front, ahead), (back, behind)):  # all crossings of this cost
        while one.top <= one.level:
            one.settle(around)
    first: dict[tuple[int, int], tuple[str, tuple[int, int]] | None] = {}
    for node in sorted(front.done, key=lambda x: (-x[0], -front.done[x])):
        here = front.done[node]
        if here == best and node[0] == len(signs) and node[1] in ends:
            first[node] = None
            continue
        for letter, cost, end in _edges(signs, node):
            onward = end in first and front.done[end] == here + cost
            if onward or back.done.get(end, float("inf")) == best - here - cost:
                first[node] = letter, end
                break
    audit, node = [], (0, start)
    while first.get(node):
        letter, node = first[node]
        audit.append(letter)
    while node[0] < len(signs) or back.done[node]:
        letter, node = next((letter, end) for letter, cost, end in _edges(signs, node)
                            if back.done.get(end, float("inf")) == back.done[node] - cost)
        audit.append(letter)
    return int(best), "".join(audit)


def edited(audit: str, q: int, rows: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Role and text of the turns that the edits leave, from state ``q`` on."""
    rows = iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        after = 1 if letter == "K" and role[:1] == "s" else NEXT[q]
        yield role if letter == "K" else ROLE[q], text
        q = after


_STATS = ("blank", "duplicate", "truncated", "illegal")
_BLOCKS = ("conv_id long, part int, seq int, whole boolean, gaps long, " + ", ".join(f"{s} long" for s in _STATS)
           + ", cost long, audit string, repaired_sha256 string, low long, high long, turns long,"
           " first string, last string, costs array<long>, audits array<string>, roles array<string>, texts array<string>")


def _signs(rows) -> tuple[str, dict[str, int]]:
    """What each row (turn, role, text, repeated) allows, and the number of rows by fault."""
    signs, count = [], dict.fromkeys(_STATS, 0)
    for _, role, text, repeated in rows:
        said = text.rstrip(BLANKS)
        fault = "blank" if not said else "duplicate" if repeated else "truncated" if said[-1] not in ".!?" else None
        if fault:
            count[fault] += 1
        sign = role[:1] if role[:1] in ("s", "u", "a") else "o"
        signs.append("x" if fault in ("blank", "duplicate") else sign.upper() if fault else sign)
    count["illegal"] = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(rows, rows[1:]))
    return "".join(signs), count


def _lines_hash(lines) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text in lines).encode()).hexdigest()


def _block(conv_id, part, seq, rows, whole: bool, texts: bool) -> dict:
    signs, found = _signs(rows)
    turns = [t for t, *_ in rows if t is not None]
    found |= {"conv_id": conv_id, "part": part, "seq": seq, "whole": whole, "turns": len(set(turns)),
              "low": turns[0] if turns else None, "high": turns[-1] if turns else None,
              "first": rows[0][1][:1] if rows else None, "last": rows[-1][1][:1] if rows else None}
    said = [(role, text) for _, role, text, _ in rows]
    if whole:
        found["cost"], found["audit"] = solve(signs)
        found["gaps"] = turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0
        found["repaired_sha256"] = _lines_hash(edited(found["audit"], 0, said))
    else:
        between = [solve(signs, q, (r,)) for q in range(4) for r in range(4)]
        found["costs"], found["audits"] = ([x and x[k] for x in between] for k in (0, 1))
    if texts or not whole:
        found["roles"], found["texts"] = ([x[k] for x in said] for k in (0, 1))
    return found


def _to_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in list(kinds.items())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(","))])


def _blocks(texts: bool):
    """Blocks of sorted rows. The first and the last conversation of a task may go on in others."""
    schema = _arrow(_BLOCKS)

    def run(batches):
        part = TaskContext.get().partitionId()
        held, size, seq, conv, before, is_first = [], 0, 0, None, None, True
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            columns = [batch.column(c).to_pylist() for c in ("turn", "role", "text", "said", "again", "gone")]
            bounds, out = [*runs(ids).tolist(), len(ids)], []
            for low, high in zip(bounds, bounds[1:]):
                if ids[low] != conv:
                    if conv is not None:
                        out.append(_block(conv, part, seq, held, not (is_first or seq), texts))
                        is_first = False
                    conv, held, size, seq, before = int(ids[low]), [], 0, 0, None
                for turn, role, text, said, again, gone in zip(*(c[low:high] for c in columns)):
                    if gone:
                        continue
                    if len(held) >= BLOCK or size >= BLOCK_BYTES:
                        out.append(_block(conv, part, seq, held, False, texts))
                        held, size, seq = [], 0, seq + 1
                    held.append((turn, role, text, again or before == (turn, said)))
                    size += len(text)
                    before = turn, said
            if out:
                yield _to_batch(out, schema)
        if conv is not None:
            yield _to_batch([_block(conv, part, seq, held, False, texts)], schema)
    return run


class _Rest:
    """The cheapest edits of the blocks from one on: own audit, then those of ``then``."""

    def __init__(self, cost: int, audit: str, q: int, then: _Rest | None):
        self.cost, self.audit, self.q, self.then = cost, audit, q, then

    def before(self, other: _Rest) -> bool:
        """Whether it costs less or, at equal cost, has the lesser audit over all blocks."""
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b, i, j = self, other, 0, 0
        while a is not None and b is not None and not (a is b and i == j):
            n = min(len(a.audit) - i, len(b.audit) - j)
            x, y = a.audit[i:i + n], b.audit[j:j + n]
            if x != y:
                return x < y
            i, j = i + n, j + n
            if i == len(a.audit):
                a, i = a.then, 0
            if j == len(b.audit):
                b, j = b.then, 0
        return a is None and b is not None


def _joined(table: pa.Table) -> pa.Table:
    """For the blocks of one conversation: the state before each, and its part of the best audit."""
    blocks = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    after: dict[int, _Rest | None] = dict.fromkeys(ACCEPTED)
    for block in reversed(blocks):
        now = {}
        for q in range(4):
            for r, then in after.items():
                if (cost := block["costs"][4 * q + r]) is None:
                    continue
                rest = _Rest(cost + (then.cost if then else 0), block["audits"][4 * q + r], q, then)
                if q not in now or rest.before(now[q]):
                    now[q] = rest
        after = now
    rest, out = after[0], []
    for block in blocks:
        out.append({c: block[c] for c in ("conv_id", "part", "seq")} | {
            "q": rest.q, "chosen": rest.audit, "spent": rest.cost - (rest.then.cost if rest.then else 0)})
        rest = rest.then
    return pa.Table.from_pylist(out, schema=_arrow(_CHOSEN))


_CHOSEN = "conv_id long, part int, seq int, q int, chosen string, spent long"
_REPORT = ("conv_id long, gaps long, " + ", ".join(f"{s} long" for s in _STATS)
           + ", cost long, audit string, repaired_sha256 string")


def _assemble(batches):
    """One report of the blocks of each conversation, which follow each other in order."""
    schema, now = _arrow(_REPORT), None

    def done():
        turns = now["high"] - now["low"] + 1 - now["turns"] if now["low"] is not None else 0
        return _to_batch([now | {"gaps": turns, "audit": "".join(now["audits"]),
                                 "repaired_sha256": now["sha"].hexdigest()}], schema)
    for batch in batches:
        for row in batch.to_pylist():
            if now is None or row["conv_id"] != now["conv_id"]:
                if now is not None:
                    yield done()
                now = {"conv_id": row["conv_id"], "low": None, "high": None, "turns": 0, "cost": 0, "audits": [],
                       "sha": hashlib.sha256(), "lines": 0, "last": None, **dict.fromkeys(_STATS, 0)}
            for s in _STATS:
                now[s] += row[s]
            if row["first"] is not None:
                now["illegal"] += now["last"] is not None and now["last"] + row["first"] not in LEGAL
                now["last"] = row["last"]
            if row["low"] is not None:
                now["turns"] += row["turns"] - (now["high"] == row["low"])
                now["low"] = row["low"] if now["low"] is None else now["low"]
                now["high"] = row["high"]
            now["cost"] += row["spent"]
            now["audits"].append(row["chosen"])
            for role, text in edited(row["chosen"], row["q"], list(zip(row["roles"], row["texts"]))):
                now["sha"].update(("\n" * (now["lines"] > 0) + f"{role}:{text}").encode())
                now["lines"] += 1
    if now is not None:
        yield done()


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by a hash of conversation and turn; dropped rows stay as ``gone``."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.col("conv_id").cast("string"), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), space))) % 20
    role, text = (F.coalesce(F.col(c), space) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), kind.alias("kind"),
        role.alias("role"), text.alias("text"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
                       .otherwise(F.col("text")).alias("text"), (F.col("kind") == 0).alias("gone"))


def _solved(rows: DataFrame, texts: bool) -> tuple[DataFrame, DataFrame]:
    """Blocks of the rows, and the chosen edits of those that are not whole conversations."""
    said = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    rows = rows.select("conv_id", "turn", "role", "text", "gone", said.alias("said"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    # Rows that repeat one of another turn; repeats within a turn lie next to each other.
    again = (rows.where("NOT gone").groupBy("conv_id", "said").agg(F.min(order).alias("begin"), F.max(order).alias("end"))
             .where("begin != end").select("conv_id", "said", "begin"))
    rows = (rows.join(stored(again, "again"), ["conv_id", "said"], "left")
            .withColumn("again", F.coalesce(order > F.col("begin"), F.lit(False))).drop("begin"))
    blocks = stored(T.map_batches(in_order(rows, "turn", "said"), _blocks(texts), _BLOCKS), "blocks")
    parts = blocks.where("NOT whole").select("conv_id", "part", "seq", "costs", "audits")
    return blocks, stored(parts.groupBy("conv_id").applyInArrow(_joined, _CHOSEN), "chosen")


def report(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, gone): faults, cost, audit, hash of the result."""
    blocks, chosen = _solved(rows, texts=False)
    whole = blocks.where("whole").select(*(f.split()[0] for f in _REPORT.split(",")))
    parts = (blocks.where("NOT whole").drop("audit", "cost", "costs").join(chosen, ["conv_id", "part", "seq"])
             .repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq"))
    return whole.unionByName(T.map_batches(parts, _assemble, _REPORT))


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, turn (from 1), role, text."""
    blocks, chosen = _solved(rows, texts=True)
    kept = blocks.select("conv_id", "part", "seq", "audit", "roles", "texts").join(chosen, ["conv_id", "part", "seq"], "left")
    schema = "conv_id long, part int, seq int, at int, role string, text string"

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                audit = row["audit"] if row["chosen"] is None else row["chosen"]
                turns = edited(audit, row["q"] or 0, list(zip(row["roles"], row["texts"])))
                yield _to_batch([{**row, "at": at, "role": role, "text": text} for at, (role, text) in enumerate(turns)],
                                _arrow(schema))
    turns = T.map_batches(kept, run, schema)
    rows, _ = numbered(turns.withColumnRenamed("part", "task"), "task", "seq", "at")
    return rows.select("conv_id", F.col("i").alias("turn"), "role", "text")


def digest(conversations: DataFrame) -> DataFrame:
    """The report of the damaged conversations."""
    return report(damaged(conversations))
