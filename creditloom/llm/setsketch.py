"""Near-duplicate detection with SetSketch registers.

A sketch holds, for each of ``M`` registers, the smallest of exponentially
distributed values of the shingles on an exponential scale: K = floor(1 - log_B x),
truncated to 0..Q+1. Sketches merge by taking maxima, and equal registers grow
likelier with the Jaccard similarity. Bands of ``ROWS`` registers propose pairs; the
numbers of larger, equal and smaller registers give the maximum-likelihood
similarity jointly with the known set sizes, and pairs that may reach the threshold
are confirmed on their full shingle sets. At similarity 0.85 a pair shares a band of
four registers with probability 0.52, so 20 bands miss it with probability 4e-7.

Documents of equal sets form a class that is compared once, through its smallest
id. A bucket of classes that share a band doesn't propose all its pairs. Its pivot,
the class with most company over all its bands, is compared with every other; for
near copies of one text that is the text itself, and those links already join them
up. A pair of two others matters only if one of them, the outsider, is not linked
to the pivot. Such pairs are found by their sets: shingles are put in an order in
which those that the pivot lacks come first, and two sets of similarity
``percent`` must share one of their first few shingles in any order that both
follow (how few depends on both sizes). What an outsider has of its own then
decides whom it meets. Bitmaps of what each set lacks of the pivot and has beyond it
bound the intersection from above where they meet, which leaves out chance meetings
of near copies.

Outsiders may be a large family themselves. A place, that is a group and a leading
shingle, at which more than ``FEW`` outsiders would meet more than ``FEW`` members
doesn't propose their pairs but elects a new pivot, the outsider with most company, and
compares all who are there with it; those linked to it are joined up, and the others are
searched in the same way against the new pivot. Every family is so compared with a few of its members, however many
families there are in a bucket. Where a new pivot links less than a quarter of those it is
compared with, there is no such family around it, and the others meet pair by pair within
the bound of the bitmaps. The outsiders of a group so shrink by a quarter at least each
time, which bounds the number of rounds by a logarithm. No pair that shares a band is lost.

Defined results: null and wordless texts have an empty set and no links. Rows of
one id are one node. Rows without an id are never linked; their component is null
and they are kept. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm import text as T
from creditloom.llm.components import components, stored

SHINGLE = 5
BANDS, ROWS = 20, 4
M = BANDS * ROWS
BASE, RATE, Q = 1.001, 20.0, (1 << 16) - 2
#: Sizes within about 2 % are one class.
SIZE_CLASSES = 50
#: Standard deviations that an estimate may lie below the threshold.
SLACK = 5.0
#: A place where at most so many of one side meet the others compares them all.
FEW = 32
#: A new pivot must link at least one in so many of those it is compared with for another one to follow.
PRODUCTIVE = 4

_SALT = T.mix(np.arange(1, M + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_FACTOR = T.mix(_SALT) | np.uint64(1)


def shingle_sets(part: T.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of the distinct shingles of a slice, ordered by both."""
    found = T.words(T.LOWER[part.data], part.bounds, T.SPACED)
    return T.distinct(*T.shingles(found, SHINGLE))


def sketch(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Registers (uint16, one row per set) of the sets that begin at ``begins``; none may be empty."""
    least = np.empty((len(begins), M), dtype=np.uint64)
    for i in range(M):
        least[:, i] = np.minimum.reduceat((hashes ^ _SALT[i]) * _FACTOR[i], begins)
    share = (least >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54
    value = np.floor(1.0 - np.log(-np.log1p(-share) / RATE) / np.log(BASE))
    return np.clip(value, 0, Q + 1).astype(np.uint16)


def merge(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(first, second)


_GRID = np.linspace(0.0, 1.0, 101)


def estimate(larger: np.ndarray, smaller: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Most likely similarity, given the numbers of registers larger in a and in b, and both set sizes."""
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    best = np.minimum(u / v, v / u)[:, None]
    j = np.minimum(_GRID[None, :], best)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    a, b = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    tiny = 1e-12
    loglik = (larger[:, None] * np.log(np.maximum(a, tiny)) + smaller[:, None] * np.log(np.maximum(b, tiny))
              + (M - larger - smaller)[:, None] * np.log(np.maximum(1 - a - b, tiny)))
    return np.take_along_axis(j, loglik.argmax(axis=1)[:, None], axis=1)[:, 0]


def _sketcher(batches):
    for batch in batches:
        for part in T.slices(batch.column("text")):
            n = part.high - part.low
            rows, hashes = shingle_sets(part)
            size = np.bincount(rows, minlength=n)
            full = np.flatnonzero(size)
            begins = np.searchsorted(rows, full)
            low, high = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
            registers = np.zeros((n, M), dtype=np.uint16)
            if len(full):
                low[full] = np.add.reduceat(T.mix(hashes ^ np.uint64(0x51)), begins)
                high[full] = np.add.reduceat(T.mix(hashes ^ np.uint64(0xC3)), begins)
                registers[full] = sketch(hashes, begins)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(part.low, n), batch.column("ref").slice(part.low, n), pa.array(size, pa.int64()),
                 pa.array(low.view(np.int64)), pa.array(high.view(np.int64)),
                 pa.array([r.tobytes() for r in registers], pa.binary())],
                names=["doc_id", "ref", "n_shingles", "low", "high", "registers"])


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id``, a hash of the text (``ref``), ``n_shingles``, a 128-bit hash of the set and ``registers``."""
    return T.map_batches(_referred(docs), _sketcher,
                         "doc_id long, ref long, n_shingles long, low long, high long, registers binary")


def _referred(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("ref"), "text")


def _with_nodes(named: DataFrame) -> DataFrame:
    """Rows with their ``node``: the id, or a number beyond all ids for the further texts of an id."""
    several = (named.groupBy("doc_id").agg(F.min("ref").alias("first"), F.max("ref").alias("last"))
               .where("first != last"))
    further = (named.join(several, "doc_id").where("ref != first").select("doc_id", "ref").distinct()
               .withColumn("number", F.monotonically_increasing_id()))
    further = stored(further, "further")
    if further.isEmpty():
        return named.withColumn("node", F.col("doc_id"))
    beyond = 1 + named.agg(F.max("doc_id")).first()[0]
    return (named.join(further, ["doc_id", "ref"], "left")
            .withColumn("node", F.coalesce(F.col("number") + beyond, "doc_id")).drop("number"))


def _bander(batches):
    for batch in batches:
        registers = np.frombuffer(b"".join(batch.column("registers").to_pylist()), dtype=np.uint16)
        bands = registers.reshape(-1, BANDS, ROWS).astype(np.uint64)
        code = np.zeros(bands.shape[:2], dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for i in range(ROWS):
            code = T.mix(code * np.uint64(0x2545F4914F6CDD1D) + bands[:, :, i])
        ids = np.repeat(batch.column("id").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(code.reshape(-1).view(np.int64)), pa.array(ids)],
                                         names=["band", "id"])


def _likely(threshold: float):
    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, M)
                    for c in ("registers_a", "registers_b"))
            n_a, n_b = (batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
            if not len(n_a):
                continue
            found = estimate((a > b).sum(axis=1), (a < b).sum(axis=1), n_a, n_b)
            least = threshold - SLACK * np.sqrt(threshold * (1 - threshold) / M)
            keep = np.array(batch.column("keep").to_pylist(), dtype=bool)
            yield batch.select(["a", "b"]).filter(pa.array(keep | (found >= least)))
    return run


def _needed(n, m, percent: int):
    """Least intersection of sets of n and m shingles that are similar enough."""
    return -(-percent * (n + m) // (100 + percent))


def _size_class(n):
    return np.floor(np.log(n) * SIZE_CLASSES).astype(np.int64)


#: Of a set against its pivot: the pivot's size, the number of shingles beyond it, and
#: bitmaps of 128 bits of the shingles lacked and of those beyond it.
AGAINST = ("p", "beyond", "lack0", "lack1", "more0", "more1")


def _bitmap(hashes: np.ndarray) -> list[int]:
    words = [0, 0]
    for bit in np.unique(hashes >> np.uint64(57)).tolist():
        words[bit >> 6] |= 1 << (bit & 63)
    return [w - (1 << 64) if w >> 63 else w for w in words]


def _verifier(percent: int, leading: bool):
    """Exact decision on pairs (a, b); with ``leading`` also what the search for the rest needs of b.

    That is its size, ``AGAINST`` the pivot a, and its leading shingles, those that a lacks first.
    """
    def run(batches):
        for batch in batches:
            # Both sides in one column, so that a slice holds the texts of whole pairs.
            both = [t for pair in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())
                    for t in pair]
            n = batch.num_rows
            step = max(1, int(n * T.SLICE_BYTES / max(1, batch.nbytes)))
            for low in range(0, n, step):
                high = min(n, low + step)
                texts = pa.array(both[2 * low:2 * high], pa.large_string())
                part = next(T.slices(texts, 1 << 62))
                rows, hashes = shingle_sets(part)
                size = np.bincount(rows, minlength=2 * (high - low))
                union = np.bincount(T.distinct(rows // 2, hashes)[0], minlength=high - low)
                linked = 100 * (size[::2] + size[1::2] - union) >= percent * union
                columns = [batch.column(c).slice(low, high - low) for c in ("a", "b")] + [pa.array(linked)]
                if leading:
                    at = np.concatenate([[0], np.cumsum(size)])
                    first, against = [], []
                    for i in range(high - low):
                        pivot, own = hashes[at[2 * i]:at[2 * i + 1]], hashes[at[2 * i + 1]:at[2 * i + 2]]
                        shared = np.isin(own, pivot, assume_unique=True)
                        order = np.concatenate([own[~shared], own[shared]])
                        lacked = pivot[~np.isin(pivot, own, assume_unique=True)]
                        against.append([len(pivot), int((~shared).sum()), *_bitmap(lacked), *_bitmap(own[~shared])])
                        first.append(order[:len(own) - -(-percent * len(own) // 100) + 1].tobytes())
                    columns += [pa.array(size[1::2]), pa.array(first, pa.binary())]
                    columns += [pa.array(c, pa.int64()) for c in zip(*against)]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["a", "b", "linked", *(["n", "leading", *AGAINST] if leading else [])])
    return run


def _entries(percent: int | None):
    """Leading shingles of sets, one row each, under the size classes in which they may meet someone.

    Without ``percent`` the set's own class (to be met), else all classes that it may look into, each
    with as many of the shingles as the least size in it asks for.
    """
    def run(batches):
        for batch in batches:
            known = [batch.column(c).to_numpy() for c in ("a", "b", "n", *AGAINST)]
            for row, first in zip(zip(*known), batch.column("leading").to_pylist()):
                shingle, n = np.frombuffer(first, dtype=np.int64), int(row[2])
                classes, counts = _reach(n, len(shingle), percent)
                position = np.concatenate([np.arange(k) for k in counts] or [np.zeros(0, dtype=np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shingle[position]), pa.array(np.repeat(classes, counts).astype(np.int64)),
                     pa.array(position.astype(np.int64)), *(pa.array(np.full(len(position), v)) for v in row)],
                    names=["shingle", "size_class", "i", "pivot", "id", "n", *AGAINST])
    return run


_ENTRIES = "shingle long, size_class long, i long, pivot long, id long, n long, " + ", ".join(f"{c} long" for c in AGAINST)


def _reach(n: int, leading: int, percent: int | None) -> tuple[list[int], list[int]]:
    """Size classes, and how many leading shingles to show in each."""
    if percent is None:
        return [int(_size_class(n))], [leading]
    least, classes, counts = max(1, -(-percent * n // 100)), [], []
    for c in range(int(_size_class(least)), int(_size_class(max(1, 100 * n // percent))) + 1):
        m = max(least, int(np.floor(np.exp(c / SIZE_CLASSES))))  # not above the class's least size
        reach = min(leading, n - int(_needed(n, m, percent)) + 1)
        if reach > 0:
            classes.append(c)
            counts.append(reach)
    return classes, counts


def _sided(frame: DataFrame, s: str) -> DataFrame:
    return frame.select(*(F.col(c).alias(f"{c}_{s}" if c != "id" else s) for c in frame.columns))


def _sketched(pairs: DataFrame, classes: DataFrame, percent: int, keep: str = "false") -> DataFrame:
    """The pairs (a, b) whose estimate leaves the threshold possible, or for which ``keep`` holds."""
    sized = classes.select("id", F.col("n_shingles").alias("n"), "registers")
    both = (pairs.join(_sided(sized, "a"), "a").join(_sided(sized, "b"), "b")
            .where(f"{keep} OR 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
            .select("a", "b", F.expr(keep).alias("keep"), "n_a", "n_b", "registers_a", "registers_b"))
    return T.map_batches(both, _likely(percent / 100), "a long, b long")


def _with_texts(pairs: DataFrame, classes: DataFrame, texts: DataFrame, few: bool = False) -> DataFrame:
    """``text_a`` and ``text_b`` of stored pairs; only the texts that occur in pairs are moved twice.

    Of ``few`` pairs the ids are stored, so that Spark knows their size and need not move texts for them.
    """
    needed = (pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
              .join(classes.select("id", "doc_id", "ref"), "id"))
    needed = stored(needed, "needed") if few else needed
    texts = stored(texts.join(needed, ["doc_id", "ref"]).dropDuplicates(["doc_id", "ref"]).select("id", "text"), "texts")
    return (pairs.join(_sided(texts, "a"), "a").join(_sided(texts, "b"), "b").select("a", "b", "text_a", "text_b"))


def _compared(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, few: bool = False) -> DataFrame:
    """Exact decisions on pairs of a pivot and a member, and what the search for other pairs needs."""
    return stored(T.map_batches(_with_texts(pairs, classes, texts, few), _verifier(percent, True),
                                "a long, b long, linked boolean, n long, leading binary, "
                                + ", ".join(f"{c} long" for c in AGAINST)), "compared")


#: A place where members meet: a group, a leading shingle, a class of sizes.
PLACE = ["pivot", "shingle", "size_class"]


def _meeting(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Entries of the outsiders of groups, and of all members to be met by them."""
    wanted = [F.col("grp").alias("a"), "b", "n", "leading", *AGAINST]
    return (T.map_batches(rows.where("NOT linked").select(wanted), _entries(percent), _ENTRIES),
            T.map_batches(rows.select(wanted), _entries(None), _ENTRIES))


def _elected(rows: DataFrame, crowded: DataFrame, percent: int) -> DataFrame:
    """Pairs (grp, a, b) of the new pivots of crowded places with all who are there.

    A pivot is the outsider with most company; places of one group that elect the same
    pivot become one new group.
    """
    probes, index = (x.select(*PLACE, "id").join(crowded, PLACE) for x in _meeting(rows, percent))
    there = stored(probes.select("*", F.lit(True).alias("outsider")).unionByName(
        index.select("*", F.lit(False).alias("outsider"))), "there")
    company = there.where("outsider").groupBy("pivot", "id").agg(F.sum(F.col("n_probes") + F.col("n_index")).alias("company"))
    pivots = (there.where("outsider").join(company, ["pivot", "id"]).groupBy(*PLACE)
              .agg(F.max(F.struct("company", (-F.col("id")).alias("id"))).alias("p")).select(*PLACE, (-F.col("p.id")).alias("a")))
    return stored(there.join(pivots, PLACE).where("id != a").select(
        F.xxhash64("pivot", "a").alias("grp"), "a", F.col("id").alias("b")).distinct(), "elected")


def _found(groups: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join up all similar members of groups (grp, pivot a, member b, linked and ``AGAINST`` a)."""
    needed = f"ceil({percent} * (x.n + y.n) / {100 + percent})"
    in_pivot = "x.p - bit_count(x.lack0 | y.lack0) - bit_count(x.lack1 | y.lack1)"
    beyond = "least({0}, {1})".format(*(
        f"{s}.beyond - bit_count({s}.more0 & ~{t}.more0) - bit_count({s}.more1 & ~{t}.more1)" for s, t in ("xy", "yx")))
    links, met, crowd = groups.where("linked").select("a", "b"), None, f"outsiders > {FEW}"
    while True:
        tally = groups.groupBy("grp").agg(F.count("*").alias("members"), F.count_if(~F.col("linked")).alias("outsiders"))
        rows = groups.join(tally.where("members > 1 AND outsiders > 0"), "grp")
        probes, index = _meeting(rows, percent)
        # Where few are on one side all meet; where many are on both, one of them becomes a pivot.
        many = [x.groupBy(*PLACE).agg(F.count("*").alias(n)).where(f"{n} > {FEW}") for x, n in zip(
            _meeting(rows.where(crowd), percent), ("n_probes", "n_index"))]
        crowded = stored(many[0].join(many[1], PLACE), "crowded")
        last = crowded.isEmpty()
        if not last:
            probes = probes.join(crowded, PLACE, "left_anti")
        close = (probes.alias("x").join(index.alias("y"), F.expr(
            f"x.pivot = y.pivot AND x.shingle = y.shingle AND x.size_class = y.size_class AND x.id != y.id"
            f" AND x.n - x.i >= {needed} AND y.n - y.i >= {needed} AND {in_pivot} + {beyond} >= {needed}"))
            .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
        close = stored(_sketched(close, classes, percent), "met")
        met = close if met is None else met.unionByName(close)
        if last:
            break
        pairs = _elected(rows.where(crowd), crowded, percent)
        groups = pairs.join(_compared(pairs.select("a", "b").distinct(), classes, texts, percent, few=True), ["a", "b"])
        links = links.union(groups.where("linked").select("a", "b"))
        crowd = f"outsiders > {FEW} AND {PRODUCTIVE} * (members - outsiders) >= members"
    if met.isEmpty():
        return links
    more = T.map_batches(_with_texts(met.distinct(), classes, texts), _verifier(percent, False), "a long, b long, linked boolean")
    return links.union(more.where("linked").select("a", "b"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``."""
    every = stored(sketches(docs), "sketches")
    named = _with_nodes(every.where("doc_id IS NOT NULL AND n_shingles > 0"))
    equal = stored(named.groupBy("low", "high", "n_shingles").agg(F.min("node").alias("id")), "classes")
    classes = (named.join(equal.select("id"), F.col("node") == F.col("id"))
               .groupBy("id", "doc_id", "ref", "n_shingles").agg(F.max("registers").alias("registers")))
    classes = stored(classes, "representatives")
    texts = _referred(docs).where("text IS NOT NULL")

    members = T.map_batches(classes.select("id", "registers"), _bander, "band long, id long").distinct()
    members = stored(members, "bands")
    counts = members.groupBy("band").agg(F.count("*").alias("company")).where("company > 1")
    shared = stored(members.join(counts, "band"), "shared")
    central = shared.groupBy("id").agg(F.sum("company").alias("company"))
    pivots = (shared.select("band", "id").join(central, "id")
              .groupBy("band").agg(F.max(F.struct("company", (-F.col("id")).alias("id"))).alias("p"))
              .select("band", (-F.col("p.id")).alias("a")))
    # A pair that has no third in any bucket needs no more than its estimate to be dropped.
    pairs = (shared.join(pivots, "band").where("id != a").groupBy("a", F.col("id").alias("b"))
             .agg(F.max("company").alias("company")))
    pairs = stored(_sketched(pairs, classes, percent, "company > 2"), "pairs")
    compared = _compared(pairs, classes, texts, percent)
    links = _found(compared.withColumn("grp", F.col("a")), classes, texts, percent)

    # An id with several texts is one node: it joins the classes of all of them.
    own = named.select("doc_id", "low", "high").join(equal.drop("n_shingles"), ["low", "high"])
    leaders = stored(own.groupBy("doc_id").agg(F.min("id").alias("id"), F.max("id").alias("last")), "leaders")
    several = leaders.where("id != last").select("doc_id", F.col("id").alias("b"))
    links = links.union(own.join(several, "doc_id").where("id != b").select("id", "b"))
    groups = components(links)
    leaders = (leaders.join(groups, "id", "left")
               .select(F.col("doc_id").alias("_doc"), F.coalesce("component", "id").alias("component_id")))
    return every.join(leaders, F.col("doc_id") == F.col("_doc"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document with the smallest id of its group; the one of that id is kept."""
    return near_duplicates(docs).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those of a group other than its smallest id.

    Repeats of one id and text go too, the row with the least other columns stays; different
    texts of an id stay together.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", whole)
    gone = near_duplicates(docs).where("doc_id != component_id").select(F.col("doc_id").alias("id")).distinct()
    order = [F.col("whole").getField(c) for c, kind in docs.dtypes if c != "text" and not kind.startswith("map")]
    number = F.row_number().over(Window.partitionBy("id", "text").orderBy(*order))
    named = (rows.where("id IS NOT NULL").join(gone, "id", "left_anti").withColumn("nth", number).where("nth = 1"))
    return named.select("whole.*").unionByName(docs.where("doc_id IS NULL"))
