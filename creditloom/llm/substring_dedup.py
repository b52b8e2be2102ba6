"""Removal of repeated passages, found by level-wise doubling.

A window of ``length`` words is removable if its word sequence also starts
earlier. Levels of window lengths ``start``, 2 ``start``, ... ``length`` narrow down
where such windows can be: at each level below the last, a candidate window of
``length`` words is represented by the least-hashed of the level's windows inside
it, its anchor. Equal windows have equal anchors, so a candidate whose anchor occurs
once in the corpus goes; only documents with candidates left go on to twice the
length, until no candidates survive or ``length`` is reached, where candidates
themselves are compared and every occurrence but the first is marked.

Occurrences travel packed: a task folds the occurrences of a run of documents (a
window that is frequent leaves one entry per run), deals them to buckets by their
anchor, and buckets are sorted by numpy. The number of buckets grows with the text.

Defined results: null is an empty text. Rows of one id and text are one document
(copies of the row don't count as earlier); different texts of one id are ordered by
a hash of the text; a missing id is the smallest. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm import text as T
from creditloom.llm.components import stored

LENGTH, START = 20, 10
#: Words whose occurrences are folded in a task before they are sent on.
RUN_WORDS = 1 << 20
#: Bytes of text per bucket.
BUCKET_BYTES = 24 << 20

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[:len(values) - (width - span)], values[width - span:]) if width > span else values


def anchors(found: T.Words, level: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``length`` words (start, anchor), and the level's windows that are anchors (start, hash)."""
    n = len(found.hash)
    starts, _ = T.windows(found, length)
    at, hashes = T.windows(found, level)
    every = np.full(n, _TOP, dtype=np.uint64)
    every[at] = hashes
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none.view(np.uint64), none, none.view(np.uint64)
    width = length - level + 1
    least = _sliding(every, width, np.minimum)[starts]
    # A window of the level is an anchor if it is the least in some candidate that contains it.
    most = np.zeros(n + width - 1, dtype=np.uint64)
    most[starts + width - 1] = least
    most = _sliding(most, width, np.maximum)
    chosen = np.flatnonzero((most == every) & (every != _TOP))
    return starts, least, chosen, every[chosen]


def _candidates(found: T.Words, level: int, length: int, known: list) -> tuple[np.ndarray, np.ndarray]:
    """Start and anchor of the windows whose anchor is among the text's known ones; None knows them all."""
    starts, least, _, _ = anchors(found, level, length)
    sizes = [0 if k is None else len(k) for k in known]
    values = [k for k in known if k is not None and len(k)]
    if not len(starts) or not values:
        return starts[:0], least[:0]
    row = np.repeat(np.arange(len(known), dtype=np.uint64), sizes)
    allowed = T.mix(np.concatenate(values) + T.mix(row))
    mine = T.mix(least + T.mix(found.row[starts].astype(np.uint64)))
    inside = np.isin(mine, allowed)
    return starts[inside], least[inside]


def _known(column) -> list:
    """Lists of anchors as uint64 arrays."""
    return [None if v is None else np.array(v, dtype=np.int64).view(np.uint64) for v in column.to_pylist()]


_PACKED = pa.schema([("bucket", pa.int32()), ("name", pa.binary()), ("check", pa.binary()), ("doc", pa.binary()),
                     ("ref", pa.binary()), ("start", pa.binary()), ("count", pa.binary())])
_PACKED_SQL = "bucket int, name binary, check binary, doc binary, ref binary, start binary, count binary"


def _anchor_rows(buckets: int, level: int, length: int):
    """Anchors of the level by bucket: the name, and the reference of the document."""
    def flush(held):
        name, ref = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((ref, name))
        name, ref = name[order], ref[order]
        same = np.zeros(len(name) + 1, dtype=bool)
        same[1:-1] = name[1:] == name[:-1]
        repeated, first = same[1:] | same[:-1], ~same[:-1]
        # Repeated ones are known to be; two of each tell the bucket, the rest only come along once per document.
        again = repeated & ~first
        new = np.ones(len(name), dtype=bool)
        new[1:] = (name[1:] != name[:-1]) | (ref[1:] != ref[:-1])
        second = np.zeros(len(name), dtype=bool)
        second[1:] = again[1:] & first[:-1]
        direct = again & new & ~second
        yield from _dealt(first | second, T.mix(name) % np.uint64(buckets), 0, name=name, ref=ref)
        yield from _dealt(direct, T.mix(ref) % np.uint64(buckets), buckets, name=name, ref=ref)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            refs = batch.column("ref").to_numpy().view(np.uint64)
            for part in T.slices(batch.column("text")):
                found = T.words(part.data, part.bounds, T.SPACED)
                _, _, at, name = anchors(found, level, length)
                held.append((name, refs[part.low:part.high][found.row[at]]))
                size += len(found.hash)
                if size >= RUN_WORDS:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)
    return run


def _dealt(chosen: np.ndarray, bucket: np.ndarray, offset: int, **columns: np.ndarray):
    """Rows of packed columns, one per bucket that has entries; entries keep their order."""
    at = np.flatnonzero(chosen)
    if not len(at):
        return
    order = at[np.argsort(bucket[at], kind="stable")]
    sorted_buckets = bucket[order].astype(np.int64)
    cuts = np.flatnonzero(np.diff(sorted_buckets)) + 1
    edges = np.concatenate([[0], cuts, [len(order)]])
    out = {"bucket": pa.array((sorted_buckets[edges[:-1]] + offset).astype(np.int32))}
    for field in _PACKED.names[1:]:
        if field in columns:
            values = np.ascontiguousarray(columns[field][order])
            out[field] = pa.array([values[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())
        else:
            out[field] = pa.nulls(len(edges) - 1, pa.binary())
    yield pa.RecordBatch.from_arrays([out[f] for f in _PACKED.names], schema=_PACKED)


def _unpacked(table: pa.Table, **kinds) -> dict[str, np.ndarray]:
    return {field: np.frombuffer(b"".join(v for v in table.column(field).to_pylist() if v is not None), dtype=kind)
            for field, kind in kinds.items()}


def _repeated_anchors(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        got = _unpacked(table, name=np.uint64, ref=np.uint64)
        name, ref = got["name"], got["ref"]
        if table.column("bucket")[0].as_py() < buckets:
            order = np.lexsort((ref, name))
            name, ref = name[order], ref[order]
            same = np.zeros(len(name) + 1, dtype=bool)
            same[1:-1] = name[1:] == name[:-1]
            keep = same[1:] | same[:-1]
            name, ref = name[keep], ref[keep]
        return pa.table({"ref": pa.array(ref.view(np.int64)), "anchor": pa.array(name.view(np.int64))})
    return run


def _narrowed(level: int, length: int):
    """Finish the documents without candidates; the others keep their text and anchors."""
    def run(batches):
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            known = _known(columns["anchors"])
            for part in T.slices(columns["text"]):
                n = part.high - part.low
                found = T.words(part.data, part.bounds, T.SPACED)
                starts, _ = _candidates(found, level, length, known[part.low:part.high])
                left = np.zeros(n, dtype=bool)
                left[found.row[starts]] = True
                hashes = _kept_hashes(part, found, np.ones(len(found.hash), dtype=bool), ~left)
                flag = pa.array(left)
                empty = pa.nulls(n, pa.string())
                texts = columns["text"].slice(part.low, n).cast(pa.string())
                yield pa.RecordBatch.from_arrays([
                    columns["doc_id"].slice(part.low, n), columns["doc"].slice(part.low, n),
                    columns["ref"].slice(part.low, n), pa.array(found.counts), pa.array(hashes, pa.string()),
                    pa.compute.if_else(flag, texts, empty),
                    pa.array([k if ok else None for k, ok in zip(columns["anchors"].slice(part.low, n).to_pylist(), left)],
                             pa.list_(pa.int64()))], names=["doc_id", "doc", "ref", "n_words", "kept_sha256", "text", "anchors"])
    return run


def _kept_hashes(part: T.Slice, found: T.Words, kept: np.ndarray, wanted: np.ndarray) -> list[str | None]:
    """SHA-256 of the kept words of each wanted text, joined by one space."""
    take = np.zeros(len(part.data) + 1, dtype=np.int8)
    np.add.at(take, found.start[kept], 1)
    np.add.at(take, found.end[kept], -1)
    take = np.cumsum(take[:-1]).astype(bool)
    data = part.data.copy()
    at = np.flatnonzero(kept)
    if len(at):
        row = found.row[at]
        gap = found.end[at[:-1]][row[1:] == row[:-1]]  # after every kept word but a text's last
        data[gap] = 0x20
        take[gap] = True
    run = np.concatenate([[0], np.cumsum(take)])
    out = data[take].tobytes()
    return [hashlib.sha256(out[run[a]:run[b]]).hexdigest() if w else None
            for a, b, w in zip(part.bounds[:-1], part.bounds[1:], wanted)]


def _window_rows(buckets: int, level: int, length: int):
    """Occurrences of the candidate windows by bucket of their anchor; what a run knows to be later goes directly."""
    def flush(held):
        name, check, anchor, doc, ref, start = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((start, ref, doc, check, name))
        name, check, anchor, doc, ref, start = (x[order] for x in (name, check, anchor, doc, ref, start))
        again = _later(name, check, doc, ref, start)
        by_place = np.lexsort((start, ref, doc))
        name, check, anchor, doc, ref, start, again = (x[by_place] for x in (name, check, anchor, doc, ref, start, again))
        yield from _dealt(~again, T.mix(anchor) % np.uint64(buckets), 0, name=name, check=check, doc=doc, ref=ref, start=start)
        a, b = _runs(doc[again], ref[again], start[again])
        yield from _dealt(np.ones(len(a), dtype=bool), T.mix(ref[again][a]) % np.uint64(buckets), buckets,
                          doc=doc[again][a], ref=ref[again][a], start=start[again][a], count=b)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            refs, docs = (batch.column(c).to_numpy().view(k) for c, k in (("ref", np.uint64), ("doc", np.int64)))
            known = _known(batch.column("anchors"))
            for part in T.slices(batch.column("text")):
                found = T.words(part.data, part.bounds, T.SPACED)
                starts, anchor = _candidates(found, level, length, known[part.low:part.high])
                row = found.row[starts]
                full, name = T.windows(found, length)
                # A second hash, from words hashed anew, makes names of 96 bits.
                other = T.windows(found._replace(hash=T.mix(found.hash ^ _TOP)), length)[1]
                place = np.searchsorted(full, starts)
                held.append((name[place], (other[place] >> np.uint64(32)).astype(np.uint32), anchor,
                             docs[part.low:part.high][row], refs[part.low:part.high][row],
                             (starts - found.first[row]).astype(np.uint32)))
                size += len(starts)
                if size >= RUN_WORDS:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)
    return run


def _later(name, check, doc, ref, start) -> np.ndarray:
    """Of sorted occurrences those that are not the first; the same place met twice stays first."""
    same = np.zeros(len(name), dtype=bool)
    same[1:] = (name[1:] == name[:-1]) & (check[1:] == check[:-1])
    if not len(name):
        return same
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(name))))
    return same & ((doc != doc[head]) | (ref != ref[head]) | (start != start[head]))


def _runs(doc, ref, start) -> tuple[np.ndarray, np.ndarray]:
    """First index and number of starts of each run of consecutive starts of a document."""
    if not len(doc):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)
    new = np.ones(len(doc), dtype=bool)
    step = start[1:].astype(np.int64) - start[:-1].astype(np.int64)
    new[1:] = (doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1]) | (step > 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return first, (start[last].astype(np.int64) - start[first] + 1).astype(np.uint32)


def _later_windows(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        kinds = {"doc": np.int64, "ref": np.uint64, "start": np.uint32}
        if table.column("bucket")[0].as_py() < buckets:
            got = _unpacked(table, name=np.uint64, check=np.uint32, **kinds)
            order = np.lexsort((got["start"], got["ref"], got["doc"], got["check"], got["name"]))
            got = {k: v[order] for k, v in got.items()}
            again = _later(got["name"], got["check"], got["doc"], got["ref"], got["start"])
            doc, ref, start = (got[k][again] for k in kinds)
            order = np.lexsort((start, ref, doc))
            doc, ref, start = doc[order], ref[order], start[order]
            first, count = _runs(doc, ref, start)
            doc, ref, start = doc[first], ref[first], start[first]
        else:
            got = _unpacked(table, count=np.uint32, **kinds)
            doc, ref, start, count = got["doc"], got["ref"], got["start"], got["count"]
        return pa.table({"doc": pa.array(doc), "ref": pa.array(ref.view(np.int64)),
                         "start": pa.array(start.astype(np.int64)), "count": pa.array(count.astype(np.int64))})
    return run


def _finished(length: int):
    def run(batches):
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            for part in T.slices(batch.column("text")):
                n = part.high - part.low
                found = T.words(part.data, part.bounds, T.SPACED)
                edge = np.zeros(len(found.hash) + 1, dtype=np.int64)
                for first, own in zip(found.first[:-1].tolist(), spans[part.low:part.high]):
                    for span in own or ():
                        edge[first + span["start"]] += 1
                        edge[first + span["start"] + span["count"] - 1 + length] -= 1
                kept = np.cumsum(edge[:-1]) == 0
                removed = found.counts - np.bincount(found.row[kept], minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.low, n), pa.array(found.counts), pa.array(removed, pa.int64()),
                     pa.array(_kept_hashes(part, found, kept, np.ones(n, dtype=bool)), pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"])
    return run


def repeated_passages(docs: DataFrame, length: int = LENGTH, start: int = START) -> tuple[DataFrame, DataFrame]:
    """Documents after the narrowing, and ``spans`` of removable window starts per document.

    Documents without candidates have their result already and no text any more.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc.alias("doc"),
                         F.xxhash64("doc_id", "text").alias("ref"), "text")
    done, level = [], start
    while level < length:
        packed = T.map_batches(narrow.select("ref", "text").where("text IS NOT NULL"),
                               _anchor_rows(buckets, level, length), _PACKED_SQL)
        known = (packed.groupBy("bucket").applyInArrow(_repeated_anchors(buckets), "ref long, anchor long")
                 .groupBy("ref").agg(F.collect_set("anchor").alias("anchors")))
        joined = narrow.select("doc_id", "doc", "ref", "text").join(known, "ref", "left")
        narrow = stored(T.map_batches(
            joined.select("doc_id", "doc", "ref", "text", "anchors"), _narrowed(level, length),
            "doc_id long, doc long, ref long, n_words long, kept_sha256 string, text string, anchors array<long>"), "narrowed")
        done.append(narrow.where("anchors IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256"))
        narrow = narrow.where("anchors IS NOT NULL")
        last, level = level, 2 * level
        if narrow.isEmpty():
            break
    packed = T.map_batches(narrow.select("doc", "ref", "text", "anchors"), _window_rows(buckets, last, length), _PACKED_SQL)
    spans = (packed.groupBy("bucket").applyInArrow(_later_windows(buckets), "doc long, ref long, start long, count long")
             .groupBy("doc", "ref").agg(F.collect_list(F.struct("start", "count")).alias("spans")))
    joined = narrow.select("doc_id", "doc", "ref", "text").join(spans, ["doc", "ref"], "left")
    finished = T.map_batches(joined.select("doc_id", "text", "spans"), _finished(length),
                             "doc_id long, n_words long, n_removed long, kept_sha256 string")
    for frame in done:
        finished = finished.union(frame)
    return finished


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: numbers of words and removed words, and a hash of the kept words."""
    return repeated_passages(docs)
