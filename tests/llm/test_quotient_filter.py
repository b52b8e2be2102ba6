import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from creditloom.llm import quotient_filter as Q


def brute(rows):
    text = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, text):
        groups[t].append(i)
    for (i, _), t in zip(rows, text):
        keep = min((x for x in groups[t] if x is not None), default=None)
        yield i, keep, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()


@given(st.dictionaries(st.integers(0, 2 ** 40 - 1), st.integers(1, 2 ** 45), min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_filter_gives_back_values_and_counts(held):
    values = np.array(sorted(held), dtype=np.uint64)
    counts = np.array([held[int(v)] for v in values], dtype=np.int64)
    back, again = Q.decode(Q.encode(values, counts, 40))
    assert back.tolist() == values.tolist() and again.tolist() == counts.tolist()


@given(st.lists(st.lists(st.integers(0, 5000), min_size=1, max_size=80), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_merged_filter_is_the_filter_of_all_values(parts):
    def of(values):
        v, c = np.unique(np.array(values, dtype=np.uint64), return_counts=True)
        return Q.encode(v, c, 58)
    assert Q.merge([of(p) for p in parts], 58) == of([v for p in parts for v in p])


def test_remainders_take_the_bits_that_the_quotient_leaves():
    values = np.arange(0, 2 ** 58, 2 ** 48, dtype=np.uint64)
    assert len(Q.encode(values, np.ones(len(values)), 58)) < len(values) * 8


def test_digest_matches_brute_force(frame, corpus):
    rows = corpus + [(200, "a  b"), (201, "a\tb"), (202, "a b "), (203, "a b"), (204, "a b"), (205, "A b")]
    got = Q.digest(frame(rows).repartition(7)).collect()
    assert sorted(map(str, [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got])) == sorted(map(str, brute(rows)))
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_texts_of_one_fingerprint_stay_apart(frame, monkeypatch):
    monkeypatch.setattr(Q.F, "xxhash64", lambda *_: Q.F.lit(7).cast("long"))
    got = Q.digest(frame([(1, "a"), (2, "b"), (3, "a"), (4, "c")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [
        (1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False), (4, 4, 1, True)]


def test_segments_and_several_filters_a_task(frame, corpus, monkeypatch):
    monkeypatch.setattr(Q, "PER_SEGMENT", 1)
    monkeypatch.setattr(Q, "PER_FILTER", 3)
    got = Q.digest(frame(corpus)).collect()
    assert sorted(map(str, [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got])) == sorted(map(str, brute(corpus)))


def test_deduplicate_keeps_columns_and_one_row_each(frame):
    docs = frame([(3, "x y"), (1, "x\ny"), (1, "x y"), (None, "x y"), (None, None), (None, ""), (5, "z")])
    got = Q.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in got.select("doc_id", "text").collect())[1:] == [("5", "z"), ("None", "")]
    assert got.where("doc_id = 1").count() == 1 and got.count() == 3


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_nothing_to_group(frame, rows):
    assert Q.digest(frame(rows)).count() == len(rows)
    assert Q.deduplicate(frame(rows)).count() == len(rows)
