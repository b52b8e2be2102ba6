import hashlib
import re

import pytest

from creditloom.llm import substring_dedup as S

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(docs, length=20):
    """Rows of one id and text are one document; other ties are left to the caller."""
    first, words = {}, {}
    order = sorted({(-1 if i is None else i, t or "") for i, t in docs})
    for key in order:
        words[key] = WORD.findall(key[1])
        for p in range(len(words[key]) - length + 1):
            first.setdefault(tuple(words[key][p:p + length]), (key, p))
    out = []
    for i, t in docs:
        key = (-1 if i is None else i, t or "")
        w, gone = words[key], set()
        for p in range(len(w) - length + 1):
            if first[tuple(w[p:p + length])] != (key, p):
                gone.update(range(p, p + length))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def result(frame):
    return sorted((str(r.doc_id), *tuple(r)[1:]) for r in frame.collect())


@pytest.mark.parametrize("start,length,run", [(10, 20, 1 << 20), (5, 20, 300), (3, 6, 1 << 20)])
def test_equals_brute_force(frame, corpus, monkeypatch, start, length, run):
    monkeypatch.setattr(S, "RUN_WORDS", run)
    monkeypatch.setattr(S.T, "SLICE_BYTES", 4096)
    docs = [d for d in corpus if d != (137, "a")]  # ids with one text each, so that order is by id
    docs += [(140, "p q r s t u v w x y " * 9), (141, "p q r s t u v w x y " * 3)]
    assert result(S.repeated_passages(frame(docs).repartition(4), length, start)) == brute(docs, length)


def test_several_texts_of_one_id_keep_one_copy(frame):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = result(S.digest(frame([(1, passage + " a"), (1, passage + " b")])))
    assert sorted(r[2] for r in rows) == [0, 30]


def test_nothing_repeated_and_empty(frame):
    docs = [(1, " ".join(f"a{i}" for i in range(50))), (2, None), (3, "")]
    assert result(S.digest(frame(docs))) == brute(docs)
    assert S.digest(frame([])).count() == 0
