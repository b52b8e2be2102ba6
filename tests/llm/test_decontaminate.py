import hashlib
import random
import re

import pytest
from conftest import prose, vocabulary

from creditloom.llm import decontaminate

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i:i + n]), set()).update([] if item is None else [str(item)])
    sizes = {len(k) for k in windows}
    for doc, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i:i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[key]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield doc, len(w), len(hit), len(found), digest, bool(hit)


@pytest.fixture
def benchmark(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "extra") for i, t in rows], "item_id long, text string, doc_id string")
    return make


def planted():
    rng, words = random.Random(5), [w for w in vocabulary(8) if w.isascii()]
    items = [(i, prose(rng, words, n)) for i, n in enumerate([4, 10, 12, 40, 40, 1, 25])]
    items += [(7, None), (8, ""), (None, prose(rng, words, 12)), (2, items[2][1]), (10, items[3][1].upper()), (11, "one two one two")]
    docs = [(i, prose(rng, words, 300)) for i in range(20)]
    for i in range(20, 60):
        w = items[rng.choice([0, 1, 2, 3, 4, 6, 9, 11, 12])][1].split(" ")
        piece = " ".join(w[rng.randrange(max(1, len(w) - 12)):])
        docs.append((i, prose(rng, words, rng.randrange(80)) + ", " + piece.title() + ".\n" + prose(rng, words, 100)))
    docs += [(60, "one two " * 50), (61, None), (62, ""), (None, items[3][1]), (63, items[3][1]), (63, items[3][1]),
             (64, prose(rng, words, 20_000) + " " + items[4][1])]
    return docs, items


@pytest.mark.parametrize("part_bytes,piece,held", [(1 << 20, 20_000, 1 << 28), (300, 15, 1 << 28), (300, 1, 0)])
def test_equals_brute_force(frame, benchmark, rows, monkeypatch, part_bytes, piece, held):
    """Also with items in pieces, in several parts, and parts read again for each run of documents."""
    for name, value in (("PIECE_WORDS", piece), ("HELD_BYTES", held), ("RUN_BYTES", 4000)):
        monkeypatch.setattr(decontaminate, name, value)
    docs, items = planted()
    got = decontaminate.contamination(frame(docs), benchmark(items), part_bytes=part_bytes)
    got = sorted((str(r.doc_id), r.n_words, len(r.hits), len(r.items), hashlib.sha256(",".join(r.items).encode()).hexdigest())
                 for r in got.collect())
    want = list(brute(docs, items))
    assert got == sorted((str(w[0]), *w[1:5]) for w in want)
    digest = decontaminate.digest(frame(docs), benchmark(items))
    assert rows(digest) == sorted(want, key=lambda t: tuple((v is not None, str(v)) for v in t))
    assert any(w[5] for w in want) and not all(w[5] for w in want)


def test_removal_keeps_columns_and_clean_rows(frame, benchmark):
    docs, items = planted()
    left = decontaminate.remove_contaminated(frame(docs), benchmark(items))
    assert left.columns == frame(docs).columns
    want = sorted(str(d) for (d, *_, bad) in brute(docs, items) if not bad)
    assert sorted(str(r.doc_id) for r in left.collect()) == want


def test_empty_tables(frame, benchmark):
    docs, items = planted()
    assert decontaminate.digest(frame([]), benchmark(items)).count() == 0
    assert decontaminate.digest(frame(docs), benchmark([])).where("contaminated").count() == 0
