import collections
import re

import duckdb
from conftest import crc  # noqa: F401  (shared helpers)

from creditloom.llm import quality_rules as R

WORD = re.compile("[^\x20\x09-\x0D]+")
EXTRA = [(900, "a b c d e " * 4 + "tail"), (901, "a b c d e f a b c d e"), (902, "aa " * 9), (903, "aa " * 10),
         (904, "one two three four five six seven eight nine ten\n \n\none two three four five six seven eight nine ten\n"),
         (905, "$$$ *** " * 20 + "the of and to"), (906, "a a a a a a a b c d e f g h i j k"), (907, "WORDS!! LIKE!! THIS!! " * 6)]


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_counts_equal_brute_force_and_sql(frame, corpus):
    docs = corpus + EXTRA
    got = sorted((str(r.doc_id), *tuple(r)[1:]) for r in R.digest(frame(docs)).collect())
    assert [g[:-1] for g in got] == sorted((str(i), *brute(t)) for i, t in docs) or sorted(g[:-1] for g in got) == sorted(
        (str(i), *brute(t)) for i, t in docs)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(d) for d in docs])
    assert sorted((str(r[0]), *r[1:]) for r in con.execute(R.sql()).fetchall()) == got


def test_base_failures_are_never_kept_and_rules_apply(frame):
    got = {r.doc_id: r for r in R.judged(frame(EXTRA)).collect()}
    assert not any(r.kept for r in got.values() if r.base_failed)
    assert not got[905].ok_symbols and not got[907].ok_shouting
    one = R.judged(frame(EXTRA), (R.Rule("short", "word_chars", "n_words", None, 100),)).where("kept").count()
    assert one == sum(not r.base_failed and r.word_chars <= r.n_words for r in got.values())


def test_plan_has_no_python_and_no_exchange(frame):
    plan = R.digest(frame(EXTRA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Arrow" not in plan


def test_empty_table(frame):
    assert R.digest(frame([])).count() == 0
