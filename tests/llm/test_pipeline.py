import random
import re

import corpus_pipeline
from conftest import crc, prose, vocabulary
from test_decontaminate import brute as contaminated
from test_setsketch import brute as groups

from creditloom.llm import quality_trees

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(spark, path):
    rng, words = random.Random(21), [w for w in vocabulary(12) if w.isascii()]
    items = [(i, prose(rng, words, 20)) for i in range(5)]
    docs, marks = [], []
    for i in range(240):
        text, good = prose(rng, words, rng.randint(30, 120)), 1
        if i % 6 == 0:
            text, good = text.replace(" ", "$$$ "), 0
        elif i % 6 == 1 and i > 20:
            text = docs[i - 7][1] + " " + words[i % 50] if docs[i - 7][0] % 6 else text
        elif i % 12 == 2:
            text += " " + items[i % 5][1]
        elif i % 12 == 3:
            text += " password=abcdefgh1234 " + words[3]
        docs.append((i, text))
        marks.append((i, good, 0))
    docs += [(500, None), (501, ""), (None, docs[7][1]), docs[8], docs[8]]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs, items


def test_stages_equal_brute_force(spark, tmp_path):
    path = str(tmp_path)
    docs, items = tables(spark, path)
    frame = spark.read.parquet(f"{path}/documents.parquet")
    scores = {(r.doc_id, r.predicted) for r in quality_trees.digest(frame, spark.read.parquet(f"{path}/labels.parquet")).collect()}
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, path)
        if k < 4:
            assert out.columns == COLUMNS
        out.write.parquet(f"{path}/out{k}")
        frame = spark.read.parquet(f"{path}/out{k}")
        seen.append(frame.collect())
    good = [d for d in docs if (d[0], 1) in scores]
    assert sorted(map(str, ((r.doc_id, r.text) for r in seen[0]))) == sorted(map(str, good))
    assert not {i for i, _ in good} & {i for i in range(0, 240, 6)} and len(good) >= 200
    keep = {k[0] for k in groups(good) if k[3]}
    stay = sorted({str(d) for d in good if str(d[0]) in keep})
    assert sorted(str((r.doc_id, r.text)) for r in seen[1]) == stay and len(stay) < len(good)
    clean = {d[0] for d in contaminated([(r.doc_id, r.text) for r in seen[1]], items) if not d[5]}
    assert {r.doc_id for r in seen[2]} == clean and len(clean) < len(seen[1])
    for before, after in zip(sorted(seen[2], key=lambda r: str(r.doc_id)), sorted(seen[3], key=lambda r: str(r.doc_id))):
        assert after.text == (before.text and re.sub(r"password=\S+", "[assign]", before.text))
        assert after.n_chars == (before.n_chars if after.text == before.text else len(after.text))
    packed = {m.doc_id for r in seen[4] for m in r.members}
    assert packed == {r.doc_id for r in seen[3] if (r.text or "").split()}
    final = corpus_pipeline.run(spark, path).collect()
    assert sorted((m.doc_id is None, m.doc_id or 0, m.start, m.length) for r in final for m in r.members) == sorted(
        (m.doc_id is None, m.doc_id or 0, m.start, m.length) for r in seen[4] for m in r.members)


def test_tables_without_rows(spark, tmp_path):
    path = str(tmp_path)
    tables(spark, path)
    frame = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, path).write.parquet(f"{path}/empty{k}")
        frame = spark.read.parquet(f"{path}/empty{k}")
    assert frame.count() == 0


def test_registered_queries():
    import __spark_entry__ as entry
    from creditloom.llm import registry

    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(registry.ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(n.split("_")[0][2:]) for n in registry.QUERIES) == list(range(1, 14))
    assert crc(1, 4) in range(4)
