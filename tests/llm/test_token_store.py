import numpy as np
import pytest

from creditloom.llm import token_store as K


@pytest.fixture(scope="module")
def vocabulary(tmp_path_factory):
    """Bytes and a few merges, so that the tests need no vocabulary file."""
    import base64
    merges = [b"th", b"he", b"the", b" a", b"in", b"er", b" b"]
    path = tmp_path_factory.mktemp("ranks") / "ranks.tiktoken"
    tokens = [bytes([i]) for i in range(256)] + merges
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    return str(path)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 100, 1023, 4097])
def test_feistel_is_a_permutation(n):
    slots = K.feistel(np.arange(n), n)
    assert sorted(slots) == list(range(n))
    assert (K.unfeistel(slots, n) == np.arange(n)).all()
    if n > 60:
        assert (slots != np.arange(n)).mean() > 0.9
        assert (slots != K.feistel(np.arange(n), n, key=1)).any()


def test_tokenizer_equals_the_library(vocabulary):
    import tiktoken
    ranks = K.read_ranks(vocabulary)
    ours = K.tokenizer(ranks)
    plain = tiktoken.Encoding("t", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ["", " ", "a  b\n\n c \t ", "the inner\nthing ", "x　 y  z", "I'm  it's\r\n12 34", "\x1c a\x0b\x0cb", "é" * 500]:
        assert ours(text).tolist() == plain.encode_ordinary(text)


def test_round_trip_in_training_order(spark, frame, corpus, vocabulary, tmp_path):
    stride = 64
    rows = K.in_training_order(K.sequences(frame(corpus).repartition(3), vocabulary, stride), 100).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(r.shard == r.slot // 100 and len(r.tokens) == 2 * stride for r in rows)
    merges = {i: t for t, i in K.read_ranks(vocabulary).items()}
    texts = {}
    for r in sorted(rows, key=lambda r: r.piece):
        ids = np.frombuffer(bytes(r.tokens), dtype=np.uint16)
        assert (ids[max(0, r.n_tokens):] == max(merges) + 1).all()
        texts.setdefault(r.doc_id, []).append((r.piece, b"".join(merges[i] for i in ids[:max(0, r.n_tokens)].tolist())))
    single = {}
    for doc, text in corpus:
        single.setdefault(doc, []).append(text or "")
    for doc, all_texts in single.items():
        if len(all_texts) == 1:
            assert b"".join(t for _, t in texts[doc]).decode() == all_texts[0]
        else:
            assert sum(len(t) for _, t in texts[doc]) == sum(len(t.encode()) for t in all_texts)


def test_shards_are_resumable(spark, frame, corpus, vocabulary, tmp_path):
    stride, path = 32, str(tmp_path / "shards")
    rows = K.sequences(frame(corpus), vocabulary, stride)
    K.write_shards(rows, path, shard_slots=100, block_slots=16)
    by_slot = {r.slot: bytes(r.tokens) for r in rows.collect()}
    for slot, n in ((0, 5), (95, 10), (15, 2), (len(by_slot) - 3, 3)):
        got = K.read_from(spark, path, slot, n, stride, 100, 16)
        assert [g.tobytes() for g in got] == [by_slot[s] for s in range(slot, slot + n)]


def test_edges(frame, vocabulary):
    assert K.in_training_order(K.sequences(frame([]), vocabulary)).count() == 0
    rows = K.sequences(frame([(1, None), (2, ""), (2, "")]), vocabulary).collect()
    assert [r.n_tokens for r in rows] == [0, 0, 0]


def test_the_query_writes_its_shards_and_reads_them_back(spark, frame, corpus, vocabulary, tmp_path, monkeypatch):
    paths, sequences = [], K.sequences
    monkeypatch.setattr(K, "scratch_path", lambda spark, name: paths.append(str(tmp_path / f"{name}{len(paths)}")) or paths[-1])
    monkeypatch.setattr(K, "sequences", lambda docs: sequences(docs, vocabulary))
    monkeypatch.setattr(K.write_shards, "__defaults__", (100, 16))
    got = K.digest(frame(corpus).repartition(3))
    assert got.columns == ["shard", "slot", "doc_id", "piece", "n_tokens", "tokens"]
    got = got.collect()
    assert [r.slot for r in got] == list(range(len(got))) and len(got) > 200
    assert all(r.shard == r.slot // 100 for r in got)
    blocks = spark.read.parquet(paths[0])
    assert sorted((r.shard, r.block, r.first_slot, r.n, r.size) for r in blocks.selectExpr("*", "length(payload) AS size").collect()) == [
        (s // 100, s % 100 // 16, s, n, n * 2048) for s in range(len(got)) if s % 100 % 16 == 0
        for n in [min(16, 100 - s % 100, len(got) - s)]]
    want = sorted(tuple(r) for r in sequences(frame(corpus).repartition(3), vocabulary).groupBy("doc_id", "piece", "n_tokens", "tokens")
                  .count().drop("count").collect() if r.doc_id is not None)
    assert sorted({tuple(r)[2:] for r in got if r.doc_id is not None}) == want
    assert [x.tobytes() for x in K.read_from(spark, paths[0], 95, 10, 1024, 100, 16)] == [bytes(r.tokens) for r in got[95:105]]
    assert K.digest(frame([]).limit(0)).count() == 0
