import zlib

import pytest

from creditloom.llm import virtual_slots as V


def test_rows_sizes_and_gapless_slots(frame, corpus, monkeypatch):
    monkeypatch.setattr(V, "CELL_ROWS", 2)
    got = V.digest(frame(corpus)).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(i), 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in corpus)
    shards = {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        shards.setdefault(r.shard, []).append(r.slot)
    assert set(shards) <= set(range(24))
    for slots in shards.values():
        assert sorted(slots) == list(range(len(slots)))


def test_shards_are_near_equal(frame):
    docs = [(i, "x" * (i * 37 % 1900)) for i in range(3000)]
    sizes = [0] * 24
    for r in V.digest(frame(docs)).collect():
        sizes[r.shard] += r.size
    assert max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 24
    again = {r.doc_id: r.shard for r in V.digest(frame(docs).repartition(5)).collect()}
    assert again == {r.doc_id: r.shard for r in V.digest(frame(docs)).collect()}


def test_many_identical_rows_are_counted_and_spread_out(frame):
    got = V.digest(frame([(7, "same")] * 500 + [(8, "other")])).collect()
    assert len(got) == 501
    assert sorted(r.slot for r in got if r.doc_id == 7)[-1] >= 499


def test_map_versions_and_rebalancing(spark, tmp_path):
    weights = {s: 100 + s % 7 for s in range(512)}
    first = V.assign(weights, 8, 512)
    grown = V.rebalance(first, weights, 9)
    moved = [s for s in first if first[s] != grown[s]]
    assert all(grown[s] == 8 for s in moved) and 0 < len(moved) <= 512 // 8
    load = [sum(weights[s] for s in grown if grown[s] == k) for k in range(9)]
    assert max(load) - min(load) <= 0.05 * max(load)
    path = str(tmp_path / "map")
    V.write_map(spark, path, first, weights, 1)
    V.write_map(spark, path, grown, weights, 2)
    assert V.read_map(spark, path) == (2, grown)
    assert V.read_map(spark, path, 1) == (1, first)


def test_hot_ids_and_repeats_are_spread(spark, frame, tmp_path, monkeypatch):
    paths = []
    monkeypatch.setattr(V, "scratch_path", lambda spark, name: paths.append(str(tmp_path / name)) or paths[-1])
    monkeypatch.setattr(V, "COPIES", 4)
    docs = ([(7, f"text {i}") for i in range(1000)] + [(9, "repeat")] * 999 + [(None, "nobody")] * 500
            + [(i, "x" * (i % 9)) for i in range(10, 800)])
    got = V.digest(frame(docs)).collect()
    assert sorted((str(r.doc_id), r.text_crc32) for r in got) == sorted((str(i), zlib.crc32(t.encode())) for i, t in docs)
    sizes, slots = [0] * 24, {}
    for r in got:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(sizes) - min(sizes) <= 0.05 * sum(sizes) / 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    version, placed = V.read_map(spark, paths[0])
    assert version == 1 and all(placed[r.virtual_slot] == r.shard for r in got)


def test_the_map_lives_on_between_runs(spark, frame, tmp_path):
    path = str(tmp_path / "map")
    docs = [(i, "x" * (i * 37 % 1900)) for i in range(2000)]
    first = {r.doc_id: r.shard for r in V.digest(frame(docs), path).collect()}
    assert {r.doc_id: r.shard for r in V.digest(frame(docs), path).collect()} == first
    assert V.read_map(spark, path)[0] == 1, "the same loads need no edit"
    placed = V.read_map(spark, path)[1]
    slot = {r.doc_id: r.virtual_slot for r in V.digest(frame(docs), path).collect()}
    more = docs + [(i, "y" * 3000) for i in range(5000, 9000) if i % 3]
    got = V.digest(frame(more), path).collect()
    version, edited = V.read_map(spark, path)
    assert version == 2 and all(edited[r.virtual_slot] == r.shard for r in got)
    assert {r.doc_id for r in got if r.doc_id in first and r.shard != first[r.doc_id]} == {
        i for i in first if edited[slot[i]] != placed[slot[i]]}
    assert sum(edited[s] == placed[s] for s in placed) > len(placed) / 2
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(24)]
    assert max(sizes) - min(sizes) <= 0.05 * max(sizes)


@pytest.mark.parametrize("docs", [[], [(None, None)], [(1, None)]])
def test_tiny_tables(frame, docs):
    assert V.digest(frame(docs)).count() == len(docs)
