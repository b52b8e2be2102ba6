import random
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from creditloom.sources import manifest, quarantine
from creditloom.sources.checksums import checksums, combine
from creditloom.schemas import struct


@given(st.binary(max_size=200), st.binary(max_size=3000))
def test_combined_checksum_is_that_of_both(a, b):
    assert combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_files_in_ranges(spark, tmp_path):
    rng = random.Random(2)
    files = {"none": b"", "break": b"\n", "open": b"a,b\r\n1,2", "plain + x%y": b"x\ny\n", "bytes": bytes(rng.randrange(256) for _ in range(5000)),
             "many": b"".join(b"%d,%s\n" % (i, b"z" * rng.randrange(40)) for i in range(9000)), "blank": b"\n\n\nq\n\n"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "folder").mkdir()
    for name in ("part-1", "part-0"):
        (tmp_path / "folder" / name).write_bytes(name.encode() * 900)
    files["folder"] = b"part-0" * 900 + b"part-1" * 900
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for size in (before, "3000b"):
            spark.conf.set(key, size)
            got = {r.name: (r.length, r.crc32) for r in checksums(spark, str(tmp_path)).collect()}
            assert got == {n: (len(d), zlib.crc32(d)) for n, d in files.items()}
    finally:
        spark.conf.set(key, before)


def test_contents_are_reconciled(spark):
    sent = spark.createDataFrame([("a", 1, 5), ("b", 2, 6), ("c", 3, 7), ("d", None, None), ("e", 4, None), ("f", 0, 0)],
                                 manifest.MANIFEST)
    here = spark.createDataFrame([("a", 1, 5), ("b", 2, 9), ("c", 9, 7), ("d", 8, 8), ("x", 1, 1), ("f", 0, 0)], manifest.MANIFEST)
    got = {r.name: r.status for r in manifest.reconcile_contents(sent, here).collect()}
    assert got == {"a": "ok", "b": "checksum_mismatch", "c": "size_mismatch", "d": "ok", "e": "missing", "x": "extra", "f": "empty"}


def test_header_drift(spark, tmp_path):
    want = struct(long="k", double="x", string="s")
    for name, head in (("same", "k,x,s"), ("added", "k,x,s,n"), ("lost", "k,s"), ("moved", 'x,"k",s'), ("twice", "k,x,s,x")):
        (tmp_path / name).write_text(head + "\r\n" + "1,1,1\n" * 5)
    got = sorted(map(tuple, quarantine.drift(quarantine.headers(spark, str(tmp_path)), want).collect()))
    assert got == [("added", "n", "added"), ("lost", "x", "missing"), ("moved", "k", "moved"), ("moved", "x", "moved"),
                   ("twice", "x", "repeated")]
    rows = quarantine.landed(quarantine.checked(spark, str(tmp_path), want), want)
    assert rows.schema == want and rows.count() == 10  # in three files each row lacks a field or has one too many


@pytest.mark.parametrize("text,faults", [("7,0.5,a\n", []), ("seven,0.5,a\n", [("k", "not bigint", "seven")]),
                                         ("99999999999999999999,,\n", [("k", "not bigint", "99999999999999999999")]),
                                         (",,\n", []), ("1,half,\n", [("x", "not double", "half")])])
def test_faults_of_a_row(spark, tmp_path, text, faults):
    (tmp_path / "t.csv").write_text("k,x,s\n" + text)
    rows = quarantine.checked(spark, str(tmp_path), struct(long="k", double="x", string="s"))
    assert [(r["column"], r.reason, r.value) for r in quarantine.quarantined(rows).collect()] == faults
    assert quarantine.landed(rows, struct(long="k", double="x", string="s")).count() == (not faults)
