import pytest

from tidemark.functions import codecs
from tidemark.schema import InvalidArgument, Options
from tidemark.sources.store import Engine


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "db")
    e = Engine.open(spark, path, Options(disable_auto_compaction=True))
    e.put(b"k", b"v1")
    with e.snapshot() as s:
        e.put(b"k", b"v2")
        e.delete(b"x")
        e.put(b"y", b"")
        assert e.get(b"k", s) == b"v1" and e.get(b"k") == b"v2"
        assert e.get(b"x") is None and e.get(b"y") == b""
        assert e.compact_once(force=True)
        assert e.get(b"k", s) == b"v1" and e.get(b"k") == b"v2"
    with pytest.raises(InvalidArgument):
        e.put(b"", b"v")
    e.put(b"a", b"late")
    assert e.compact_once(force=True)
    again = Engine.open(spark, path)
    assert again.last_seq == 5
    assert [(bytes(r.user_key), bytes(r.value)) for r in again.scan().collect()] == [(b"a", b"late"), (b"k", b"v2"), (b"y", b"")]
    for key in (b"a", b"k", b"y"):  # reads and scans agree after compactions out of order
        assert again.get(key) is not None


def test_batches_keep_their_order(spark, tmp_path):
    e = Engine.open(spark, str(tmp_path / "db"), Options(disable_auto_compaction=True))
    ops = spark.createDataFrame([(i, 1 if i % 5 == 4 else 0, f"k{i % 7}".encode(), str(i).encode()) for i in range(200)], "op_no long, vtype int, user_key binary, value binary")
    assert e.apply(ops) == 200
    want = {}
    for i in range(200):
        want.pop(f"k{i % 7}", None) if i % 5 == 4 else want.__setitem__(f"k{i % 7}", str(i))
    assert {bytes(r.user_key).decode(): bytes(r.value).decode() for r in e.scan().collect()} == want


def test_codecs():
    for n in (0, 1, 127, 128, 2**32 - 1, 2**64 - 1):
        assert codecs.take_varint(codecs.put_varint(n))[0] == n
    assert codecs.crc32c(b"123456789") == 0xE3069283
    assert codecs.parse_log_entry(codecs.log_entry(1, 7, b"k", b"")) == (1, 7, b"k", b"")
    assert codecs.parse_internal_key(codecs.internal_key(b"key", 9, 0)) == (b"key", 9, 0)
