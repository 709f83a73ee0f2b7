import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codec as C
from tidemark.operators import batches
from tidemark.sources import logfile, tablefile


def test_varints_round_trip_and_reject():
    for n in [0, 100, (1 << 64) - 1, *(1 << k for k in range(64)), *((1 << k) - 1 for k in range(64)), *((1 << k) + 1 for k in range(64))]:
        raw = C.put_varint(n)
        assert C.get_varint(raw) == (n, len(raw))
        with pytest.raises(C.Corruption):
            C.get_varint(raw[:-1] if len(raw) > 1 else b"")
    for bad, bits in ((b"\x81\x82\x83\x84\x85\x11", 32), (b"\x81\x82\x83\x84\x85\x81\x82\x83\x84\x85\x11", 64)):
        with pytest.raises(C.Corruption):
            C.get_varint(bad, 0, bits)


def test_varint_length_column(spark):
    values = [0, 127, 128, 16383, 16384, (1 << 35) - 1, 1 << 35, (1 << 56) - 1, 1 << 56, (1 << 62)]
    got = spark.createDataFrame([(v,) for v in values], "n long").select("n", C.varint_length(F.col("n")).alias("k")).collect()
    assert all(r.k == len(C.put_varint(r.n)) for r in got)


def test_hash_vectors():
    data = [("62", 0xBC9F1D34, 0xEF1345C4), ("c397", 0xBC9F1D34, 0x5B663814), ("e299a5", 0xBC9F1D34, 0x323C078F), ("e180b932", 0xBC9F1D34, 0xED21633A)]
    for text, seed, expected in data:
        assert C.byte_hash(bytes.fromhex(text), seed) == expected


@pytest.mark.parametrize("length", [1, 2, 3, 4, 7, 10])
def test_hash_column(spark, length):
    r = random.Random(length)
    keys = ["".join(r.choice("abcxyz0189") for _ in range(length)) for _ in range(20)]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", C.byte_hash_column(F.col("k"), length, 0xBC9F1D34).alias("h")).collect()
    assert all(r.h == C.byte_hash(r.k.encode(), 0xBC9F1D34) for r in got)


def test_internal_keys():
    for key in (b"", b"k", b"hello", b"long" + b"g" * 22):
        for seq in (1, 2, 3, *(x + d for x in (1 << 8, 1 << 16, 1 << 32) for d in (-1, 0, 1))):
            for kind in (0, 1):
                assert C.parse_internal_key(C.pack_internal_key(key, seq, kind)) == (key, seq, kind)
    with pytest.raises(C.Corruption):
        C.parse_internal_key(b"")


def test_separators():
    key = C.pack_internal_key
    foo = key(b"foo", 100, 1)
    for limit in (key(b"foo", 99, 1), key(b"foo", 101, 1), key(b"foo", 100, 0), key(b"bar", 99, 1), key(b"foobar", 200, 1)):
        assert C.internal_separator(foo, limit) == foo
    assert C.internal_separator(foo, key(b"hello", 200, 1)) == key(b"g", C.MAX_SEQUENCE, 1)
    assert C.internal_successor(foo) == key(b"g", C.MAX_SEQUENCE, 1)
    assert C.short_successor(b"\xff\xff") == b"\xff\xff"
    assert C.short_successor(b"\xffa") == b"\xffb"


def test_file_names():
    good = {"100.log": ("log", 100), "0.sst": ("table", 0), "0.ldb": ("table", 0), "CURRENT": ("current", 0), "MANIFEST-7": ("manifest", 7), "LOG.old": ("info", 0), "18446744073709551615.log": ("log", (1 << 64) - 1)}
    for name, found in good.items():
        assert C.parse_file_name(name) == found
    for name in ("foo", ".log", "", "manifest", "MANIFEST-", "MANIFEST-3x", "LOGx", "18446744073709551616.log", "100", "100.", "100.lop"):
        assert C.parse_file_name(name) is None
    assert C.file_name("log", 7) == "000007.log"


def test_batches():
    ops = [(1, b"foo", b"bar"), (0, b"box", None), (1, b"baz", b"boo")]
    raw = batches.encode(100, ops)
    assert [(s, k) for s, _, k, _ in batches.decode(raw)] == [(100, b"foo"), (101, b"box"), (102, b"baz")]
    cut, seen = batches.encode(200, ops[:2])[:-1], []
    with pytest.raises(C.Corruption):
        for op in batches.decode(cut):
            seen.append(op)
    assert seen == [(200, 1, b"foo", b"bar")]


def test_log_round_trip():
    r = random.Random(5)
    records = [b"small", b"medium" * 8333, b"large" * 20000, *(r.randbytes(r.randrange(1, 1 << r.randrange(1, 16))) for _ in range(60))]
    assert list(logfile.read_records(logfile.frame(records))) == records
    head = logfile.frame([b"hello"])
    assert list(logfile.read_records(head + logfile.frame([b"world"], len(head)))) == [b"hello", b"world"]
    for n in (32768 - 14, 32768 - 14 + 4):
        assert list(logfile.read_records(logfile.frame([b"x" * n, b"bar", b"foo"]))) == [b"x" * n, b"bar", b"foo"]


def test_log_corruption():
    data = bytearray(logfile.frame([b"foo"]))
    data[0] += 1
    report = logfile.Report()
    assert list(logfile.read_records(bytes(data), report)) == [] and report.dropped == [(10, "checksum mismatch")]
    data = bytearray(logfile.frame([b"foo"]))
    data[6] += 100
    data[:4] = zlib.crc32(bytes(data[6:])).to_bytes(4, "little")
    report = logfile.Report()
    assert list(logfile.read_records(bytes(data), report)) == [] and report.dropped == [(3, "unknown record type")]
    for cut in (4, 1):
        report = logfile.Report()
        assert list(logfile.read_records(logfile.frame([b"foo"])[:-cut], report)) == [] and not report.dropped


@pytest.mark.parametrize("interval", [1, 16, 1024])
def test_table_round_trip(interval):
    r = random.Random(interval)
    alphabet = bytes([0, 1, *b"abcde", 0xFD, 0xFE, 0xFF])
    model = {bytes(r.choice(alphabet) for _ in range(r.randrange(12))): r.randbytes(r.randrange(32)) for _ in range(500)}
    raw = tablefile.write_table(iter(sorted(model.items())), 256, interval)
    assert list(tablefile.read_table(raw)) == sorted(model.items())
    with pytest.raises(C.Corruption):
        list(tablefile.read_table(raw[:-1] + b"x"))
    with pytest.raises(C.Corruption):
        list(tablefile.read_table(b"x" + raw[1:]))
    assert list(tablefile.read_table(tablefile.write_table(iter([])))) == []


def test_file_sources(spark, tmp_path):
    (tmp_path / "000001.log").write_bytes(logfile.frame([batches.encode(1, [(1, b"a", b"1"), (0, b"b", None)]), batches.encode(3, [(1, b"c", b"3")])]))
    got = logfile.read_log_files(spark, str(tmp_path / "*.log")).orderBy("seq").collect()
    assert [(bytes(r.user_key), r.seq, r.vtype) for r in got] == [(b"a", 1, 1), (b"b", 2, 0), (b"c", 3, 1)]
    entries = [(C.pack_internal_key(k, s, 1), v) for k, s, v in ((b"a", 1, b"x"), (b"b", 2, b"y"))]
    (tmp_path / "000002.ldb").write_bytes(tablefile.write_table(iter(entries)))
    got = tablefile.read_table_files(spark, str(tmp_path / "*.ldb")).orderBy("seq").collect()
    assert [(bytes(r.user_key), r.seq, bytes(r.value)) for r in got] == [(b"a", 1, b"x"), (b"b", 2, b"y")]
