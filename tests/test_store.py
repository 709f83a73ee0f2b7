"""Byte tables, filters, snappy frames, manifest edits and store directories."""

import io
import random

import pytest
from pyspark.sql import functions as F

from tidemark.errors import Busy, InvalidArgument, NotFound
from tidemark.functions import codec, snappy
from tidemark.functions.filters import BloomPolicy, FilterBlock, FilterBlockBuilder
from tidemark.operators import batches, files, reads
from tidemark.operators.reads import Cursor
from tidemark.sources import datasource, logfile, store, tablefile
from tidemark.sources.cache import LRUCache, ShardedCache
from tidemark.sources.editfile import FileNumbers, Version, VersionEdit
from tidemark.sources.store import MemoryFolder, Store, StoreOptions
from tidemark.table import KVTable

LOG = "user_key string, seq long, vtype long, value string"


class HashPolicy:
    """Four bytes of hash for every key."""

    name = "test.hash"

    def create(self, keys):
        return b"".join(codec.byte_hash(k, 1).to_bytes(4, "little") for k in keys)

    def may_match(self, key, data):
        return codec.byte_hash(key, 1).to_bytes(4, "little") in [data[i : i + 4] for i in range(0, len(data), 4)]


def entries(n, seed=1):
    r = random.Random(seed)
    keys = sorted({bytes(r.choice(b"abc\xff\x00") for _ in range(r.randrange(1, 12))) for _ in range(n)})
    return [(k, bytes([r.randrange(256)]) * r.randrange(60)) for k in keys]


def test_snappy_frames():
    assert snappy.crc32c(b"123456789") == 0xE3069283
    for data in (b"", b"a", b"ab" * 100_000, random.Random(2).randbytes(70_000)):
        packed = snappy.compress(data)
        assert snappy.decompress(packed) == data
    packed = snappy.compress(b"hello " * 1000)
    for bad in (packed[:-1], packed[:12], b"x" + packed[1:], packed[:20] + bytes([packed[20] ^ 1]) + packed[21:], packed + b"\x02\x00\x00\x00"):
        with pytest.raises(codec.Corruption):
            snappy.decompress(bad)
    assert snappy.decompress(packed + b"\xfe\x02\x00\x00xx" + snappy.IDENTIFIER) == b"hello " * 1000


def test_empty_filter_block():
    data = FilterBlockBuilder(HashPolicy()).finish()
    assert data == bytes([0, 0, 0, 0, 11])
    block = FilterBlock(HashPolicy(), data)
    assert block.may_match(0, b"foo") and block.may_match(100_000, b"foo")
    assert FilterBlock(HashPolicy(), b"").may_match(0, b"foo") and FilterBlock(HashPolicy(), b"\xff" * 9).may_match(0, b"foo")


def test_filter_block_chunks():
    b = FilterBlockBuilder(HashPolicy())
    for offset, keys in ((0, [b"foo"]), (2000, [b"bar"]), (3100, [b"box"]), (9000, [b"box", b"hello"])):
        b.start_block(offset)
        for k in keys:
            b.add(k)
    block = FilterBlock(HashPolicy(), b.finish())
    held = {0: [b"foo", b"bar"], 2000: [b"foo", b"bar"], 3100: [b"box"], 4100: [], 9000: [b"box", b"hello"]}
    for offset, keys in held.items():
        for k in (b"foo", b"bar", b"box", b"hello"):
            assert block.may_match(offset, k) == (k in keys), (offset, k)


def test_bloom_policy():
    policy = BloomPolicy()
    assert not policy.may_match(b"hello", policy.create([]))
    for n in (1, 2, 10, 1000):
        keys = [i.to_bytes(4, "little") for i in range(n)]
        data = policy.create(keys)
        assert len(data) <= n * 10 / 8 + 40 and all(policy.may_match(k, data) for k in keys)
        wrong = sum(policy.may_match((i + 10**9).to_bytes(4, "little"), data) for i in range(10_000))
        assert wrong <= 270


@pytest.mark.parametrize("compression", [tablefile.NONE, tablefile.SNAPPY])
@pytest.mark.parametrize("n,block_size", [(0, 4096), (1, 4096), (400, 64), (400, 1000)])
def test_table_seeks(compression, n, block_size):
    rows = entries(n)
    policy = BloomPolicy()
    data = tablefile.write_table(iter(rows), block_size, 3, compression=compression, policy=policy)
    table = tablefile.open_table(data, policy=policy)
    assert list(table.scan()) == rows and list(table.scan_back()) == rows[::-1]
    held = dict(rows)
    for target in [b"", b"\xff" * 13, *(k for k, _ in entries(120, 9))]:
        after = [e for e in rows if e[0] >= target]
        assert list(table.scan(target)) == after
        assert list(table.scan_back(target)) == [e for e in rows if e[0] < target][::-1]
        got = table.get(target)
        if target in held:
            assert got == (target, held[target])
        else:  # a filter may spare the search
            assert got is None or got == after[0]
    offsets = [table.approximate_offset_of(k) for k, _ in rows]
    assert offsets == sorted(offsets) and table.approximate_offset_of(b"\xff" * 13) == table.meta_at


def test_table_compression_saves_space_or_is_left_out():
    plain = [(f"k{i:05d}".encode(), b"v" * 200) for i in range(500)]
    noise = [(f"k{i:05d}".encode(), random.Random(i).randbytes(200)) for i in range(500)]
    for rows, saves in ((plain, True), (noise, False)):
        raw, packed = (tablefile.write_table(iter(rows), compression=c) for c in (tablefile.NONE, tablefile.SNAPPY))
        assert (len(packed) < len(raw) // 2) == saves and list(tablefile.read_table(packed)) == rows
    offset = tablefile.open_table(tablefile.write_table(iter(plain))).approximate_offset_of(b"k00250")
    assert abs(offset - 250 * 206) < 4096 + 500


def test_table_damage():
    policy = BloomPolicy()
    data = tablefile.write_table(iter(entries(300)), 200, policy=policy)
    with pytest.raises(codec.Corruption, match="too short"):
        tablefile.open_table(data[:47])
    with pytest.raises(codec.Corruption, match="magic"):
        tablefile.open_table(data[:-1] + b"x")
    with pytest.raises(codec.Corruption, match="checksum"):
        list(tablefile.read_table(bytes([data[0] ^ 1]) + data[1:]))
    meta = tablefile.open_table(data).meta_at
    broken = data[:meta] + bytes([data[meta] ^ 1]) + data[meta + 1 :]
    table = tablefile.open_table(broken, policy=policy)  # filters are not needed to read
    assert table.filters is None and list(table.scan()) == entries(300)
    with pytest.raises(codec.Corruption):
        tablefile.Block(b"\x05\0\0\0")
    builder = tablefile.TableBuilder(io.BytesIO())
    builder.add(b"b", b"")
    for key in (b"b", b"a"):
        with pytest.raises(ValueError):
            builder.add(key, b"")
    builder.abandon()
    with pytest.raises(ValueError):
        builder.add(b"c", b"")


def test_edits():
    big, edit = 1 << 50, VersionEdit()
    for i in range(4):
        assert VersionEdit.decode(edit.encode()) == edit
        edit.add_file(3, big + 300 + i, big + 400 + i, codec.pack_internal_key(b"foo", big + 500 + i, 1), codec.pack_internal_key(b"zoo", big + 600 + i, 0))
        edit.delete_file(4, big + 700 + i)
        edit.compact_pointers.append((i, codec.pack_internal_key(b"x", big + 900 + i, 1)))
    edit.comparator, edit.log_number, edit.next_file, edit.last_sequence, edit.prev_log_number = "foo", big + 100, big + 200, big + 1000, big + 99
    assert VersionEdit.decode(edit.encode()) == edit
    data = VersionEdit(last_sequence=5).encode()
    for bad in (data[:-1], b"\x08\x01", b"\x06\x07\x01", b"\x05\x01\x03abc", b"\x80"):
        with pytest.raises(codec.Corruption):
            VersionEdit.decode(bad)
    version = Version()
    version.apply(edit)
    again = Version()
    again.apply(version.snapshot())
    assert again == version and len(version.files) == 4
    with pytest.raises(codec.Corruption, match="next-file"):
        Version().check()


def test_file_numbers():
    numbers = FileNumbers(5)
    assert (numbers.new(), numbers.new()) == (5, 6)
    numbers.reuse(5)
    assert numbers.new() == 7
    numbers.reuse(7)
    numbers.mark_used(9)
    numbers.mark_used(3)
    assert numbers.new() == 10


def ops(n=300):
    r = random.Random(5)
    return [(f"k{r.randrange(40):02d}", i + 1, int(r.random() > 0.3), f"v{i}") for i in range(n)]


def model(rows, snapshot):
    state = {}
    for key, seq, vtype, value in rows:
        if seq <= snapshot:
            state[key] = value if vtype else None
    return {k: v for k, v in state.items() if v is not None}


def visible(log, snapshot):
    return {r.user_key.decode(): r.value.decode() for r in reads.snapshot_read(log.drop("file"), snapshot).collect()}


def test_store(spark, tmp_path):
    rows, path = ops(), f"file://{tmp_path}/s"
    log = spark.createDataFrame(rows, LOG)
    with pytest.raises(InvalidArgument):
        Store(spark, path)
    store = Store(spark, path, StoreOptions(create_if_missing=True, policy=BloomPolicy()))
    assert store.log().count() == 0 and store.last_sequence() == 0
    store.add(log.where("seq <= 100"), 1)
    store.add(log.where("seq > 100 and seq <= 200"))
    tail = batches.as_batches(log.where("seq > 200"), 7).withColumn("log", F.lit(store.numbers.new()).cast("long"))
    for row in logfile.write_log_files(tail).collect():
        store.folder.move_in(row.path, codec.file_name("log", row.log))
    store = Store(spark, path)
    assert store.last_sequence() == 300
    for snapshot in (1, 150, 250, 300):
        assert visible(store.log(), snapshot) == model(rows, snapshot)
    store.recover_logs()
    assert not store.logs and visible(Store(spark, path).log(), 300) == model(rows, 300)
    store.compact([150])
    again = Store(spark, path)
    assert {level for level, _ in again.tables} == {1}
    assert visible(again.log(), 150) == model(rows, 150) and visible(again.log(), 300) == model(rows, 300)
    gone = again.delete_obsolete()
    assert gone and not again.obsolete() and visible(Store(spark, path).log(), 300) == model(rows, 300)
    with pytest.raises(InvalidArgument):
        Store(spark, path, StoreOptions(error_if_exists=True))
    with pytest.raises(InvalidArgument):
        Store(spark, path, StoreOptions(comparator="other"))
    again.folder.delete(next(iter(again.tables.values())))
    with pytest.raises(codec.Corruption, match="missing"):
        Store(spark, path)


def test_get_keys_looks_ahead_for_no_key(spark):
    """Keys find their table by frames that run forward, so the cost of a lookup does not grow with the keys asked."""
    log = spark.range(1, 2001).select(F.format_string("k%04d", F.col("id")).alias("user_key"), F.col("id").alias("seq"), F.lit(1).cast("long").alias("vtype"), F.col("id").cast("string").alias("value"))
    asked = spark.range(0, 2100, 3).select(F.format_string("k%04d", F.col("id")).cast("binary").alias("user_key"))
    found = tablefile.get_keys(tablefile.write_table_files(log, policy=BloomPolicy()), asked, 1500, policy=BloomPolicy())
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedfollowing" not in plan and "generate" not in plan
    assert {bytes(r.user_key): (r.seq, bytes(r.value)) for r in found.collect()} == {b"k%04d" % i: (i, b"%d" % i) for i in range(3, 1501, 3)}


def test_logs_and_tables_are_read_piece_by_piece(spark, tmp_path, monkeypatch):
    """A log of more rows than a batch, and tables: no file is one value of a row, except where only Spark can open it."""
    path = f"file://{tmp_path}/s"
    log = spark.range(1, 25_001).select(F.format_string("k%05d", F.col("id") % 997).alias("user_key"), F.col("id").alias("seq"), (F.col("id") % 5 != 0).cast("long").alias("vtype"), F.col("id").cast("string").alias("value"))
    made = Store(spark, path, StoreOptions(create_if_missing=True))
    made.add(log.where("seq <= 1000"))
    tail = batches.as_batches(log.where("seq > 1000"), 100).withColumn("log", F.lit(made.numbers.new()).cast("long"))
    for row in logfile.write_log_files(tail).collect():
        made.folder.move_in(row.path, codec.file_name("log", row.log))

    def read():
        found = Store(spark, path).log()
        return "content:binary" in found._jdf.queryExecution().executedPlan().toString(), sorted((r.seq, bytes(r.user_key), r.vtype, r.file.endswith(".log"), bytes(r.value or b"")) for r in found.collect())

    whole, rows = read()
    assert not whole and [r[0] for r in rows] == list(range(1, 25_001))
    assert rows == [(i, b"k%05d" % (i % 997), int(i % 5 != 0), i > 1000, (b"%d" % i) if i % 5 or i <= 1000 else b"") for i in range(1, 25_001)]
    for module in (store, logfile):
        monkeypatch.setattr(module, "opens", lambda *_: False)
    assert read() == (True, rows)


def test_store_with_damaged_logs(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store = Store(spark, path, StoreOptions(create_if_missing=True))
    records = [batches.WriteBatch().put(f"k{i}".encode(), b"v" * 30_000).encode(i + 1) for i in range(6)]
    data = bytearray(logfile.frame(records))
    data[40_000] ^= 1
    store.folder.write(codec.file_name("log", store.numbers.new()), bytes(data))
    store.folder.write(codec.file_name("log", store.numbers.new()), b"\x01" * 9)
    found = Store(spark, path).log().count()
    assert 0 < found < 6
    lost = logfile.lost_bytes(spark, [f"{path}/{n}" for n in Store(spark, path).logs]).collect()
    assert {r.reason for r in lost} >= {"checksum mismatch"}
    with pytest.raises(codec.Corruption):
        Store(spark, path, StoreOptions(paranoid=True)).replayed()
    store.folder.write("CURRENT", b"MANIFEST-000001")
    with pytest.raises(codec.Corruption, match="newline"):
        Store(spark, path)


def test_write_batch():
    seen = []
    batch = batches.WriteBatch().put(b"a", b"1").delete(b"b").append(batches.WriteBatch().put(b"c", b""))
    batch.iterate(lambda k, v: seen.append((k, v)), lambda k: seen.append(k))
    assert seen == [(b"a", b"1"), b"b", (b"c", b"")] and len(batch) == 3
    assert batches.WriteBatch.decode(batch.encode(7)).ops == batch.ops and batch.approximate_size == len(batch.encode(7))
    batch.clear()
    assert batch.approximate_size == 12


def test_group_commit_keeps_syncs_and_forced_batches_apart(spark):
    rows = [(0, i, 100, sync, forced) for i, (sync, forced) in enumerate([(False, False), (False, False), (True, False), (False, False), (True, False), (False, True), (False, False)])]
    got = batches.group_commits(spark.createDataFrame(rows, "writer long, batch_id long, n_bytes long, sync boolean, forced boolean")).orderBy("batch_id").collect()
    assert [r.group_no for r in got] == [0, 0, 1, 1, 1, 2, 3]


def test_cursor(spark):
    rows = ops()
    c = Cursor(reads.snapshot_read(spark.createDataFrame(rows, LOG)))
    keys = sorted(model(rows, 300))
    assert c.first() and c.key == keys[0] and not c.prev() and not c.valid
    with pytest.raises(ValueError):
        c.next()
    assert c.seek("k10x") and c.key == next(k for k in keys if k > "k10x") and c.next() and c.prev()
    assert [r.user_key for r in c] == [k for k in keys if k > "k10x"]
    assert c.last() and c.key == keys[-1] and c.value == model(rows, 300)[keys[-1]] and not c.next() and c.status is None


def test_find_file_reads_each_row_once(spark):
    """No frame that looks ahead (each of its rows folds all that follow) and no copies of the files."""
    ends = list(range(10, 3000, 7))
    table = spark.createDataFrame([(i, f"{x:06d}") for i, x in enumerate(ends)], "number long, largest string")
    keys = [f"{i:06d}" for i in range(0, 3005)]
    found = files.find_file(table, spark.createDataFrame([(k,) for k in keys], "user_key string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedfollowing" not in plan and "generate" not in plan and "unboundedpreceding" in plan
    got = {r.user_key: r.number for r in found.collect()}
    assert got == {k: next((i for i, x in enumerate(ends) if f"{x:06d}" >= k), None) for k in keys}


def test_file_operators_against_loops(spark):
    r = random.Random(4)
    rows = []
    for number in range(60):
        a, b = sorted(f"{r.randrange(200):03d}" for _ in range(2))
        rows.append((r.randrange(4), number, r.randrange(1, 30 << 20), a, b))
    table = spark.createDataFrame(rows, "level long, number long, file_size long, smallest string, largest string")
    ranges = [(None, None), ("050", None), (None, "001"), ("120", "121"), ("300", None), (None, ""), ("7", "8")]
    got = {(x.low, x.high): x.overlaps for x in files.overlap_exists(table, spark.createDataFrame(ranges, "low string, high string")).collect()}
    assert got == {(a, b): any((a is None or f[4] >= a) and (b is None or f[3] <= b) for f in rows) for a, b in ranges}
    keys = [f"{i:03d}" for i in range(0, 210, 7)]
    got = sorted((x.user_key, x.turn, x.number) for x in files.candidate_files(table, spark.createDataFrame([(k,) for k in keys], "user_key string")).collect())
    expected = []
    for k in keys:
        held = sorted((f for f in rows if f[3] <= k <= f[4]), key=lambda f: (f[0], -f[1]))
        expected += [(k, i + 1, f[1]) for i, f in enumerate(held)]
    assert got == sorted(expected)
    asked = [(i, *x) for i, x in enumerate([(a, b) for a, b in ranges if a is None or b is None or a <= b] + [(f"{i:03d}", f"{i + 2:03d}") for i in range(0, 200, 11)])]
    levels = {x.range_id: x.level for x in files.output_level(table, spark.createDataFrame(asked, "range_id long, low string, high string")).collect()}
    for i, a, b in asked:
        over = [[f for f in rows if f[0] == n and (a is None or f[4] >= a) and (b is None or f[3] <= b)] for n in range(4)]
        level = 0
        if not over[0] and not over[1] and sum(f[2] for f in over[2]) <= 20 << 20:
            level = 2 if not over[2] and sum(f[2] for f in over[3]) <= 20 << 20 else 1
        assert levels[i] == level, (a, b)
    for level in (0, 2):
        for a, b in (("050", "060"), (None, "010"), ("190", None), ("300", "400"), (None, None)):
            got = {x.number for x in files.overlapping_inputs(table, level, a, b).collect()}
            low, high, before = a, b, None
            while True:
                taken = {f[1] for f in rows if f[0] == level and (low is None or f[4] >= low) and (high is None or f[3] <= high)}
                if level or taken == before:
                    break
                before = taken
                if taken:
                    low = None if low is None else min([low, *(f[3] for f in rows if f[1] in taken)])
                    high = None if high is None else max([high, *(f[4] for f in rows if f[1] in taken)])
            assert got == taken, (level, a, b)


def test_one_writer_at_a_time(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    one, two = KVTable(spark, path), KVTable(spark, path)
    one.put("a", "1")
    edit = one._claim()
    with pytest.raises(Busy):
        two.put("b", "2")
    one.release()
    two.put("b", "2")
    assert {r.user_key: r.seq for r in one.read().collect()} == {"a": 1, "b": 2} and edit == 2
    one.append_versions(spark.createDataFrame([("c", 9, 1, "x")], LOG), source="s", batch=4)
    one.compact()
    assert one.append_versions(spark.createDataFrame([("c", 10, 1, "y")], LOG), source="s", batch=4) == 9
    before = {r.user_key: r.value for r in one.read().collect()}
    assert len(one.trim()) == 3 and {r.user_key: r.value for r in KVTable(spark, path).read().collect()} == before == {"a": "1", "b": "2", "c": "x"}


def test_compaction_by_level(spark, tmp_path):
    t = KVTable(spark, f"file://{tmp_path}/t")
    for key, value in (("a", "1"), ("b", "2")):
        t.put(key, value)
    t.compact(level=0)
    t.delete("a")
    t.put("c", "3")
    t.compact([2], level=0)
    assert sorted((r.level, r.n_rows) for r in t.live().collect()) == [(1, 2), (1, 2)]  # the tombstone stays
    expected = {"b": "2", "c": "3"}
    assert {r.user_key: r.value for r in t.read().collect()} == expected
    t.trim()
    t.compact([2], level=1)
    again = KVTable(spark, t.path)
    assert {r.user_key: r.value for r in again.read().collect()} == expected and {r.user_key for r in again.read(2).collect()} == {"a", "b"}
    assert [r.level for r in again.live().collect()] == [2]


def test_file_name_columns(spark):
    names = ["100.log", "000007.ldb", "0.sst", "MANIFEST-000012", "18446744073709551615.log", "18446744073709551616.log", "184467440737095516150.log", "CURRENT", "LOG.old", "x.log", "-1.log", ""]
    rows = spark.createDataFrame([(n,) for n in names], "name string").withColumn("f", codec.file_name_columns(F.col("name"))).collect()
    assert {r.name: None if r.f is None else (r.f.kind, int(r.f.number)) for r in rows} == {n: codec.parse_file_name(n) for n in names}


def test_varint_length_at_its_edges(spark):
    numbers = [0, *(x for n in range(1, 10) for x in ((1 << 7 * n) - 2, (1 << 7 * n) - 1)), *((1 << 7 * n) for n in range(1, 9))]
    rows = spark.createDataFrame([(x,) for x in numbers], "x long").select("x", codec.varint_length(F.col("x")).alias("n")).collect()
    assert {r.x: r.n for r in rows} == {x: len(codec.put_varint(x)) for x in numbers}


@pytest.mark.parametrize("reuse", [False, True])
def test_store_writes(spark, tmp_path, reuse):
    store = Store(spark, f"file://{tmp_path}/s", StoreOptions(create_if_missing=True, reuse_log=reuse))
    assert store.write(batches.WriteBatch().put(b"a", b"1").put(b"b", b"2")) == 2
    assert store.write(batches.WriteBatch()) == 2
    assert store.write(batches.WriteBatch().delete(b"a").put(b"c", b"x" * 40_000)) == 4
    again = Store(spark, store.folder.path)
    assert len(again.logs) == (1 if reuse else 2) and again.last_sequence() == 4
    assert again.get(b"c") == b"x" * 40_000 and again.get(b"a", 2) == b"1"
    with pytest.raises(NotFound):
        again.get(b"a")


def test_data_sources(spark, tmp_path):
    rows, path = ops(), f"file://{tmp_path}/s"
    log = spark.createDataFrame(rows, LOG)
    store = Store(spark, path, StoreOptions(create_if_missing=True))
    store.add(log.where("seq <= 200"), 1)
    store.write(batches.WriteBatch().put(b"logged", b"y"))
    datasource.register(spark)
    tables = spark.read.format("tidemark_table").load(path)
    expected = {(k.encode(), s, v, (x if v else "").encode()) for k, s, v, x in rows if s <= 200}
    log_values = {(k.encode(), s): x.encode() for k, s, v, x in rows}
    got = {(bytes(r.user_key), r.seq, r.vtype, bytes(r.value) if r.vtype else b"") for r in tables.collect()}
    assert got == expected and log_values
    some = tables.where((F.col("user_key") >= F.lit(b"k10")) & (F.col("user_key") < F.lit(b"k13")))
    assert {(bytes(r.user_key), r.seq) for r in some.collect()} == {(k, s) for k, s, _, _ in expected if b"k10" <= k < b"k13"}
    reader = datasource.TableReader(path)
    list(reader.pushFilters([datasource.EqualTo(("user_key",), b"k10")]))
    assert {r["user_key"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()} <= {b"k10"}
    assert [(bytes(r.user_key), r.seq) for r in spark.read.format("tidemark_log").load(path).collect()] == [(b"logged", 201)]


def test_cache_hits_misses_and_erasure():
    gone, cache = [], LRUCache(1000)
    for key, value in ((100, 101), (200, 201), (100, 102)):
        cache.release(cache.insert(key, value, 1, lambda k, v: gone.append((k, v))))
    assert gone == [(100, 101)] and cache.lookup(300) is None
    held = cache.lookup(100)
    assert held.value == 102
    cache.erase(100)
    assert cache.lookup(100) is None and gone == [(100, 101)]  # held, so still there
    cache.release(held)
    assert gone[-1] == (100, 102)
    cache.erase(7)
    cache.prune()
    assert gone[-1] == (200, 201) and cache.total_charge == 0


def test_cache_evicts_what_was_used_least_recently():
    cache = LRUCache(100)
    for key in ("often", "once", "held"):
        held = cache.insert(key, key)
        if key != "held":
            cache.release(held)
    for i in range(300):
        cache.release(cache.insert(i, i))
        cache.release(cache.lookup("often"))
    assert cache.lookup("once") is None and cache.lookup("held").value == "held" and cache.total_charge == 100
    none = LRUCache(0)
    entry = none.insert(1, 1, 1, lambda k, v: None)
    assert none.lookup(1) is None and entry.value == 1


def test_sharded_cache_stays_near_its_capacity():
    cache, light, heavy = ShardedCache(1000), 1, 10
    for i in range(2000):
        cache.release(cache.insert(i, 1000 + i, light if i & 1 else heavy))
    kept = [i for i in range(2000) if (e := cache.lookup(i)) and (cache.release(e) or e.value == 1000 + i)]
    weight = sum(light if i & 1 else heavy for i in kept)
    assert 0 < weight == cache.total_charge <= 1100
    assert cache.new_id() != cache.new_id()


def test_blocks_are_read_once():
    data = tablefile.write_table(iter(entries(300)), 200)
    blocks = ShardedCache(1 << 20)
    table = tablefile.open_table(data, blocks=blocks)
    assert list(table.scan()) == entries(300)
    table.stream = None  # nothing is read again
    assert list(table.scan()) == entries(300) and blocks.total_charge > 0


def test_store_in_memory(spark):
    folder = MemoryFolder()
    store = Store(spark, "memory", StoreOptions(create_if_missing=True), folder)
    folder.write("x", b"1")
    folder.rename("x", "y")
    assert folder.read("y") == b"1" and not folder.exists("x")
    for wrong in (lambda: folder.read("x"), lambda: folder.delete("x")):
        with pytest.raises(NotFound):
            wrong()
    folder.delete("y")
    assert Store(spark, "memory", folder=folder).version == store.version and folder.names() == ["CURRENT", "MANIFEST-000001"]
