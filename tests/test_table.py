import random

import pytest
from pyspark.sql import functions as F

from tidemark.errors import Closed, InvalidArgument, NotFound
from tidemark.operators import reads
from tidemark.streaming import ingest
from tidemark.table import KVTable, Options

LOG = "user_key string, seq long, vtype long, value string"


def model_read(ops, snapshot):
    state = {}
    for key, seq, vtype, value in sorted(ops, key=lambda o: o[1]):
        if seq <= snapshot:
            state[key] = value if vtype else None
    return {k: v for k, v in state.items() if v is not None}


@pytest.fixture(scope="module")
def ops():
    r = random.Random(3)
    return [(f"k{r.randrange(20):02d}", i + 1, int(r.random() > 0.3), f"v{i}") for i in range(200)]


def test_reads_follow_the_model(spark, ops):
    log = spark.createDataFrame(ops, LOG)
    for snapshot in (0, 1, 57, 200):
        got = {r.user_key: r.value for r in reads.snapshot_read(log, snapshot).collect()}
        assert got == model_read(ops, snapshot)
    keys = sorted(model_read(ops, 200))
    assert [r.user_key for r in reads.scan(log).orderBy("position").collect()] == keys
    assert [r.user_key for r in reads.scan(log, backward=True).orderBy("position").collect()] == keys[::-1]
    near = {r.user_key: (r.prev_key, r.next_key) for r in reads.neighbours(reads.snapshot_read(log)).collect()}
    assert near == {k: (keys[i - 1] if i else None, keys[i + 1] if i + 1 < len(keys) else None) for i, k in enumerate(keys)}
    assert [r.user_key for r in reads.seek(reads.snapshot_read(log), "k10x").collect()] == [next(k for k in keys if k >= "k10x")]


@pytest.mark.parametrize("split", [1, 7, 1 << 16])
def test_versions_of_a_hot_key_are_split(spark, ops, split, monkeypatch):
    monkeypatch.setattr(reads, "SPLIT", split)
    hot = ops + [("hot", i + 300, int(i % 5 > 0), f"h{i}") for i in range(150)]
    log = spark.createDataFrame(hot, LOG)
    probes = [(k, s) for k in ("hot", "k03", "nobody") for s in (0, 1, 57, 200, 301, 333, 9000)]
    got = {(r.user_key, r.probe_seq): (r.seq, r.value) for r in reads.as_of_get(log, spark.createDataFrame(probes, "user_key string, probe_seq long")).collect()}
    expected = {}
    for key, at in probes:
        seen = max(((s, v, x) for k, s, v, x in hot if k == key and s <= at), default=None)
        if seen and seen[1]:
            expected[key, at] = (seen[0], seen[2])
    assert got == expected
    ranks = {(r.user_key, r.seq): r.version for r in reads.internal_scan(log).collect()}
    assert ranks == {(k, s): sum(k == a and t >= s for a, t, _, _ in hot) for k, s, _, _ in hot}


def test_compaction_keeps_retained_snapshots(spark, ops):
    log = spark.createDataFrame(ops, LOG)
    kept = reads.compact(log, [50, 120, 200])
    for snapshot in (50, 120, 200):
        assert {r.user_key: r.value for r in reads.snapshot_read(kept, snapshot).collect()} == model_read(ops, snapshot)
    assert kept.count() < len(ops)


def test_table(spark, ops, tmp_path):
    path = f"file://{tmp_path}/t"
    t = KVTable(spark, path)
    rows = [(i, v, k, x) for i, (k, _, v, x) in enumerate(ops)]
    assert t.write(spark.createDataFrame(rows, "pos long, vtype long, user_key string, value string")) == 200
    snap = t.snapshot()
    assert t.put("new", "value") == 201 and t.get("new") == "value"
    t.delete("new")
    with pytest.raises(NotFound):
        t.get("new")
    assert t.get("new", 201) == "value"
    before = {r.user_key: r.value for r in t.read(snap).collect()}
    assert before == model_read(ops, 200)
    t.compact([snap])
    again = KVTable(spark, path)
    assert {r.user_key: r.value for r in again.read(snap).collect()} == before
    assert again.live().count() == 1 and again.obsolete().count() == 3
    assert again.last_sequence() == 202
    with pytest.raises(InvalidArgument):
        KVTable(spark, path, Options(error_if_exists=True))
    with pytest.raises(NotFound):
        KVTable(spark, path + "x", Options(create_if_missing=False))
    again.close()
    with pytest.raises(Closed):
        again.read()


def test_ingest_is_idempotent(spark, ops, tmp_path):
    spark.createDataFrame(ops, LOG).write.parquet(f"{tmp_path}/in")
    t = KVTable(spark, f"file://{tmp_path}/t")
    for run in ("a", "b"):
        stream = spark.readStream.schema(LOG).parquet(f"{tmp_path}/in")
        ingest.ingest(stream, t, f"{tmp_path}/cp-{run}").awaitTermination()
        assert t.log().count() == len(ops)
    assert {r.user_key: r.value for r in t.read().collect()} == model_read(ops, 200)


def test_streaming_newest(spark, ops, tmp_path):
    spark.createDataFrame(ops, LOG).write.parquet(f"{tmp_path}/in")
    stream = ingest.newest_per_key(spark.readStream.schema(LOG).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("newest").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {r.user_key: r.value for r in spark.table("newest").where(F.col("vtype") == 1).collect()}
    assert got == model_read(ops, 200)
