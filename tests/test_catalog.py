"""Every query of the engine against its SQL, at the smallest scale."""

import decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.plans import catalog
from tidemark.runtime import keep

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return int(value) if isinstance(value, decimal.Decimal) else value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.ORACLE_SQL:
        assert name == "checksum_verify" and [r[1] for r in got] == [True]
        return
    found = oracle.sql(catalog.ORACLE_SQL[name])
    names = found.columns
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall()), key=repr)


def test_varint_len_past_five_bytes(spark, tmp_path):
    keys = [1, 2083, 2084, 23_570, 266_000, 3_018_000, 34_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: r.n for r in catalog.QUERIES["varint_len"](spark, str(tmp_path)).collect()}
    assert got == {k: len(codec.put_varint(k * k * 7919)) for k in keys} and max(got.values()) == 9


def _bytes_of(x):
    return max(1, -(-x.bit_length() // 7)) if x > 0 else 1


def test_varint_widths_past_63_bits(spark, tmp_path):
    """At 1 GB keys pass 2**21, and 2**21 shifted by 42 bits is 2**63."""
    keys = [0, 1, (1 << 21) - 1, 1 << 21, (1 << 21) + 1, 1 << 22, 8_999_999, 53_999_999, 1 << 28, (1 << 28) + 1, (1 << 63) - 1]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {(r.o_orderkey, r.step): r.n for r in catalog.QUERIES["varint_widths"](spark, str(tmp_path)).collect()}
    assert got == {(k, s): _bytes_of((k << s) - 1) for k in keys for s in range(0, 43, 7)}


def test_varint_len_past_63_bits(spark, tmp_path):
    keys = [0, 34_127_908, 34_128_000, 53_999_999, 4_000_000_000, 100_000_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: r.n for r in catalog.QUERIES["varint_len"](spark, str(tmp_path)).collect()}
    assert got == {k: _bytes_of(k * k * 7919) for k in keys}


def test_checksum_verify_reports_payloads_altered_in_the_store(spark, monkeypatch):
    """Every seventh value is altered after its checksum was taken."""
    value = F.when(F.col("seq") % 7 == 0, F.lit("altered")).otherwise(F.col("value"))
    monkeypatch.setattr(catalog, "keep", lambda df, label: keep(df.withColumn("value", value), label), raising=False)
    seqs = [r[0] for r in spark.read.parquet(str(DATA / "orders.parquet")).select("o_orderkey").collect()]
    bad = sum(s % 7 == 0 for s in seqs)
    got = {r.ok: r.n for r in catalog.QUERIES["checksum_verify"](spark, str(DATA)).collect()}
    assert got == {True: len(seqs) - bad, False: bad} and bad
