"""Change logs, runs and file metadata derived from the driver's tables, and the
same derivations as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_KEYS, BATCH = 1024, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_key(column: str) -> Column:
    return F.concat(F.lit("u"), F.lpad(F.col(column).cast("string"), 6, "0"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many versions per key; errors are tombstones."""
    rows = table(spark, sf_dir, "events")
    return rows.select(user_key("user_id").alias("user_key"), (F.col("event_id") + 1).alias("seq"), F.when(F.col("event_type") == "error", 0).otherwise(1).cast("long").alias("vtype"), F.col("props").alias("value"))


def order_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique keys in files of fixed key ranges."""
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.floor(F.col("o_orderkey") / FILE_KEYS).alias("file"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("user_key"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("value"))


def part_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made unique by the part key, in files by first letter."""
    rows = table(spark, sf_dir, "part")
    return rows.select(F.ascii("p_name").cast("long").alias("file"), F.concat("p_name", F.lit("#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("user_key"), F.col("p_type").alias("value"))


def file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each 512 orders: disjoint key ranges over four levels."""
    rows = table(spark, sf_dir, "orders").withColumn("number", F.floor(F.col("o_orderkey") / 512))
    key = F.lpad(F.col("o_orderkey").cast("string"), 10, "0")
    files = rows.groupBy("number").agg(F.sum(F.floor("o_totalprice")).alias("file_size"), F.min(key).alias("smallest"), F.max(key).alias("largest"))
    return files.select((F.col("number") % 4).alias("level"), "number", "file_size", "smallest", "largest")


def loose_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each 50 orders: overlapping ranges on level 0."""
    rows = table(spark, sf_dir, "orders").withColumn("number", F.floor(F.col("o_orderkey") / 50))
    low, high = F.min("o_orderkey"), F.min("o_orderkey") + F.max("o_custkey") % 97
    files = rows.groupBy("number").agg(low.alias("low"), high.alias("high"))
    return files.select(F.lit(0).cast("long").alias("level"), "number", F.lpad(F.col("low").cast("string"), 10, "0").alias("smallest"), F.lpad(F.col("high").cast("string"), 10, "0").alias("largest"))


#: The same as SQL.
CTES = {
    "e": "SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS user_key, event_id + 1 AS seq, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS BIGINT) AS vtype, props AS value FROM events",
    "o": f"SELECT o_orderkey // {FILE_KEYS} AS file, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS user_key, o_orderkey AS seq, o_orderpriority AS value FROM orders",
    "n": "SELECT CAST(ascii(p_name) AS BIGINT) AS file, p_name || '#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS user_key, p_type AS value FROM part",
    "r": "SELECT (o_orderkey // 512) % 4 AS level, o_orderkey // 512 AS number, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS file_size, min(lpad(CAST(o_orderkey AS VARCHAR), 10, '0')) AS smallest, max(lpad(CAST(o_orderkey AS VARCHAR), 10, '0')) AS largest FROM orders GROUP BY ALL",
    "l": "SELECT CAST(0 AS BIGINT) AS level, o_orderkey // 50 AS number, lpad(CAST(min(o_orderkey) AS VARCHAR), 10, '0') AS smallest, lpad(CAST(min(o_orderkey) + max(o_custkey) % 97 AS VARCHAR), 10, '0') AS largest FROM orders GROUP BY number",
}


def sql(body: str, *names: str, recursive: bool = False, **more: str) -> str:
    """``body`` after the named derivations and further ones in order."""
    parts = [f"{n} AS ({CTES[n]})" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)} {body}" if parts else body
