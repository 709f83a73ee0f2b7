"""Connected components of a link table by alternating star contraction.

Large-star links every larger neighbour of a node to the node's smallest
neighbour, small-star every smaller one; the rounds end when the edges stop
changing.  Each round is two partial aggregates and two joins whose result is
written to the shared folder, so no union-find runs on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import drop, keep


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Edges (u, v) with u > v after one large-star or small-star step."""
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = both.join(low, "u")
    if larger:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of ``links``; component is its smallest node.

    Links that repeat, run both ways or join a node to itself do no harm; rows
    with a null end are left out; no links give no rows.
    """
    clean = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = keep(clean.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")

    def state(df: DataFrame) -> tuple:
        """Two edge sets of the same count and checksum are taken as equal."""
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        last, edges = edges, keep(_star(_star(edges, True), False), "links")
        drop(last)
        now = state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
