"""Exact length histogram: how many documents have each encoded length.

Documents are reduced to (length, count) within each task, so what is shuffled
is bounded by the number of distinct lengths.  Suffix sums over the histogram
(two levels: within buckets of lengths, and over bucket totals) answer totals,
quantiles and truncated totals for every context limit without the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import keep
from tidemark.llm.bpe import count_tokens

#: Lengths in one bucket of the two-level sums.
BUCKET = 512


def length_histogram(docs: DataFrame, ranks_path: str, *, text_col: str = "text") -> DataFrame:
    """(length, n_docs): exact counts over all rows; a null text has length 0,
    rows that repeat count each, an empty table gives no rows."""
    counts = count_tokens(docs, ranks_path, text_col=text_col).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
    return keep(counts, "token-lengths")  # small, and read more than once


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L: n_docs and n_tokens of that length, docs_at_least and
    tokens_at_least over lengths >= L, docs_below and tokens_below over lengths
    < L, and truncated_total, the tokens left when every text is cut at L.

    The window over bucket totals has one row for each BUCKET lengths that occur;
    the windows over lengths are split by bucket.
    """
    rows = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / BUCKET).alias("bucket"))
    totals = rows.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("bucket", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_{n}") for c in "dt" for n, w in (("above", above), ("below", below))))
    inside = Window.partitionBy("bucket").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("bucket").orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(totals, "bucket").select(
        "length",
        "n_docs",
        "n_tokens",
        (F.col("d_above") + F.sum("n_docs").over(inside)).alias("docs_at_least"),
        (F.col("t_above") + F.sum("n_tokens").over(inside)).alias("tokens_at_least"),
        (F.col("d_below") + F.coalesce(F.sum("n_docs").over(before), F.lit(0))).alias("docs_below"),
        (F.col("t_below") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).alias("tokens_below"),
    )
    return out.withColumn("truncated_total", F.col("tokens_below") + F.col("length") * F.col("docs_at_least"))


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, total): tokens left when every text is cut at each limit, for
    any limits, whether or not a text has that length.

    A limit is looked up in the suffix sums: the least length that reaches it has
    the same documents at or above it and the same tokens below it.  One partial
    aggregate serves all limits.  A limit above all lengths leaves all tokens; an
    empty histogram leaves none; limits that repeat are one.
    """
    asked = sorted({int(x) for x in limits})
    if not asked:
        return sums.sparkSession.createDataFrame([], "context_limit long, total long")
    reach = F.struct("length", "docs_at_least", "tokens_below")
    found = sums.agg(
        F.max("tokens_at_least").alias("all"),
        *(F.min(F.when(F.col("length") >= limit, reach)).alias(f"at{i}") for i, limit in enumerate(asked)),
    )
    rows = (
        F.struct(
            F.lit(limit).cast("long").alias("context_limit"),
            F.coalesce(F.col(f"at{i}.tokens_below") + F.lit(limit) * F.col(f"at{i}.docs_at_least"), F.col("all"), F.lit(0)).cast("long").alias("total"),
        )
        for i, limit in enumerate(asked)
    )
    return found.select(F.inline(F.array(*rows)))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least that share of documents do
    not exceed; no rows for an empty histogram."""
    total = F.col("docs_below") + F.col("docs_at_least")
    return sums.agg(*(F.min(F.when(F.col("docs_below") + F.col("n_docs") >= F.lit(q) * total, F.col("length"))).alias(f"q{i}") for i, q in enumerate(shares))).select(
        F.inline(F.array(*(F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("length")) for i, q in enumerate(shares))))
    ).where("length is not null")
