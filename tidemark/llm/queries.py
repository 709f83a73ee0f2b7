"""The contract queries of the ten operators, and their SQL where it can say them.

Each query is thin: it applies its operator with production parameters to a whole
table and derives the contract's digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, id_files, langid, ngram_join, secrets, token_counts, topk, url_filters, warc

Query = Callable[[SparkSession, str], DataFrame]
MULTI, PLAIN, PLAIN_JSON = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
#: The id appended to each document in token files.
END = 2
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs, ~langid.held_out())
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    named = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", named.alias("items_sha256"), (F.col("n_items") >= 2).alias("contaminated"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = token_counts.length_histogram(_table(spark, sf_dir, "documents"), public_tokenizers.path(PLAIN))
    return token_counts.suffix_sums(histogram)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = id_files.write_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path(PLAIN_JSON), end=END)
    return id_files.document_digests(manifest)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(MULTI))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(_table(spark, sf_dir, "documents"))
    base = F.sha2(secrets.joined_names(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), secrets.joined_names(F.col("spans")).alias("spans"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.last_chunks(warc.read_archives(manifest, data=False))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.inline(F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in URL_RULES)))
    rules = spark.range(1).select(rules)
    return url_filters.judge(_table(spark, sf_dir, "pages"), rules)


def queries() -> dict[str, Query]:
    from corpus_pipeline import run

    return {
        "op1_topk": op1_topk,
        "op2_language": op2_language,
        "op3_decontamination": op3_decontamination,
        "op4_ngram_join": op4_ngram_join,
        "op5_token_counts": op5_token_counts,
        "op6_token_files": op6_token_files,
        "op7_bpe": op7_bpe,
        "op8_secrets": op8_secrets,
        "op9_warc": op9_warc,
        "op10_url_filters": op10_url_filters,
        "pipeline": run,
    }


_OP1 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10
"""

_LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP10 = f"""
WITH p AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM p),
u AS (SELECT page_id, {_LOWERED.format("raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM h),
rules(rh, rp, v) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
m AS (SELECT u.page_id, rh || rp AS rule, v, row_number() OVER (PARTITION BY u.page_id ORDER BY length(rh || rp) DESC) AS k
      FROM u JOIN rules ON (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM u LEFT JOIN m ON m.page_id = u.page_id AND m.k = 1
"""


def oracle_sql() -> dict[str, str]:
    """Two of the ten; the others have brute-force tests in tests/llm."""
    return {"op1_topk": _OP1, "op10_url_filters": _OP10}
