"""A corpus pipeline in five stages, each one of the operators in tidemark.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and reread as the next stage's docs; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, langid, ngram_join, secrets
from tidemark.runtime import keep

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected when no language holds at least this share of it.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus stay; those without a letter (null and
    empty texts too), or in which no language holds half, go.  Ids are not looked
    at, repeated rows are judged alike, and an empty table stays empty."""
    model = langid.train(docs, ~langid.held_out())
    found = langid.predict(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, 0.8) stays:
    the one with the smallest id.  Wordless texts are no copies of each other and
    stay, as do rows with a null id; rows that repeat an id stay or go together."""
    return ngram_join.keep_one_of_each(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go, whatever their id: null
    and repeated ids are judged row by row, null texts stay, no items drop nothing."""
    return decontam.without_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in it, and parts linked to them, are masked, and
    n_chars is counted anew where a text changed.  Null and empty texts stay."""
    return secrets.redact(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes they decode to, for
    every row; a null text has no ids, a null id stays."""
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", decontaminate),
    ("secret scans", scan_secrets),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL cannot express the language model or the merges; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs, f"stage-{i + 1}")
    return docs
