"""A training corpus from ``documents``: five stages, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``, whatever
further columns there are and whatever they are called.

Defined results for odd input: rows with null or empty text fail the quality rules and go; null language or source is a
group of its own in the quality rules and a source of its own in the mixture; rows without doc_id pass the near-duplicate
stage, as they are never linked; rows that share a doc_id are judged by their own texts, and of equal ones one stays; of a
group of near duplicates the smallest id stays (ties: by text, then by the other columns); texts of any length are read
whole; an empty table passes as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.llm import bpe, jaccard, mixing, quality, secrets
from caseload.session import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust distance reject go."""
    return quality.accepted(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return jaccard.first_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, plain or wrapped, are masked in place; every document stays."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as its source's budget has it pass: once at least, twice at most."""
    return mixing.mixed_rows(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, and whether they decode to its bytes."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.encode(spark, docs, ranks, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source", "text"], with_decoded=True)
    return both.select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip")
    )


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", jaccard_join),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mixing),
    ("byte-level bpe", byte_bpe),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
