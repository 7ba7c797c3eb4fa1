"""The corpus pipeline: quality, near duplicates, benchmark passages, secrets, token counts.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept; its
result is written to the shared folder and read again. All but the last return the columns of
``documents``; where a stage changes a text, ``n_chars`` follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obscat.llm.bpe import encode_decode, vocabulary_path
from obscat.llm.decontam import leaks
from obscat.llm.dedup import near_duplicates
from obscat.llm.quality import score_quality, trusted_ids
from obscat.llm.registry import table
from obscat.llm.secrets import find_secrets
from obscat.llm.store import written

KEY = "_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a row number of its own; it is stable, as stages read written tables."""
    return docs.withColumn(KEY, F.monotonically_increasing_id())


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose perplexity is above the limit of their language; empty ones go too."""
    scored = score_quality(_numbered(docs).select(KEY, "doc_id", "lang", "text"), trusted_ids(table(spark, sf_dir, "labels")))
    return _keep(docs, scored.where("kept").select(KEY))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every group that shares 80 per cent of its five-word shingles.

    Of repeated rows with one id and text one stays.
    """
    found = near_duplicates(_numbered(docs).select(KEY, "doc_id", "text"))
    once = found.where("kept").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col(KEY)).alias("own")).agg(F.min(KEY).alias(KEY))
    return _keep(docs, once.select(KEY))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    found = leaks(_numbered(docs).select(KEY, "text"), table(spark, sf_dir, "benchmark"), id_column=KEY)
    return _keep(docs, found.select(KEY).distinct(), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in texts."""
    clean = find_secrets(docs, redact=True).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document that is left."""
    return encode_decode(docs.select("doc_id", "text"), vocabulary_path())


def _keep(docs: DataFrame, rows: DataFrame, how: str = "left_semi") -> DataFrame:
    return _numbered(docs).join(rows.hint("merge"), KEY, how).select(*docs.columns)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("tokens", tokens),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
