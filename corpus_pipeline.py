"""A corpus pipeline: quality rules, line de-duplication, near-duplicate removal, secret redaction, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but the last return the columns
of documents. Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns are taken as the operators that
the stages call say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from permafield.llm import common, linededup, neardup, packing, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted by the removal of boilerplate lines, without those lines."""
    common.small_batches(spark)
    return quality.cut_lines(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component of similar lines stays; documents left without a word go."""
    return linededup.remove_lines(docs, as_read=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates on 5-word shingles stays."""
    common.small_batches(spark, 400)
    return neardup.keep_one(docs, n=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become marks."""
    common.small_batches(spark)
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids."""
    import public_tokenizers

    common.small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 1)


STAGES = [("quality", quality_rules), ("lines", line_dedup), ("neardup", near_dedup), ("secrets", secret_scan), ("packing", pack)]

#: The field of the secret scan and the tokenizer cannot be written in SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        common.drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)
