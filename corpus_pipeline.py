"""Corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, piece ids.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of
docs. Results are written as Parquet in the shared folder and read again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from decision_lens.llm import chunk_dedup, decontaminate, pieces, rules, superminhash
from decision_lens.llm.textkit import importable
from decision_lens.session import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the limits of their language and source."""
    return rules.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies (five-word shingles, similarity 0.8)."""
    return superminhash.distinct_documents(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id holds too."""
    return chunk_dedup.without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with sampled piece ids, and the text that the ids decode to."""
    return pieces.encoded(docs, drop_text=True, decoded="text").select(*docs.columns, "ids")


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("substring dedup", substring_dedup),
          ("benchmark decontamination", benchmark_decontamination), ("piece ids", piece_ids)]
#: Near-duplicate groups by SuperMinHash and content-defined chunks are not expressible in SQL; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
