"""A training-data pipeline over ``documents``, made of the operators in ``quillsieve.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillsieve.llm import linededup, mixing, packing, quality, simhash
from quillsieve.llm.common import scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier one; those left without a word go."""
    return linededup.remove_lines(docs, count_col="n_chars", least=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id: SimHash of 5-word shingles, its links verified by a Jaccard similarity of 0.8, then an exact join for copies whose fingerprints lie too far apart."""
    return simhash.keep_one(docs, width=5, exact=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: a row for each piece of a document."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("mixing", mix_sources), ("packing", pack)]

#: Quantile sketches, XXH64 fingerprints and tokenizers have no equal in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch(docs, f"pipeline-{k}")
    return docs
