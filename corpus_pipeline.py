"""A training-data pipeline: quality rules, exact dedup, near-dedup, mixing, packing.

Each stage works on all rows that the stage before it kept, whole texts, and its decisions take effect: rejected
documents and copies go, the mix repeats or leaves out documents, and packing cuts what is left into sequences.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from granary.llm.common import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier distance reject go."""
    return quality_rules.drop_outliers(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, one row stays."""
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a sequence."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]

#: SQL can express neither the distances of the first stage nor the classes of the third; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
