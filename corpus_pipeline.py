"""From raw documents to packed sequences: quality, exact copies, near copies, personal data, packing.

Each stage takes (spark, documents, folder of the tables) and returns a DataFrame; all but the last return the
columns of the documents. Stages meet as Parquet tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stallwise.llm import exact_dedup, near_dedup, packing, pii, quality
from stallwise.llm.base import table
from stallwise.workspace import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Identifiers in the texts are masked."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents' chunks with their bins and offsets."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("packing", packed),
]

# outlier estimates, signatures, deobfuscation and packing are not SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
