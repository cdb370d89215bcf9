"""From raw documents to packed token sequences: quality rules, near copies, personal data, packing.

Each stage works on all rows the one before kept; its result is written as
Parquet below the shared folder and read again. The first three stages return
the columns of ``documents``; the last returns the pieces of the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import near_copies, packing, pseudonyms, quality
from threadloom.llm.queries import TRIAL_KEY
from threadloom.llm.tables import table
from threadloom.session import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_copies.keep_one(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal numbers and dates under pseudonyms."""
    return pseudonyms.replace_personal(docs, key=spark.conf.get(pseudonyms.KEY_SETTING, TRIAL_KEY))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_copies", near_copy_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: No SQL: tokens and links of near copies are checked against brute force in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
