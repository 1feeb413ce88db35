"""From raw documents to packed training windows: quality, near copies, repeated passages, mix, packing.

Each stage is a function of (spark, docs, sf_dir) to a DataFrame. :func:`run` writes every stage's result as Parquet to
the shared folder and reads it again as the next stage's documents. All stages but the last return the columns of
``documents``; each works on everything its predecessor kept. Nulls, empty and repeated rows, empty tables and extra
columns are handled as the operators' docstrings say; a null text is rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packetloom.llm import mixing, packing, quality, simhash, substrings
from packetloom.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality.passing(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return simhash.one_of_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word passages that an earlier document has."""
    return substrings.without_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents are left out or repeated, at most twice."""
    return mixing.mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows; a document that is repeated is packed each time."""
    return packing.pieces_with_crc(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: XXH64 fingerprints, their components and token ids are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
