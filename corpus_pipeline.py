"""A training-data pipeline over ``documents``: five operators, one after the other.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before
it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import common as C
from textloom.llm import importance, near_dup, packing, quality_rules, secrets


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the quality rules reject go."""
    C.ship(spark)
    return quality_rules.keep(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that importance resampling doesn't draw go."""
    return importance.kept(docs, C.table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9 on five-word shingles, links from 80 %: one document of each group of near-duplicates stays."""
    C.ship(spark)
    return near_dup.deduplicated(docs, shingle=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: secrets are overwritten in the text."""
    C.ship(spark)
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the documents' tokens in sequences along the curve."""
    C.ship(spark)
    return packing.pack(docs)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("near duplicates", one_of_each), ("secret scans", without_secrets), ("packing", packed)]

#: Tokenised sequences can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    folder = f"{C.ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = C.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
