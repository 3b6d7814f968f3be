"""From raw documents to packed sequences, stage by stage.

Each stage is written as Parquet and read again as the input of the next. A stage
takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from logweir.llm import fm_quality, near_dups, packing, quality_rules, suffix_dedup
from logweir.llm.common import shipped, table, working_dir


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.accepted(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more; learned from labels outside the held-out third.

    The model is that of the whole table: of bad documents the rules leave hardly any.
    """
    return fm_quality.accepted(docs, table(spark, sf_dir, "labels"), learned_from=table(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest doc_id."""
    shipped(spark)
    return near_dups.kept(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without bytes of strings that occur more than once.

    ``n_chars`` is that of the text that is left.
    """
    shipped(spark)
    return suffix_dedup.deduplicated(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences of 1024 tokens."""
    shipped(spark)
    return packing.packed(docs)


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("packing", sequences),
]

#: Models and tokens are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    base = f"{working_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
