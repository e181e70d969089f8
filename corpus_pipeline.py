"""A corpus pipeline: quality, exact copies, near copies, benchmark leaks, packing.

Each stage works on all documents that its predecessor kept. Stages are functions of
(spark, docs, sf_dir); all but the last return the columns of ``documents``, the last returns the
pieces of packed sequences. Documents whose text is null or empty are judged like any other: the
classifier scores them as texts without features, they are exact copies of each other, have no
near copies or leaks, and are packed as the end id alone. Rows that repeat an id are judged one by one;
rows with a null id go through all stages but exact dedup unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedback_points.llm.common import stage
from feedback_points.llm.decontaminate import decontaminate
from feedback_points.llm.exact_dedup import exact_dedup
from feedback_points.llm.near_dedup import near_dedup
from feedback_points.llm.packing import pack
from feedback_points.llm.quality import quality_filter
from feedback_points.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_filter(docs, labels)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return near_dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs, vocabulary())


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: The classifier and the packing have no SQL twin; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = stage(step(spark, docs, sf_dir), f"stage{k}")
    return docs
