"""A training corpus from raw documents: one operator per stage, written between stages.

A stage takes all documents that the one before it kept and returns documents again; the
last one returns the pieces of the packed sequences. Nulls, repeated rows and empty tables
are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtables.llm import decontamination, language, minmax, packing, pii
from flowtables.session import written
from flowtables.sources.tables import read_table


def language_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without text or letters go."""
    return language.identify(docs).where("has_letters").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 percent of its 5-word shingles."""
    return minmax.keep_one(docs, shingle=5, similarity=80).select(docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontamination.contaminated(docs, read_table(spark, sf_dir, "benchmark"), items="_items")
    return found.where(F.size("_items") == 0).select(docs.columns)


def personal_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with labels for personal data; n_chars follows the text."""
    masked = pii.mask(docs)
    length = F.when(F.col("text").isNotNull(), F.length("text").cast("long"))
    return masked.withColumn("n_chars", length).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048."""
    return packing.pack(docs)


STAGES = [
    ("language", language_known),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark_free),
    ("personal_data", personal_data_masked),
    ("packing", packed),
]

#: Language identification and packing are not expressible in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
