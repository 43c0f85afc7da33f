"""From documents to packed training sequences: ordered stages, each working on all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which the caller writes as Parquet and reads
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.llm import arrays, decontamination, language, near_duplicates, packing, private, queries
from postsieve.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give documents without ``lang`` the predicted one, and drop null texts and texts without a letter, which have none.

    Languages are learned from the labelled documents; where there are none, ``lang`` stays null and all texts with a
    letter stay. A label that is there is kept, whatever the prediction.
    """
    arrays.prepare(spark)
    classifier = language.Classifier(*language.labelled_sample(docs))
    found = language.with_language(docs.select(*COLUMNS), classifier).filter(F.col("text").rlike(r"\p{L}"))
    if classifier.languages:
        found = found.withColumn("lang", F.coalesce("lang", "lang_pred"))
    return found.select(*COLUMNS)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    arrays.prepare(spark)
    return near_duplicates.drop_near_duplicates(docs).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    arrays.prepare(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.drop_contaminated(docs, items).select(*COLUMNS)


def personal_data_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; ``n_chars`` follows the text."""
    arrays.prepare(spark)
    masked = private.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 1,024 tokens."""
    arrays.prepare(spark)
    return packing.pack(docs, queries.vocabulary())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicate_removal", near_duplicate_removal),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data_masking", personal_data_masking),
    ("sequence_packing", sequence_packing),
]

# Kernels, tokens and bootstrapped contexts are beyond SQL; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written once."""
    arrays.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
