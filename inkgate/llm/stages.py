"""The stages of the pipeline: (spark, docs, folder) -> the rows of docs that stay.

``docs`` has the columns of ``documents``; all but the last stage return just these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgate.llm import exact_copies, packing, phrase_index, quality, queries, shingle_join


def _as_records(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("job_id"), F.col("text").alias("cleaned_text"))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the ids of ``dropped``; rows without an id stay."""
    ids = dropped.select(F.col("job_id").alias("doc_id")).distinct()
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier accepts: a score of at least 0.3."""
    model = queries.quality_model(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return docs.where(quality.score(model, F.col("text")) >= queries.ACCEPTED_FROM)


def keep_first_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return exact_copies.without_copies(docs, job_id="doc_id", cleaned_text="text").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest id of each component of near copies.

    Near copies share at least 0.8 of their five-word shingles; ``op6_jaccard_join`` has a rule
    of its own.
    """
    found = shingle_join.jaccard_components(_as_records(docs), shingle_words=5, percent=80)
    return _without(docs, found.where("job_id <> component_id"))


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = phrase_index.contamination(_as_records(docs), items)
    return _without(docs, found.where("n_hit > 0"))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return queries.packed(_as_records(docs))
