"""The training-data pipeline over ``documents``: each stage works on all that the last one kept.

Quality classifier, exact dedup, n-gram Jaccard join, benchmark decontamination, packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkgate.llm import stages
from inkgate.session import cut

STAGES = [
    ("quality", stages.keep_quality),
    ("exact_dedup", stages.keep_first_copies),
    ("jaccard_join", stages.keep_one_of_each_group),
    ("decontamination", stages.keep_clean_of_benchmark),
    ("packing", stages.pack),
]

# Trained scores, token ids and packing cannot be said in SQL; tests hold the stages against
# brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's rows are written and read again as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
