"""Durations of steps as sketches that add up: a table of logarithmic buckets with counts.

Bucket b holds durations in (growth^(b-1), growth^b] ms, -1 those up to 0. A quantile read from
the counts is off by no more than the growth of a bucket, whatever was added to the sketch, and
however many runs. A sketch has some thousand rows a step at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROWTH = 1.02


def duration_sketch(audit: DataFrame) -> DataFrame:
    """audit(node, event, duration_ms) -> (node, event, bucket, n, total_ms); rows without a
    duration are left out."""
    ms = F.col("duration_ms").cast("double")
    bucket = F.when(ms <= 0, -1).otherwise(F.ceil(F.ln(ms) / F.ln(F.lit(GROWTH))).cast("int"))
    timed = audit.where(F.col("duration_ms").isNotNull())
    return timed.groupBy("node", "event", bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("duration_ms").cast("bigint")).alias("total_ms")
    )


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    """The sketch of all that the given ones were made of."""
    together = reduce(DataFrame.unionByName, sketches)
    return together.groupBy("node", "event", "bucket").agg(F.sum("n").alias("n"), F.sum("total_ms").alias("total_ms"))


def duration_summary(sketch: DataFrame, *percents: int) -> DataFrame:
    """(node, event, n, avg_ms, p50_ms, ...): whole milliseconds, at most a bucket too high.

    Windows run over the buckets of a step, not over what was measured.
    """
    step = Window.partitionBy("node", "event")
    counted = sketch.select(
        "*",
        F.sum("n").over(step.orderBy("bucket")).alias("_upto"),
        F.sum("n").over(step).alias("_all"),
    )
    top = F.when(F.col("bucket") < 0, 0.0).otherwise(F.pow(F.lit(GROWTH), F.col("bucket")))
    reached = [
        F.min(F.when(F.col("_upto") * 100 >= F.col("_all") * p, F.round(top).cast("bigint"))).alias(f"p{p}_ms") for p in percents
    ]
    return counted.groupBy("node", "event").agg(
        F.sum("n").alias("n"), (F.sum("total_ms") / F.sum("n")).alias("avg_ms"), *reached
    )
