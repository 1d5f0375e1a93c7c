"""Exact duplicates of a stream within a window of time."""

from __future__ import annotations

from pyspark.sql import DataFrame


def first_in_window(docs: DataFrame, days: float, *, time: str = "ingested_at") -> DataFrame:
    """The first of equal hashes in docs(sha256, time, ...) as they arrive.

    A hash is remembered for ``days`` of event time behind its first arrival; state older than the
    watermark goes, rows later than it are dropped. 0 remembers every hash for ever: state then
    grows with the number of hashes.
    """
    if not days:
        return docs.dropDuplicates(["sha256"])
    return docs.withWatermark(time, f"{int(days * 86_400)} seconds").dropDuplicatesWithinWatermark(["sha256"])
