"""Progress events, as a batch and as a stream over the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgate import fixed_values as fv
from inkgate.catalog import bindings as b
from inkgate.session import new_path
from inkgate.sources import tables
from inkgate.streaming import events as ev


def event_frames(spark: SparkSession, folder: str) -> DataFrame:
    return ev.event_frames(b.node_events(spark, folder)).select("job_id", "seq", "frame")


EVENT_FRAMES = f"""
WITH {b.NODE_EVENTS_SQL}
SELECT job_id, seq, 'event: {fv.EVENT_NAME}' || chr(10) || 'data: ' || '{{"job_id":"' || job_id
  || '","node":"' || node || '","status":"' || status || '","timestamp":"'
  || CASE WHEN epoch_us("timestamp") % 1000000 = 0
          THEN strftime("timestamp", '%Y-%m-%dT%H:%M:%SZ')
          ELSE strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ') END
  || '"}}' || chr(10) || chr(10) AS frame
FROM node_events
"""


def event_stream_until_done(spark: SparkSession, folder: str) -> DataFrame:
    return ev.until_done(b.node_events(spark, folder)).select("job_id", "seq", "node", "status")


EVENT_STREAM_UNTIL_DONE = f"""
WITH {b.NODE_EVENTS_SQL},
ends AS (SELECT job_id, min(seq) AS done FROM node_events WHERE status = 'done' GROUP BY 1)
SELECT n.job_id, seq, node, status FROM node_events n LEFT JOIN ends e ON e.job_id = n.job_id
WHERE done IS NULL OR seq <= done
"""


def step_durations(spark: SparkSession, folder: str) -> DataFrame:
    return ev.step_durations(b.node_events(spark, folder)).select(
        "job_id", "node", F.col("duration_ms").alias("duration_ms")
    )


STEP_DURATIONS = f"""
WITH {b.NODE_EVENTS_SQL},
pairs AS (
  SELECT job_id, node, min("timestamp") FILTER (WHERE status = 'started') AS s,
         max("timestamp") FILTER (WHERE status IN ('passed', 'failed')) AS f
  FROM node_events GROUP BY 1, 2)
SELECT job_id, node, CAST(trunc((epoch_us(f) - epoch_us(s)) / 1000.0) AS BIGINT) AS duration_ms FROM pairs
WHERE s IS NOT NULL AND f IS NOT NULL
"""


def stream_until_done(spark: SparkSession, folder: str) -> DataFrame:
    """The delivery stream over four parts of the table that arrive one after the other, each a run
    of its own from the checkpoint of the last; then read back. Jobs close in one part and go on
    having events in later ones."""
    root = new_path(spark, "delivery")
    named = b.node_events(spark, folder).select("job_id", "seq", "node", "status", "timestamp")

    def run(stream: DataFrame) -> None:
        ev.deliver_until_done(stream, root, f"{root}/checkpoint").awaitTermination()

    b.in_turns(named, "seq", f"{root}/inbox", 4, run)
    schema = T.StructType(
        [
            T.StructField("job_id", T.StringType()),
            T.StructField("seq", T.LongType()),
            T.StructField("node", T.StringType()),
            T.StructField("status", T.StringType()),
        ]
    )
    return tables.read_table(spark, root, "delivered", schema).select(*schema.names)


QUERIES = {
    "event_frames": event_frames,
    "event_stream_until_done": event_stream_until_done,
    "step_durations": step_durations,
    "stream_until_done": stream_until_done,
}
ORACLES = {
    "event_frames": EVENT_FRAMES,
    "event_stream_until_done": EVENT_STREAM_UNTIL_DONE,
    "step_durations": STEP_DURATIONS,
    "stream_until_done": EVENT_STREAM_UNTIL_DONE,
}
