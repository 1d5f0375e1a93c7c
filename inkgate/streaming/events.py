"""Progress events of jobs: framing, the end of a job's stream, and step durations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from inkgate import fixed_values as fv
from inkgate.operators.tracking import STEPS, outcome
from inkgate.sources import tables
from inkgate.streaming.closing import KEEP_CLOSED, stateful_settings, while_open

FINISHED = ("passed", "failed")
CLOSED_SCHEMA = T.StructType(
    [T.StructField("job_id", T.StringType()), T.StructField("done_seq", T.LongType())]
)


def iso_utc(timestamp: Column) -> Column:
    """ISO-8601 in UTC; whole seconds carry no fraction. The session zone must be UTC."""
    whole = F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    exact = F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.when(F.unix_micros(timestamp) % 1_000_000 == 0, whole).otherwise(exact)


def run_events(results: DataFrame, *, timestamp: Column | None = None) -> DataFrame:
    """(job_id, seq, node, status, timestamp): what each gate of a run announced, then done."""
    announced = []
    for order, (step, node) in enumerate(STEPS, start=1):
        reached = F.col(step).isNotNull()
        for seq, status in (
            (2 * order - 1, F.lit("started")),
            (2 * order, outcome(F.col(f"{step}.passed"))),
        ):
            event = F.struct(
                F.lit(seq).cast("bigint").alias("seq"),
                F.lit(node).alias("node"),
                status.alias("status"),
            )
            announced.append(F.when(reached, event))
    announced.append(
        F.struct(
            F.lit(2 * len(STEPS) + 1).cast("bigint").alias("seq"),
            F.lit(fv.NODE_WHOLE_RUN).alias("node"),
            F.lit("done").alias("status"),
        )
    )
    stamp = F.current_timestamp() if timestamp is None else timestamp
    return results.select(
        "job_id",
        F.explode(F.array_compact(F.array(*announced))).alias("e"),
        stamp.alias("timestamp"),
    ).select("job_id", "e.seq", "e.node", "e.status", "timestamp")


def event_frames(events: DataFrame) -> DataFrame:
    """Events as server-sent-event text frames, batch or stream."""
    payload = F.to_json(
        F.struct("job_id", "node", "status", iso_utc(F.col("timestamp")).alias("timestamp"))
    )
    frame = F.concat(F.lit(f"event: {fv.EVENT_NAME}\ndata: "), payload, F.lit("\n\n"))
    return events.withColumn("frame", frame)


def until_done(events: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """Events of each job up to and with its first ``done``; nothing of jobs in ``closed``.

    The end of a job is an aggregate combined before the shuffle and joined back, so a job
    with very many events is never gathered in one group.
    """
    ends = (
        events.where(F.col("status") == "done")
        .groupBy("job_id")
        .agg(F.min("seq").alias("_end"))
    )
    if closed is not None:
        events = events.join(closed.select("job_id"), "job_id", "left_anti")
    return (
        events.join(ends, "job_id", "left")
        .where(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
        .drop("_end")
    )


def step_durations(events: DataFrame) -> DataFrame:
    """(job_id, node, started_at, finished_at, duration_ms), batch or stream.

    A built-in aggregate: on a stream its state holds two timestamps per step.
    """
    started = F.min(F.when(F.col("status") == "started", F.col("timestamp")))
    finished = F.max(F.when(F.col("status").isin(*FINISHED), F.col("timestamp")))
    return (
        events.groupBy("job_id", "node")
        .agg(started.alias("started_at"), finished.alias("finished_at"))
        .where(F.col("started_at").isNotNull() & F.col("finished_at").isNotNull())
        .withColumn(
            "duration_ms",
            F.expr("(unix_micros(finished_at) - unix_micros(started_at)) div 1000"),
        )
    )


def deliver_until_done(
    events: DataFrame, root: str, checkpoint: str, *, keep_closed: dt.timedelta = KEEP_CLOSED
) -> StreamingQuery:
    """Stream events into ``root/delivered``, closing each job at its ``done``.

    Events of a job that an earlier batch closed are dropped by keyed state, which forgets the
    job ``keep_closed`` later; so long events may come late. Inside the batch of the ``done`` the
    order of ``seq`` decides. A replayed batch finds the state of its first run and replaces its
    own partition.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            tables.append_batch(until_done(batch), root, "delivered", batch_id)
        finally:
            batch.unpersist()

    with stateful_settings(events.sparkSession):
        return (
            while_open(events, keep_closed)
            .writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
