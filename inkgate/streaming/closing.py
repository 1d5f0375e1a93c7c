"""What a stream of events remembers of jobs that have ended: keyed state with a time to live.

State holds one row per ended job, for ``keep_closed``; it never grows with the events. A job's
events pass its task as they come, nothing of a batch is gathered.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KEEP_CLOSED = dt.timedelta(days=7)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class UntilClosed(StatefulProcessor):
    """Passes the events of a job until one of an earlier batch closed it.

    The batch in which a job ends passes whole; what lies behind its end there is for
    ``until_done`` to leave out, which needs no order of arrival.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.closed = handle.getValueState("closed", "done_seq string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        shut, done = self.closed.exists(), []
        for frame in rows:
            if not shut:
                done.extend(frame.loc[frame["status"] == "done", "seq"].dropna())
                done = [min(done, key=int)] if done else []
                yield frame
        if done:
            self.closed.update((done[0],))

    def close(self) -> None:
        pass


@contextmanager
def stateful_settings(spark: SparkSession) -> Iterator[None]:
    """Settings a stream with keyed state starts with; the session's own come back behind it.

    Batches without data are off: with state on processing time they would follow each other
    for ever, and a run that drains its source would not end.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def while_open(events: DataFrame, keep_closed: dt.timedelta = KEEP_CLOSED) -> DataFrame:
    """The stream of events(job_id, seq, status, ...) without those of jobs that earlier batches
    closed at a ``done``, for ``keep_closed`` after it. Start it within ``stateful_settings``.

    Whole numbers travel as text, so that large ones stay exact next to nulls. A ``done`` without a
    ``seq`` closes nothing; events without a job are one job of their own.
    """
    whole = {f.name: f.dataType for f in events.schema.fields if isinstance(f.dataType, _WHOLE)}
    lean = events.select(*(F.col(c).cast("string").alias(c) if c in whole else F.col(c) for c in events.columns))
    processor = UntilClosed(int(keep_closed.total_seconds() * 1000))
    passed = lean.groupBy("job_id").transformWithStateInPandas(processor, lean.schema, "append", "ProcessingTime")
    return passed.select(*(F.col(c).cast(whole[c]).alias(c) if c in whole else F.col(c) for c in events.columns))
