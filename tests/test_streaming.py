from __future__ import annotations

import datetime as dt
import random
import shutil
import time
from pathlib import Path

import pytest

from inkgate.catalog import event_queries, run_queries
from inkgate.sources import files as file_source
from inkgate.streaming import arrivals
from inkgate.streaming import events as ev
from test_duplicates import corpus, one_by_one

EVENTS = "job_id string, seq long, node string, status string, timestamp timestamp"
T0 = dt.datetime(2024, 1, 1, 12)
TABLES = "/root/testdata/sf0.001"


def make_events(n):
    rng = random.Random(4)
    states = ["started", "passed", "failed", "done"]
    return [
        (f"j{rng.randrange(6)}", i, f"n{rng.randrange(3)}", rng.choices(states, [5, 5, 3, 1])[0], T0 + dt.timedelta(milliseconds=137 * i))
        for i in range(n)
    ]


def until_done(events):
    closed, out = set(), []
    for event in events:
        if event[0] not in closed:
            out.append(event[:2])
            if event[3] == "done":
                closed.add(event[0])
    return sorted(out)


def write_batches(spark, rows, schema, folder, size):
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(folder)


def test_stream_of_events_equals_batch(spark, tmp_path):
    rows = make_events(120)
    df = spark.createDataFrame(rows, EVENTS)
    want = until_done(rows)
    assert sorted((r.job_id, r.seq) for r in ev.until_done(df).collect()) == want

    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for size in range(0, 120, 30):
        write_batches(spark, rows[size : size + 30], EVENTS, source, 30)
        stream = spark.readStream.schema(df.schema).parquet(source)
        ev.deliver_until_done(stream, root, root + "/checkpoint").awaitTermination()
    got = spark.read.parquet(root + "/delivered").select("job_id", "seq").collect()
    assert sorted(map(tuple, got)) == want


def deliver(spark, root, rows, **options):
    """One more part of the events arrives and is delivered; progress of its batches."""
    write_batches(spark, rows, EVENTS, root + "/in", len(rows))
    stream = spark.readStream.schema(spark.createDataFrame([], EVENTS).schema).parquet(root + "/in")
    query = ev.deliver_until_done(stream, root, root + "/checkpoint", **options)
    query.awaitTermination()
    return query.recentProgress


def test_state_keeps_closed_jobs_and_forgets_them(spark, tmp_path):
    root = str(tmp_path)
    big = 2**60
    first = [("a", big + 1, "n", "started", T0), ("a", big + 3, "n", "done", T0), ("a", big + 4, "n", "passed", T0), ("b", 1, "n", "started", None)]
    second = [("a", big + 5, "n", "passed", T0), ("b", None, "n", "done", T0), ("c", 7, "n", "done", T0), (None, 8, None, "done", T0)]
    third = [("a", 1, "n", "started", T0), ("b", 2**53 + 1, "n", "passed", T0), ("c", 8, "n", "done", T0), (None, 9, "n", "passed", T0)]
    rows = []
    for part, closed in ((first, 1), (second, 3), (third, 3)):
        rows.append(deliver(spark, root, part)[-1]["stateOperators"][0]["numRowsTotal"])
        assert rows[-1] == closed
    got = sorted(((r.job_id or "", r.seq or 0) for r in spark.read.parquet(root + "/delivered").collect()))
    assert got == sorted([("a", big + 1), ("a", big + 3), ("b", 1), ("b", 0), ("c", 7), ("", 8), ("b", 2**53 + 1)])
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_state_shrinks_after_its_time(spark, tmp_path):
    root, keep = str(tmp_path), dt.timedelta(seconds=1)
    jobs = [(f"j{i}", i, "n", "done", T0) for i in range(20)]
    assert deliver(spark, root, jobs, keep_closed=keep)[-1]["stateOperators"][0]["numRowsTotal"] == 20
    time.sleep(1.5)
    last = deliver(spark, root, [("k", 50, "n", "done", T0), ("j1", 51, "n", "started", T0)], keep_closed=keep)[-1]
    # the old jobs are gone, and j1 is open again
    assert last["stateOperators"][0]["numRowsTotal"] == 1
    assert spark.read.parquet(root + "/delivered").where("job_id = 'j1'").count() == 2


def test_closed_jobs_deliver_nothing(spark):
    df = spark.createDataFrame(make_events(40), EVENTS)
    closed = spark.createDataFrame([("j1", 3), ("j2", 5)], ev.CLOSED_SCHEMA)
    got = {r.job_id for r in ev.until_done(df, closed).collect()}
    assert not got & {"j1", "j2"} and got


def test_durations_in_batch_and_stream(spark, tmp_path):
    rows = [
        ("a", 1, "n1", "started", T0),
        ("a", 2, "n1", "passed", T0 + dt.timedelta(microseconds=1_500_900)),
        ("a", 3, "n2", "started", T0),
        ("b", 4, "n1", "failed", T0),
    ]
    df = spark.createDataFrame(rows, EVENTS)
    want = [("a", "n1", 1500)]
    assert [(r.job_id, r.node, r.duration_ms) for r in ev.step_durations(df).collect()] == want
    source = str(tmp_path / "in")
    write_batches(spark, rows, EVENTS, source, 1)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        ev.step_durations(stream)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("durations")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = spark.table("durations").collect()
    assert [(r.job_id, r.node, r.duration_ms) for r in got] == want


def test_frames(spark):
    df = spark.createDataFrame(
        [("j", 1, "n", "done", T0), ("j", 2, "n", "done", T0 + dt.timedelta(microseconds=50))], EVENTS
    )
    got = [r.frame for r in ev.event_frames(df).orderBy("seq").collect()]
    assert got[0] == (
        'event: node_update\ndata: {"job_id":"j","node":"n","status":"done",'
        '"timestamp":"2024-01-01T12:00:00Z"}\n\n'
    )
    assert '"2024-01-01T12:00:00.000050Z"' in got[1]


DOCS = "id string, arrival long, sha256 string, text string"


def test_duplicate_stream_equals_one_by_one(spark, tmp_path):
    docs = corpus(random.Random(21), 60, hot=0.3)
    want = {str(k): v[0] for k, v in one_by_one(docs, 0.85).items()}
    rows = [(str(i), i, s, t) for i, s, t in docs]
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame(rows, DOCS).schema
    for start in (0, 20, 40):
        write_batches(spark, rows[start : start + 20], DOCS, source, 20)
        stream = spark.readStream.schema(schema).parquet(source)
        arrivals.control_stream(stream, root, root + "/checkpoint").awaitTermination()
    verdicts = spark.read.parquet(root + "/verdicts")
    assert {r.id: r.duplicate_type for r in verdicts.collect()} == want
    # a replay of the last batch changes nothing
    last = spark.createDataFrame(rows[40:], DOCS)
    from inkgate.config import GateRules

    arrivals.control_batch(last, 2, root, GateRules())
    again = spark.read.parquet(root + "/verdicts")
    assert {r.id: r.duplicate_type for r in again.collect()} == want and again.count() == 60


def test_store_of_an_earlier_version_is_met(spark, tmp_path):
    """It holds a row for each prefix word instead of a sketch."""
    from inkgate.config import GateRules
    from inkgate.operators import token_similarity as ts
    from inkgate.sources import tables

    docs = corpus(random.Random(22), 60, hot=0.3)
    want = {str(k): v[0] for k, v in one_by_one(docs, 0.85).items()}
    rows = [spark.createDataFrame([(str(i), i, s, t) for i, s, t in docs[at : at + 20]], DOCS) for at in (0, 20, 40)]
    root = str(tmp_path / "out")
    arrivals.control_batch(rows[0], 0, root, GateRules())
    order = ts.slot_frequencies(tables.read_table(spark, root, "word_order", arrivals.SLOT_SCHEMA))
    accepted = spark.read.parquet(root + "/accepted").where("batch_id = 0")
    tables.append_batch(ts.word_members(accepted, 0.85, order), root, "accepted_members", 0)
    shutil.rmtree(root + "/accepted_sketches")
    arrivals.control_batch(rows[1], 1, root, GateRules())
    arrivals.control_batch(rows[2], 2, root, GateRules())
    verdicts = spark.read.parquet(root + "/verdicts")
    assert {r.id: r.duplicate_type for r in verdicts.collect()} == want


def test_files_arrive(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.txt").write_bytes(b"one")
    (inbox / "b.txt").write_bytes(b"two")
    seen = []

    def judge(batch, batch_id):
        seen.extend(r.filename for r in batch.select("filename").collect())

    uploads = file_source.stream_files(spark, str(inbox))
    arrivals.watch(uploads, judge, str(tmp_path / "checkpoint")).awaitTermination()
    (inbox / "c.txt").write_bytes(b"three")
    uploads = file_source.stream_files(spark, str(inbox))
    arrivals.watch(uploads, judge, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(seen) == ["a.txt", "b.txt", "c.txt"]


@pytest.mark.skipif(not Path(TABLES).exists(), reason="no test tables here")
def test_stream_queries_read_folders_of_part_files(spark, tmp_path):
    folder = tmp_path / "in"
    for name in ("documents", "pages", "labels", "events"):
        table = spark.read.parquet(f"{TABLES}/{name}.parquet").limit(60)
        table.repartition(3).write.parquet(f"{folder}/{name}.parquet")
        assert len(list(folder.glob(f"{name}.parquet/part-*.parquet"))) == 3
    where = str(folder)
    events = event_queries.stream_until_done(spark, where).select("job_id", "seq").collect()
    want = event_queries.event_stream_until_done(spark, where).select("job_id", "seq").collect()
    assert want and sorted(map(tuple, events)) == sorted(map(tuple, want))
    jobs = run_queries.stream_ingest(spark, where).select("job_id", "status").collect()
    want = run_queries.ingest_cascade(spark, where).select("job_id", "status").collect()
    assert len(want) > 100 and sorted(map(tuple, jobs)) == sorted(map(tuple, want))
