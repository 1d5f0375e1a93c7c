"""Checked lookups, sketches of durations, chunks and windows of duplicate control."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import numpy as np
import pytest

from inkgate.operators.chunks import overlapping_chunks, retrieve
from inkgate.operators.durations import GROWTH, duration_sketch, duration_summary, merge_sketches
from inkgate.operators.lookups import at_most_one, look_up
from inkgate.streaming.windows import first_in_window

RECORDS = "job_id string, n long, note string"


def test_lookup_gives_one_row_or_nulls(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), (None, 3, "n"), (None, 4, "n"), ("d", 5, "1"), ("d", 6, "2")], RECORDS)
    asked = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 5)], "job_id string, asked int")
    got = {r.asked: (r.job_id, r.n, r.note) for r in look_up(asked, table, "job_id").collect()}
    assert got == {1: ("a", 1, "x"), 2: ("a", 1, "x"), 3: ("b", 2, None), 4: ("c", None, None), 5: (None, None, None)}
    assert look_up(asked.limit(0), table, "job_id").count() == 0
    assert look_up(asked, table.limit(0), "job_id").count() == 5


def test_two_rows_for_a_key_fail(spark):
    table = spark.createDataFrame([("d", 5, "1"), ("d", 6, "2"), ("e", 1, "")], RECORDS)
    asked = spark.createDataFrame([("d",)], "job_id string")
    with pytest.raises(Exception, match="more than one row for job_id = d"):
        look_up(asked, table, "job_id").collect()
    with pytest.raises(Exception, match="more than one row for job_id, note = d, 1"):
        at_most_one(table.unionByName(table.where("n = 5")), "job_id", "note").collect()
    assert at_most_one(table, "job_id", "note").count() == 3
    assert look_up(asked.selectExpr("'e' AS job_id"), table, "job_id").first().n == 1


def test_sketches_add_up_and_bound_the_error(spark):
    draw = np.random.default_rng(1)
    held = {("n1", "passed"): draw.integers(1, 100_000, 500), ("n2", "failed"): np.array([0, 0, 7]), ("n1", "failed"): np.array([1])}
    rows = [(n, e, int(x)) for (n, e), xs in held.items() for x in xs] + [("n3", "passed", None)]
    random.Random(1).shuffle(rows)
    frames = [spark.createDataFrame(rows[i::3], "node string, event string, duration_ms int") for i in range(3)]
    merged = merge_sketches(*map(duration_sketch, frames))
    whole = duration_sketch(spark.createDataFrame(rows, "node string, event string, duration_ms int"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
    got = {(r.node, r.event): r for r in duration_summary(merged, 1, 50, 95, 100).collect()}
    assert set(got) == set(held)
    for key, xs in held.items():
        r = got[key]
        assert r.n == len(xs) and r.avg_ms == pytest.approx(xs.mean())
        for p in (1, 50, 95, 100):
            exact = np.sort(xs)[-(-len(xs) * p // 100) - 1]
            assert exact - 0.5 <= r[f"p{p}_ms"] <= exact * GROWTH + 0.5
    assert duration_summary(whole.limit(0), 50).count() == 0


@pytest.mark.parametrize(("size", "overlap"), [(10, 3), (10, 0), (7, 3), (1, 0), (10, 5)])
def test_chunks_rebuild_the_text(spark, size, overlap):
    draw = random.Random(size)
    texts = ["".join(draw.choice("ab\n 😀é") for _ in range(n)) for n in range(45)] + [None, "long " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "job_id int, text string")
    parts = {}
    for r in overlapping_chunks(df, size=size, overlap=overlap).orderBy("job_id", "chunk").collect():
        held = parts.setdefault(r.job_id, [])
        assert r.chunk == len(held) and r.start == r.chunk * (size - overlap)
        held.append(r.text)
    for i, text in enumerate(texts):
        held = parts.get(i, [])
        assert "".join(c if k == 0 else c[overlap:] for k, c in enumerate(held)) == (text or "")
        assert all(len(c) == size for c in held[:-1]) and all(0 < len(c) <= size for c in held)
        n = len(text or "")
        assert len(held) == (0 if n == 0 else 1 if n <= size else -(-(n - size) // (size - overlap)) + 1)
    with pytest.raises(ValueError):
        overlapping_chunks(df, size=10, overlap=6)


def test_retrieval_names_its_sources(spark):
    rows = [(i, [1.0, 0.0], f"file{i}") for i in (3, 5, 4)] + [(9, [0.0, 1.0], "other"), (10, None, "none"), (11, [0.0, 0.0], "zero")]
    chunks = spark.createDataFrame(rows, "id long, vec array<float>, source string")
    asked = spark.createDataFrame([(100, [2.0, 0.1]), (9, [0.0, 1.0]), (101, None)], "id long, vec array<float>")
    got = {}
    for r in retrieve(asked, chunks, k=3).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r["rank"], r.chunk_id, r.source))
    # equal cosines by the lower id; a question never finds its own row
    assert got == {
        100: [(1, 3, "file3"), (2, 4, "file4"), (3, 5, "file5")],
        9: [(1, 3, "file3"), (2, 4, "file4"), (3, 5, "file5")],
    }


DOCS = "job_id string, sha256 string, ingested_at timestamp"
T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("days", [2, 0])
def test_duplicates_within_a_window(spark, tmp_path, days):
    """A hash is known for two days of event time; rows behind the watermark are dropped."""
    at = lambda d: T0 + dt.timedelta(days=d)
    batches = [
        [("a", "h1", at(0)), ("b", "h2", at(0.5))],
        [("c", "h1", at(1)), ("d", "h3", at(1))],
        [("e", "h4", at(6))],
        [("f", "h1", at(7)), ("g", "h5", at(1)), ("h", "h4", at(6.5))],
    ]
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.createDataFrame([], DOCS).schema).parquet(source)
        query = first_in_window(stream, days).writeStream.format("parquet").option("path", root)
        query.option("checkpointLocation", root + "-cp").trigger(availableNow=True).start().awaitTermination()
    got = {r.job_id for r in spark.read.parquet(root).collect()}
    # within two days c is a copy of a; a week later f is not; g comes too late to be judged
    assert got == ({"a", "b", "d", "e", "f"} if days else {"a", "b", "d", "e", "g"})


def test_every_document_is_a_file_in_one_folder(spark, tmp_path, monkeypatch):
    """A folder for each of them has to be made, moved by the driver, and listed again."""
    from inkgate.catalog import lookup_queries as lq

    texts = [(i, f"text {i}" * (1 + 300 * (i % 2))) for i in range(40)] + [(40, None), (41, ""), (42, "a\nb"), (0, "text 0")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    inbox = tmp_path / "inbox"
    monkeypatch.setattr(lq, "new_path", lambda *_: str(inbox))
    got = lq.files_gate(spark, str(tmp_path)).collect()
    written = [p for p in inbox.rglob("*") if p.is_file() and p.suffix == ".txt"]
    assert len(written) == len(got) == 43 and all(p.parent == inbox for p in written)
    bodies = {i: f"{t or ''}\n" for i, t in texts} | {0: "text 0\ntext 0\n"}
    limit = int(lq.FILE_LIMIT_MB * 1024 * 1024)
    want = sorted((len(x) <= limit, hashlib.sha256(x.encode()).hexdigest() if len(x) <= limit else "", len(x), len(x) > limit) for x in bodies.values())
    assert sorted(tuple(r) for r in got) == want


def test_no_program_is_started_for_a_file(spark, tmp_path):
    """Hadoop starts a chmod for each file that it makes on a mounted folder, and one for its checksums."""
    from inkgate.sources.files import write_apart

    lines = [(i, f"line {i}") for i in range(30)] + [(None, "no key"), (3, "a\nb"), (4, "ä")]
    folder = tmp_path / "inbox"
    write_apart(spark.createDataFrame(lines, "key long, value string"), "key", f"file://{folder}")
    bodies = {i: f"line {i}\n" for i in range(30)} | {None: "no key\n", 3: "a\nb\nline 3\n", 4: "line 4\nä\n"}
    names = sorted(p.name for p in folder.iterdir())
    assert len(names) == len(bodies) and all(n.endswith(".txt") for n in names)
    assert sorted(p.read_text() for p in folder.iterdir()) == sorted(bodies.values())


def test_small_files_share_tasks(spark, tmp_path, monkeypatch):
    from inkgate.sources import files

    tasks = []
    for i in range(300):
        (tmp_path / f"{i}.txt").write_text("x" * (i % 50))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        for size in (2**20, 100):
            monkeypatch.setattr(files, "TASK_BYTES", size)
            found = files.read_files(spark, str(tmp_path), limit=30)
            tasks.append(found.rdd.getNumPartitions())
            assert found.where("content IS NULL").count() == 19 * 6 and found.count() == 294
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tasks[0] <= 2 * 8 * 8 and tasks[1] > tasks[0]
