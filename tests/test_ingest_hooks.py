"""What plugs into the gate, and what it must not read."""

from __future__ import annotations

import os
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgate.catalog import run_queries
from inkgate.config import DuplicateRules, ExtractionRules, FormatRules, GateRules
from inkgate.operators import gates, hooks, language
from inkgate.operators.extraction import extract_in_passes
from inkgate.operators.vector_similarity import Cells
from inkgate.plans.ingest import ingest
from inkgate.sources import files as file_source
from inkgate.streaming import arrivals

TABLES = "/root/testdata/sf0.001"
FILES = "job_id string, arrival long, filename string, content binary, language string"
LEGIT = '{"is_legitimate": true, "confidence": 0.9, "reasoning": "act"}'


def uploads(spark, bodies, names=None):
    rows = [(f"j{i}", i, (names or {}).get(i, f"f{i}.txt"), b, "es") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, FILES)


def answers(spark, n):
    return spark.createDataFrame([(f"j{i}", "content", LEGIT) for i in range(n)], "job_id string, task string, response string")


def counting(folder, name, read):
    """A loader of an extractor that leaves a file for every call."""

    def load():
        def extract(content, filename):
            with open(f"{folder}/{name}-{filename}-{os.urandom(4).hex()}", "w"):
                pass
            return read(content)

        return extract

    return load


def calls(folder, name):
    return sorted(p.name.split("-")[1] for p in Path(folder).glob(f"{name}-*"))


def long_text(i):
    return " ".join(f"word{i}x{k}" for k in range(12))


def test_a_costly_extractor_sees_only_thin_files(spark, tmp_path):
    bodies = [long_text(0).encode(), b"thin", b"", None, long_text(4).encode(), b"fails"]
    files = uploads(spark, bodies, {4: "page.html"})

    def cheap(content):
        if content == b"fails":
            raise ValueError("broken")
        return content.decode()

    more = long_text(7)
    chain = [
        ("cheap", counting(tmp_path, "cheap", cheap)),
        ("costly", counting(tmp_path, "costly", lambda content: more + content.decode())),
        ("last", counting(tmp_path, "last", lambda content: "never")),
    ]
    run = ingest(files, chain, answers(spark, 6))
    got = {r.job_id: r.extraction for r in run.with_texts().collect()}
    # the empty file, the missing one and the page never reach extraction
    assert calls(tmp_path, "cheap") == ["f0.txt", "f1.txt", "f5.txt"]
    assert calls(tmp_path, "costly") == ["f1.txt", "f5.txt"] and calls(tmp_path, "last") == []
    assert got["j0"].extractor_used == "cheap" and got["j1"].extractor_used == got["j5"].extractor_used == "costly"
    assert got["j1"].text == long_text(7) + "thin" and got["j2"] is got["j3"] is got["j4"] is None


def test_passes_give_what_the_attempts_say(spark, tmp_path):
    """Columns and loaders mixed: the last success stands unless an earlier one was long enough."""
    files = uploads(spark, [b"x" * 60, b"short", b"ab", b"y" * 55])
    chain = [
        ("one", F.when(F.col("job_id") != "j3", F.decode("content", "UTF-8"))),
        ("two", F.when(F.col("job_id") == "j2", F.lit("z" * 70))),
        ("three", counting(tmp_path, "three", lambda content: "t" * (25 if content == b"short" else 51))),
        ("four", F.concat(F.lit("four"), F.decode("content", "UTF-8"))),
    ]
    got = {r.job_id: r.extraction for r in extract_in_passes(files, chain, ExtractionRules()).collect()}
    assert [(got[j].extractor_used, got[j].char_count) for j in ("j0", "j1", "j2", "j3")] == [
        ("one", 60), ("four", 9), ("two", 70), ("three", 51),
    ]
    assert got["j1"].text == "" and calls(tmp_path, "three") == ["f1.txt", "f3.txt"]


def test_language_of_the_extracted_text_and_own_mime(spark):
    """The language hook reads what extraction chose; the type hook decides the format gate."""
    spanish, english = "la ordenanza de la ciudad se publica en el boletin oficial " * 2, "the council of the city has passed this act of law " * 2
    labelled = spark.createDataFrame([(spanish, "es"), (english, "xx")], "text string, lang string")
    profiles = language.learn_profiles(labelled)

    def tell(texts):
        return language.detect_language(texts, profiles, key="id", text="text")

    bodies = [b"not the text at all", b"not the text either", b"TYPE:odd " + spanish.encode()]
    files = uploads(spark, bodies).drop("language")
    chosen = F.when(F.col("job_id") == "j0", spanish).when(F.col("job_id") == "j1", english).otherwise(spanish + "otra")
    mime = lambda body: F.when(F.startswith(body, F.lit(b"TYPE:odd")), "application/odd").otherwise("application/octet-stream")
    run = ingest(files, [("reader", chosen)], answers(spark, 3), mime=mime, language=tell)
    got = {r.job_id: r for r in run.results.collect()}
    assert got["j0"].status == "accepted" and got["j0"].content_validation.detected_language == "es"
    assert got["j1"].status == "review" and got["j1"].content_validation.detected_language == "xx"
    assert got["j2"].reception.detected_mime == "application/odd" and got["j2"].format_validation.decision == "manual_review"


def test_large_files_are_listed_and_not_read(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "b.txt").write_bytes(b"small")
    (inbox / "a.txt").write_bytes(b"x" * 5000)
    (inbox / "c.txt").write_bytes(b"other")
    rules = FormatRules(max_file_size_mb=0.001)
    limit = int(rules.max_file_size_bytes)
    found = file_source.read_files(spark, str(inbox), limit=limit, by_path=True)
    # the source itself fails on a body above this size: it is never asked for one
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "4000")
    try:
        rows = {r.filename: r for r in gates.receive(found, rules).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert rows["a.txt"].content is None and rows["a.txt"].reception.file_size_bytes == 5000
    assert "exceed" in rows["a.txt"].reception.rejection_reason.lower() or "large" in rows["a.txt"].reception.rejection_reason.lower()
    assert rows["b.txt"].reception.passed and rows["c.txt"].reception.passed
    order = sorted(rows.values(), key=lambda r: r.arrival)
    assert [r.filename for r in order] == ["a.txt", "b.txt", "c.txt"]
    missing = spark.createDataFrame([("j", None, None)], "job_id string, content binary, length long")
    assert gates.receive(missing, rules).first().reception.rejection_reason == gates.fv.MSG_NO_FILE


def test_models_are_asked_again_row_by_row(spark):
    requests = spark.createDataFrame([(f"j{i}", "content", f"p{i}") for i in range(5)], "job_id string, task string, prompt string")

    def load():
        def model(prompts):
            if "p3" in prompts:
                raise MemoryError("no room")
            return [p.upper() for p in prompts] + (["extra"] if len(prompts) > 2 else [])

        return model

    got = {r.job_id: (r.response, r.error) for r in hooks.answer_requests(requests.coalesce(1), load, group=3).collect()}
    assert got == {**{f"j{i}": (f"P{i}", None) for i in (0, 1, 2, 4)}, "j3": (None, "MemoryError: no room")}
    short = requests.select(hooks.embed(F.col("prompt"), lambda: lambda ts: [[1.0]] if len(ts) == 1 and ts != ["p2"] else []).alias("v"), "prompt")
    assert {r.prompt: r.v for r in short.collect()} == {**{f"p{i}": [1.0] for i in (0, 1, 3, 4)}, "p2": None}


def test_vector_stream_equals_batch(spark, tmp_path):
    """Batches against a store parted by cell, a replay, and the whole at once."""
    draw = random.Random(3)
    texts = []
    for i in range(60):
        base = texts[draw.randrange(len(texts))] if texts and draw.random() < 0.4 else "".join(draw.choices("abcdefgh", k=60))
        texts.append(base if draw.random() < 0.2 else base + draw.choice("abcdefgh") * draw.randrange(1, 9))
    files = uploads(spark, [t.encode() for t in texts])
    reader, rules = [("reader", F.decode("content", "UTF-8"))], GateRules(duplicates=DuplicateRules(0.97))
    embed = hooks.embedder(lambda: lambda some: [[float(t.count(c)) for c in "abcdefgh"] for t in some])
    whole = ingest(files, reader, answers(spark, 60), rules, embed=embed).results
    outcome = lambda rows: {r.job_id: (r.status, r.failed_at_node, r.rejection_reason) for r in rows}
    want = {r.job_id: r for r in whole.select("job_id", "status", "rejection_reason").collect()}
    assert len({r.status for r in want.values()}) == 2
    root, source = str(tmp_path / "out"), str(tmp_path / "in")
    for start in (0, 20, 40):
        files.where(F.col("arrival").between(start, start + 19)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(files.schema).parquet(source)
        arrivals.ingest_stream(stream, root, root + "/checkpoint", reader, answers(spark, 60), rules, embed=embed).awaitTermination()
    jobs = outcome(spark.read.parquet(root + "/jobs").collect())
    assert {j: s for j, (s, _, _) in jobs.items()} == {j: r.status for j, r in want.items()}
    assert {j: r or "" for j, (_, _, r) in jobs.items()} == {j: r.rejection_reason for j, r in want.items()}
    store = Path(root) / "accepted_vectors"
    assert len(list(store.glob("batch_id=2/cell=*"))) >= 1
    stored = spark.read.parquet(str(store)).count()
    arrivals.ingest_batch(files.where("arrival >= 40"), 2, root, reader, answers(spark, 60), rules, embed=embed)
    assert outcome(spark.read.parquet(root + "/jobs").collect()) == jobs and spark.read.parquet(str(store)).count() == stored


def test_a_batch_reads_only_the_cells_it_can_reach(spark, tmp_path):
    draw = np.random.default_rng(1)
    points = np.repeat(np.eye(6, 8) * 4, 10, axis=0) + draw.normal(0, 0.05, (60, 8))
    root = str(tmp_path)
    df = spark.createDataFrame([(f"d{i}", i, f"h{i}") for i in range(60)], "id string, arrival long, sha256 string")
    vectors = spark.createDataFrame([(f"d{i}", p.tolist()) for i, p in enumerate(points)], "id string, vec array<double>")
    from inkgate.operators.duplicates import duplicate_control

    first = duplicate_control(df, vectors=vectors, store=arrivals.open_vector_store(spark, root, 0))
    arrivals.extend_store(first, root, 0)
    store = arrivals.open_vector_store(spark, root, 1)
    assert first.documents.count() == 6 and len(store.pivots) >= 4
    near = Cells(store.pivots, np.where(np.arange(len(store.pivots)) == 0, 0.1, -np.inf)).reached(store.radii, 0.85)
    plan = store.vectors.where(F.col("cell").isin(near))._jdf.queryExecution().toString()
    assert len(near) < len(store.pivots) and re.search(r"PartitionFilters: \[.*cell", plan)


@pytest.mark.skipif(not Path(TABLES).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["ingest_cascade", "steps_long", "audit_rows", "run_events"])
def test_no_texts_in_the_joins_of_a_run(spark, name):
    plan = run_queries.QUERIES[name](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*)", plan)
    assert schemas and not any(re.search(r"\btext:", s) for s in schemas)
