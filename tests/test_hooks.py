from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from inkgate.functions.naming import as_json_items, camel_case
from inkgate.functions.vectors import cosine, unit
from inkgate.operators import hooks
from inkgate.operators.extraction import from_attempts
from inkgate.session import cut, drop_written, scratch


def test_extractors_in_two_passes(spark):
    files = spark.createDataFrame(
        [("a", "a.pdf", b"x" * 60), ("b", "b.pdf", b"short"), ("c", "c.pdf", b"bad"), ("d", "d", None)],
        "job_id string, filename string, content binary",
    )

    def cheap():
        def read(content, filename):
            if content == b"bad":
                raise ValueError(filename)
            return content.decode()

        return read

    first = hooks.run_extractor(files, 1, "cheap", cheap)
    rest = hooks.still_thin(files, first, 50)
    assert {r.job_id for r in rest.collect()} == {"b", "c", "d"}
    second = hooks.run_extractor(rest, 2, "costly", lambda: lambda content, name: "y" * 70)
    best = {
        r.job_id: r.extraction
        for r in from_attempts(first.unionByName(second)).collect()
    }
    assert best["a"].extractor_used == "cheap" and best["b"].extractor_used == "costly"
    assert best["c"].char_count == 70
    assert first.where("job_id = 'c'").first().error == "ValueError: c.pdf"


def test_models_answer_in_batches(spark):
    requests = spark.createDataFrame(
        [("a", "content", "p1"), ("b", "content", "p2")], "job_id string, task string, prompt string"
    )
    got = hooks.answer_requests(requests, lambda: lambda prompts: [p.upper() for p in prompts])
    assert {(r.job_id, r.response, r.error) for r in got.collect()} == {
        ("a", "P1", None), ("b", "P2", None),
    }

    def broken():
        def fail(prompts):
            raise MemoryError("no room")

        return fail

    failed = hooks.answer_requests(requests, broken, attempt=1).collect()
    assert {(r.attempt, r.response, r.error) for r in failed} == {(1, None, "MemoryError: no room")}


def test_embedding_column(spark):
    df = spark.createDataFrame([("ab",), ("abc",)], "text string")
    vectors = df.select(hooks.embed(F.col("text"), lambda: lambda ts: [[float(len(t)), 1.0] for t in ts]).alias("v"))
    assert sorted(r.v for r in vectors.collect()) == [[2.0, 1.0], [3.0, 1.0]]


def test_cosine_columns(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])],
        "a array<float>, b array<float>",
    )
    got = df.select(cosine(F.col("a"), F.col("b")).alias("c"), unit(F.col("b")).alias("u")).collect()
    assert [r.c for r in got] == [1.0, 0.0, 0.0]
    assert got[0].u == [1.0, 0.0] and got[2].u == pytest.approx([2**-0.5] * 2)


def test_camel_case_names(spark):
    df = spark.createDataFrame(
        [("j", [(1, "n")], None)],
        "job_id string, document_steps array<struct<step_order int, node_name string>>, a_b_c int",
    )
    assert camel_case(df).columns == ["jobId", "documentSteps", "aBC"]
    item = json.loads(as_json_items(df).first().item)
    assert item == {"jobId": "j", "documentSteps": [{"stepOrder": 1, "nodeName": "n"}], "aBC": None}


def test_written_tables_can_be_removed(spark):
    with scratch(spark):
        inside = cut(spark.range(3), "t")
        assert inside.count() == 3
    with pytest.raises(Exception):
        inside.count()
    outside = cut(spark.range(3), "t")
    assert outside.count() == 3
    drop_written(spark)
    with pytest.raises(Exception):
        outside.count()
