from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkgate.config import EnrichmentRules
from inkgate.operators import answers, entities


def legit(spark, response):
    df = spark.createDataFrame([(response,)], "response string")
    got = answers.parse_legitimacy(df, "response").first().legitimacy
    return None if got is None else (got.is_legitimate, got.confidence, got.reasoning)


@pytest.mark.parametrize(
    ("response", "want"),
    [
        ('{"is_legitimate": true, "confidence": 0.9, "reasoning": "r"}', (True, 0.9, "r")),
        ('text {"isLegitimate": true, "confidence": 1} text', (True, 1.0, "")),
        ('{"confidence": "0.75"}', (False, 0.75, "")),
        ('{"other": 1}', (False, 0.5, "")),
        ('{"is_legitimate": "yes", "confidence": true}', (True, 1.0, "")),
        ('{"is_legitimate": 0, "confidence": 1e-1}', (False, 0.1, "")),
        ('{"is_legitimate": 2} {"is_legitimate": 1.0}', (True, 0.5, "")),
        ('{"reasoning": 5} {"reasoning": "second"}', (False, 0.5, "second")),
        ('{"reasoning": null}', None),
        ('{"is_legitimate": null, "confidence": 0.9}', None),
        ("{}", None),
        ("not json", None),
        (None, None),
        (
            '{"is_legitimate": TRUE, "reasoning": "a "b" c", "confidence": .8}',
            (True, 0.8, 'a "b" c'),
        ),
        ('"is_legitimate": false, "confidence": 7', (False, 7.0, "")),
        ('{"is_legitimate": true, "confidence": 0.9,\n "reasoning": "two\\nlines"}', (True, 0.9, "two\nlines")),
        ('{"is_legitimate": true, "confidence": 0.2, "confidence": 0.9}', (True, 0.9, "")),
    ],
)
def test_legitimacy(spark, response, want):
    assert legit(spark, response) == want


def parsed(spark, response):
    df = spark.createDataFrame([(response,)], "response string")
    got = answers.parse_entities(df, "response").first().entities
    return None if got is None else tuple(got)


@pytest.mark.parametrize(
    ("response", "want"),
    [
        ("{}", (None, None, None, None, [], None)),
        (
            '{"doc_type_hint": "ordenanza", "number": "6731", "year": 1999, "issuing_body": "C",'
            ' "signatories": ["A", "B"], "article_count": 4}',
            ("ordenanza", "6731", 1999, "C", ["A", "B"], 4),
        ),
        ('x {"docTypeHint": "decreto", "articleCount": "12"} y', ("decreto", None, None, None, [], 12)),
        ('{"year": "1999"}', (None, None, 1999, None, [], None)),
        ('{"year": 1999.0}', (None, None, 1999, None, [], None)),
        ('{"year": true}', (None, None, 1, None, [], None)),
        ('{"year": 1999.5}', None),
        ('{"year": "nineteen"}', None),
        ('{"number": 5}', None),
        ('{"number": 5} {"number": "5"}', (None, "5", None, None, [], None)),
        ('{"signatories": null}', None),
        ('{"signatories": ["A", 1]}', None),
        ('{"signatories": [null]}', None),
        ('{"signatories": "A"}', None),
        ("not json at all", None),
        ("", None),
    ],
)
def test_entities(spark, response, want):
    assert parsed(spark, response) == want


def test_retry_rules(spark):
    good = '{"number": "1"}'
    rows = [
        ("first", 0, good), ("first", 1, "bad"),
        ("third", 0, "bad"), ("third", 1, "worse"), ("third", 2, good),
        ("late", 0, "a"), ("late", 1, "b"), ("late", 2, "c"), ("late", 3, good),
        ("few", 0, "only"),
    ]
    df = spark.createDataFrame(rows, "job_id string, attempt int, response string")
    got = {r.job_id: r for r in answers.first_success(df, EnrichmentRules()).collect()}
    assert got["first"].attempts_made == 1 and got["first"].entities.number == "1"
    assert got["third"].attempts_made == 3 and got["third"].last_error is None
    assert got["late"].entities is None and got["late"].attempts_made == 3
    assert got["late"].last_error == "No valid JSON object found in LLM output: c"
    assert got["few"].entities is None and got["few"].attempts_made == 1


def test_attempts_without_response(spark):
    rows = [("j", 0, None, "out of memory"), ("j", 1, None, "timed out")]
    df = spark.createDataFrame(rows, "job_id string, attempt int, response string, error string")
    [row] = answers.first_success(df).collect()
    assert row.entities is None and row.last_error == "timed out"


def test_templates_keep_braces_of_values(spark):
    df = spark.createDataFrame([("{language} {x}", "es")], "text string, language string")
    prompt = answers.render(
        ("L {language}", "T {text} {unknown}"), {"text": F.col("text"), "language": F.col("language")}
    )
    assert df.select(prompt.alias("p")).first().p == "L es\nT {language} {x} {unknown}"


def test_requests_carry_excerpts(spark):
    text = "é" * 6000
    df = spark.createDataFrame([("j", text, "es")], "job_id string, text string, language string")
    prompt = answers.content_requests(df).first().prompt
    assert prompt.count("é") == 5000


def test_rule_entities_and_signals(spark):
    text = (
        "ORDENANZA N° 6.731/99\nVISTO el expediente; CONSIDERANDO que en 1999\n"
        "Artículo 1 ...\nARTÍCULO 2 ...\nRESUELVE"
    )
    df = spark.createDataFrame([(text,)], "text string")
    found = df.select(entities.rule_entities(F.col("text")).alias("e")).first().e
    assert (found.doc_type_hint, found.number, found.year, found.article_count) == (
        "ordenanza", "6.731/99", 1999, 2,
    )
    assert found.issuing_body is None and found.signatories == []
    row = entities.signal_counts(df).first()
    assert row.signals == [1, 1, 1, 0, 1, 1] and row.n_signals == 5


def test_repeated_responses_do_not_multiply_jobs(spark):
    jobs = spark.createDataFrame([("a",), ("b",)], "job_id string")
    told = [("a", "t", 1, "old"), ("a", "t", 2, "new"), ("a", "u", 3, "other"), ("b", "t", 1, None)]
    rows = answers.with_response(jobs, spark.createDataFrame(told, "job_id string, task string, attempt int, response string"), "t", "out")
    assert sorted((r.job_id, r.out) for r in rows.collect()) == [("a", "new"), ("b", None)]
