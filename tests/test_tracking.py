from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from inkgate.config import FormatRules
from inkgate.operators import tracking
from inkgate.plans import persist
from inkgate.plans.enrich import accepted_documents, enrich
from inkgate.plans.ingest import ingest
from inkgate.sources import files as file_source
from inkgate.sources import tables
from inkgate.sources.rules import load_rules

T0 = dt.datetime(2024, 1, 1)
PATCH = (
    "job_id string, seq long, status string, rejection_reason struct<v:string>,"
    " failed_at_node struct<v:string>, review_action_needed struct<v:string>,"
    " extracted_text struct<v:string>"
)
LONG = "Este es un texto suficientemente largo para pasar todos los controles del sistema número "
LEGIT = '{"is_legitimate": true, "confidence": 0.9, "reasoning": "ok"}'


def test_patches_unset_and_clear(spark):
    rows = [
        ("a", 1, "review", ("why",), ("node3",), ("pending",), ("text",)),
        ("a", 2, "accepted", None, None, None, None),
        ("b", 1, "review", ("why",), None, None, None),
        ("b", 2, "review", (None,), None, None, None),
    ]
    patches = spark.createDataFrame(rows, PATCH)
    got = {r.job_id: r for r in tracking.merge_patches(patches).collect()}
    assert got["a"].status == "accepted" and got["a"].rejection_reason == "why"
    assert got["a"].review_action_needed == "pending" and got["a"].extracted_text == "text"
    assert got["b"].rejection_reason is None
    jobs = spark.createDataFrame(
        [("b", "started", "f", T0, T0, "old", "old", None, "old"), ("c", "started", "f", T0, T0, "old", None, None, None)],
        "job_id string, status string, filename string, created_at timestamp,"
        " updated_at timestamp, rejection_reason string, failed_at_node string,"
        " review_action_needed string, extracted_text string",
    )
    after = {r.job_id: r for r in tracking.apply_patches(jobs, patches).collect()}
    assert after["b"].rejection_reason is None and after["b"].failed_at_node == "old"
    assert after["b"].updated_at > T0 and after["c"].updated_at == T0
    assert after["c"].status == "started" and after["c"].rejection_reason == "old"


def test_decisions(spark):
    jobs = spark.createDataFrame(
        [("r", "review"), ("d", "accepted"), ("s", "started")], "job_id string, status string"
    )
    rows = [
        (1, "r", "reject", T0 + dt.timedelta(hours=2)),
        (2, "r", "accept", T0 + dt.timedelta(hours=1)),
        (3, "d", "accept", T0),
        (4, "s", "escalate", T0),
        (5, "missing", "accept", T0),
    ]
    decisions = spark.createDataFrame(
        rows, "decision_id long, job_id string, decision string, decided_at timestamp"
    )
    got = {
        r.decision_id: (r.outcome, r.new_status)
        for r in tracking.decision_outcomes(decisions, jobs).collect()
    }
    assert got == {
        1: ("not_in_review", None),
        2: ("recorded", "accepted"),
        3: ("not_in_review", None),
        4: ("not_in_review", None),
        5: ("not_found", None),
    }


def test_queue_keeps_jobs_without_steps(spark):
    jobs = spark.createDataFrame(
        [("a", "f", "review", None, T0), ("b", "g", "review", "x", T0), ("c", "h", "accepted", None, T0)],
        "job_id string, filename string, status string, rejection_reason string, created_at timestamp",
    )
    steps = spark.createDataFrame(
        [("a", 2, "n2"), ("a", 1, "n1"), ("c", 1, "n1")], "job_id string, step_order int, node string"
    )
    got = {r.job_id: [tuple(s) for s in r.document_steps] for r in tracking.review_queue(jobs, steps, "node").collect()}
    assert got == {"a": [(1, "n1"), (2, "n2")], "b": []}


def test_allow_list(spark):
    users = spark.createDataFrame(
        [("ok", True, False), ("off", False, False), ("bad", True, True)],
        "email string, is_active boolean, is_blocked boolean",
    )
    asked = spark.createDataFrame([("ok",), ("off",), ("bad",), ("new",)], "email string")
    assert [r.email for r in tracking.allowed(asked, users).collect()] == ["ok"]


def test_audit_refuses_empty_ids(spark):
    rows = [("j", "n", "passed"), ("", "n", "passed"), ("j", None, "passed"), ("j", "n", "")]
    df = spark.createDataFrame(rows, "job_id string, node string, event string")
    valid, refused = tracking.split_audit(df)
    assert valid.count() == 1 and refused.count() == 3


def _uploads(spark):
    rows = [
        ("good", 1, "a.txt", (LONG + "1").encode(), "es"),
        ("copy", 2, "b.txt", (LONG + "1").encode(), "es"),
        ("near", 3, "c.txt", (LONG + "uno dos tres cuatro cinco seis siete ocho nueve").encode(), "es"),
        ("near2", 4, "d.txt", (LONG + "uno dos tres cuatro cinco seis siete ocho NUEVE.").encode(), "es"),
        ("gone", 5, "e.txt", None, "es"),
        ("empty", 6, "f.txt", b"", "es"),
        ("page", 7, "g.html", b"<html>", "es"),
        ("scan", 8, "h.pdf", b"%PDF-1.4", "es"),
        ("short", 9, "i.txt", b"corto", "es"),
        ("french", 10, "j.txt", (LONG + "fr").encode(), "fr"),
        ("spam", 11, "k.txt", (LONG + "spam").encode(), "es"),
        ("zip", 12, "l.bin", b"PK\x03\x04 data", "es"),
        ("slip", 13, "m.doc", b"%PDF-1.4" + (LONG + "otra cosa distinta por completo aqui").encode(), "es"),
        ("slip2", 14, "n.doc", b"%PDF-1.4" + LONG.encode(), "es"),
    ]
    files = spark.createDataFrame(
        rows, "job_id string, arrival long, filename string, content binary, language string"
    )
    body = F.decode(F.col("content"), "UTF-8")
    text = F.when(body.startswith("%PDF-1.4"), F.substring(body, 9, 10**6)).otherwise(body)
    files = files.withColumn("text", F.when(F.col("job_id") == "scan", "").otherwise(text))
    answers = [(r[0], "content", LEGIT) for r in rows if r[0] != "spam"]
    answers += [
        ("spam", "content", LEGIT.replace("true", "false")),
        ("slip", "format", '{"decision": "accept", "reasoning": "slip"}'),
    ]
    responses = spark.createDataFrame(answers, "job_id string, task string, response string")
    return files, responses


def test_whole_run(spark):
    files, responses = _uploads(spark)
    run = ingest(files, [("reader", F.col("text"))], responses)
    rows = {r.job_id: r for r in run.results.collect()}
    status = {k: r.status for k, r in rows.items()}
    assert status == {
        "good": "accepted",
        "copy": "rejected",
        "near": "accepted",
        "near2": "rejected",
        "gone": "rejected",
        "empty": "rejected",
        "page": "rejected",
        "scan": "review",
        "short": "rejected",
        "french": "review",
        "spam": "review",
        "zip": "review",
        "slip": "accepted",
        "slip2": "review",
    }
    assert rows["copy"].duplicate_control.duplicate_type == "exact"
    assert rows["near2"].duplicate_control.duplicate_type == "semantic"
    assert rows["gone"].rejection_reason == "No file provided"
    assert rows["good"].rejection_reason == "" and rows["page"].extraction is None
    assert rows["slip"].format_validation.used_slm
    assert rows["slip2"].extraction is None and rows["slip2"].content_validation is None
    assert {r.id for r in run.control.documents.collect()} == {"good", "near", "slip"}

    steps = tracking.steps_long(run.results)
    per_job = {r.job_id: r.n for r in steps.groupBy("job_id").agg(F.count("*").alias("n")).collect()}
    assert (per_job["gone"], per_job["page"], per_job["french"], per_job["good"]) == (1, 2, 4, 5)
    nodes = [r.node for r in steps.where("job_id = 'french'").orderBy("step_order").collect()]
    assert nodes == [
        "node1_file_reception", "node2_format_validation", "extraction", "node3_content_validation",
    ]
    failed = {r.job_id: r.failed_at_node for r in tracking.failed_step(steps).collect()}
    assert failed["copy"] == "node4_duplicate_control" and failed["good"] is None

    audit = tracking.gate_audit(run.results)
    detail = json.loads(audit.where("job_id = 'good' and node = 'extraction'").first().detail)
    assert set(detail) == {"filename", "extractor_used", "char_count"}
    assert audit.where("detail like '%suficientemente%'").count() == 0
    assert persist.tracking_tables(run.results)["hash_records"].count() == 3

    accepted = accepted_documents(run)
    attempts = spark.createDataFrame(
        [("good", 0, '{"year": 2001}'), ("near", 0, "bad"), ("near", 1, "bad"), ("near", 2, "bad")]
        + [("slip", 1, "{}"), ("slip", 0, "bad")],
        "job_id string, attempt int, response string",
    )
    enriched = enrich(accepted, attempts)
    records = {r.job_id: r for r in enriched.records.collect()}
    assert set(records) == {"good", "slip"} and records["good"].entities.year == 2001
    assert records["good"].metadata.source == "manual_upload"
    jobs = {r.job_id: r for r in persist.finalize_jobs(run, enriched.patches).collect()}
    assert jobs["near"].status == "review" and jobs["near"].failed_at_node == "enrichment"
    assert jobs["near"].review_action_needed == "enrichment_failed"
    assert jobs["near"].extracted_text is None
    assert jobs["good"].status == "accepted" and jobs["good"].extracted_text is None
    assert jobs["french"].review_action_needed == "pending"
    assert jobs["french"].extracted_text == LONG + "fr"
    events = tracking.enrichment_audit(enriched.everything)
    kinds = {(r.job_id, r.node, r.event) for r in events.collect()}
    assert ("near", "enrichment_entity_extractor", "failed") in kinds
    assert ("near", "enrichment_metadata_enricher", "passed") not in kinds
    assert ("good", "enrichment_metadata_enricher", "passed") in kinds


def test_files_and_tables(spark, tmp_path):
    for name, body in (("b.txt", b"two"), ("a.pdf", b"%PDF"), ("c.md", b"")):
        (tmp_path / name).write_bytes(body)
    listing = spark.createDataFrame(
        [(f"file:{tmp_path}/c.md", T0, 0), (f"file:{tmp_path}/a.pdf", T0, 4)],
        "path string, modificationTime timestamp, length long",
    )
    uploads = file_source.read_files(spark, str(tmp_path), listing=listing)
    assert {(r.filename, bytes(r.content)) for r in uploads.collect()} == {
        ("b.txt", b"two"), ("a.pdf", b"%PDF"), ("c.md", b""),
    }
    again = file_source.read_files(spark, str(tmp_path), pattern="*.txt")
    assert again.first().job_id == uploads.where("filename = 'b.txt'").first().job_id

    root = str(tmp_path / "tables")
    frame = spark.createDataFrame([("x", 1)], "k string, v int")
    assert tables.read_table(spark, root, "t", frame.schema).count() == 0
    tables.append(frame, root, "t")
    tables.append(frame, root, "t")
    assert tables.read_table(spark, root, "t", frame.schema).count() == 2
    for batch in (0, 1, 1):
        tables.append_batch(frame, root, "s", batch)
    assert tables.read_before(spark, root, "s", frame.schema, 2).count() == 2
    assert tables.read_before(spark, root, "s", frame.schema, 1).count() == 1


def test_rules_from_yaml(tmp_path):
    path = tmp_path / "formats.yaml"
    path.write_text(
        "allowed_mime_types: [application/pdf]\nmax_file_size_mb: 2\nnot_a_rule: 1\n"
        "known_mismatches:\n  application/zip: [.docx]\n"
    )
    rules = load_rules(str(path), FormatRules)
    assert rules.allowed_mime_types == ("application/pdf",)
    assert rules.max_file_size_bytes == 2 * 1024 * 1024
    assert rules.known_mismatches == {"application/zip": (".docx",)}
    assert rules.disabled_extensions == (".html", ".htm")
