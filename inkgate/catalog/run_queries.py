"""Whole runs over all documents and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgate import fixed_values as fv
from inkgate.config import DuplicateRules, GateRules
from inkgate.catalog import answer_queries as aq
from inkgate.catalog import bindings as b
from inkgate.catalog import duplicate_queries as dq
from inkgate.catalog import gate_queries as gq
from inkgate.catalog import text_queries as tq
from inkgate.operators import tracking
from inkgate.plans import persist
from inkgate.plans.enrich import EnrichRun, accepted_documents, enrich
from inkgate.plans.ingest import IngestRun, ingest
from inkgate.session import new_path
from inkgate.sources import tables
from inkgate.streaming import events
from inkgate.streaming.arrivals import ingest_stream


def extractors() -> list[tuple[str, Column]]:
    return [("text_layer", F.expr(b.TEXT_LAYER_SPARK)), ("ocr", F.col("text"))]


def _run(spark: SparkSession, folder: str, **options) -> IngestRun:
    return ingest(b.all_files(spark, folder), extractors(), b.run_responses(spark, folder), **options)


def _outcomes(results: DataFrame) -> DataFrame:
    return results.select(
        "job_id",
        "filename",
        "status",
        "rejection_reason",
        F.col("reception.sha256").alias("sha256"),
        F.col("format_validation.decision").alias("format_decision"),
        F.col("extraction.extractor_used").alias("extractor_used"),
        F.col("extraction.char_count").alias("char_count"),
        F.col("content_validation.confidence").alias("confidence"),
        F.col("duplicate_control.duplicate_type").alias("duplicate_type"),
        F.round("duplicate_control.similarity_score", 6).alias("similarity_score"),
    )


def ingest_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return _outcomes(_run(spark, folder).results)


def embeddings_of(spark: SparkSession, folder: str):
    """For ``ingest(embed=...)``: the embedding with a document's number is its vector."""
    vectors = b.table(spark, folder, "embeddings").select(
        F.concat(F.lit("doc-"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("vec")
    )
    return lambda texts: texts.select("id").join(vectors, "id")


# No two of the given embeddings reach the shipped threshold.
VECTOR_RULES = GateRules(duplicates=DuplicateRules(dq.VECTOR_THRESHOLD))


def vector_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The whole gate with near duplicates by embeddings."""
    run = _run(spark, folder, rules=VECTOR_RULES, embed=embeddings_of(spark, folder))
    return _outcomes(run.results)


_EXTRACTED_LAYER = f"({b.TEXT_LAYER})"
_ASKED = "decision = 'slm_escalate' AND n_chars % 4 <> 3"
INGEST_CTES = f"""{gq.FORMAT_CTES.replace("formatted AS (", "rule_formatted AS (")},
formatted AS (
  SELECT * REPLACE (
    CASE WHEN {_ASKED} THEN CASE n_chars % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject'
         ELSE 'manual_review' END ELSE decision END AS decision,
    CASE WHEN {_ASKED} THEN n_chars % 4 = 0 ELSE f_passed END AS f_passed,
    {_ASKED} AS used_slm,
    CASE WHEN {_ASKED} THEN CASE n_chars % 4 WHEN 0 THEN '' WHEN 1 THEN '{fv.MSG_MODEL}disguise'
         ELSE '{fv.MSG_MODEL}' END ELSE f_reason END AS f_reason)
  FROM rule_formatted),
layered AS (SELECT *, CASE WHEN f_passed THEN {_EXTRACTED_LAYER} END AS layer FROM formatted),
extracted AS (
  SELECT * EXCLUDE (text),
    CASE WHEN NOT f_passed THEN NULL
         WHEN length(layer) >= {fv.MIN_TEXT_FOR_OCR} THEN 'text_layer' ELSE 'ocr' END AS extractor_used,
    CASE WHEN NOT f_passed THEN NULL
         WHEN length(layer) >= {fv.MIN_TEXT_FOR_OCR} THEN layer ELSE text END AS found
  FROM layered),
usable AS (
  SELECT *, CASE WHEN length(found) >= {fv.MIN_USABLE_TEXT} THEN found
                 WHEN found IS NOT NULL THEN '' END AS text FROM extracted),
answered AS (
  SELECT {b.DOC_JOB} AS job_id, {b.RUN_RESPONSE} AS response,
    CASE WHEN n_chars % 11 <> 0 THEN coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0 END AS legit,
    CASE WHEN n_chars % 11 <> 0 THEN CAST({b.CONFIDENCE} AS DOUBLE) END AS confidence,
    CASE WHEN n_chars % 11 <> 0 THEN 'label' END AS reasoning
  FROM documents LEFT JOIN labels USING (doc_id)),
with_kind AS (
  SELECT u.*, a.response, a.legit, a.confidence, a.reasoning,
    CASE WHEN u.text IS NOT NULL THEN
      {gq.content_case_sql("u.text", "language", "detected_mime = 'application/pdf'")} END AS kind
  FROM usable u LEFT JOIN answered a ON a.job_id = u.job_id),
judged AS (SELECT *, {gq.content_reason_sql("text", "language")} AS c_reason FROM with_kind),
admitted AS (SELECT * FROM judged WHERE kind = 'pass'),
reps AS (
  SELECT a.arrival AS id, a.sha256, a.text FROM admitted a
  JOIN (SELECT sha256, min(arrival) AS first_arrival FROM admitted GROUP BY 1) f
  ON f.sha256 = a.sha256 AND f.first_arrival = a.arrival),
{dq.word_pair_ctes("reps", fv.COSINE_THRESHOLD)},
{dq.greedy_ctes("reps", "pairs")},
both_ways AS (
  SELECT a AS rep, b AS other, cosine FROM pairs UNION ALL SELECT b, a, cosine FROM pairs),
duplicates AS (
  SELECT d.job_id,
    CASE WHEN r.id IN (SELECT id FROM kept) THEN CASE WHEN r.id = d.arrival THEN '' ELSE 'exact' END
         ELSE 'semantic' END AS duplicate_type,
    CASE WHEN r.id IN (SELECT id FROM kept) THEN CASE WHEN r.id = d.arrival THEN 0.0 ELSE 1.0 END
         ELSE (SELECT max(cosine) FROM both_ways w WHERE w.rep = r.id AND w.other < d.arrival
               AND w.other IN (SELECT id FROM kept)) END AS similarity_score
  FROM admitted d JOIN reps r ON r.sha256 = d.sha256),
final AS (
  SELECT j.job_id, j.arrival, j.filename, j.sha256, j.detected_mime, j.file_size_bytes,
    j.r_passed, j.r_reason, j.decision, j.f_passed, j.used_slm, j.f_reason,
    j.extractor_used, CAST(length(j.found) AS INTEGER) AS char_count, j.text, j.kind, j.c_reason,
    j.language, CASE WHEN kind IN ('pass', 'doubtful') THEN confidence
                     WHEN kind IS NOT NULL THEN 0.0 END AS confidence,
    u.duplicate_type, CAST(u.similarity_score AS DOUBLE) AS similarity_score,
    CASE u.duplicate_type WHEN 'exact' THEN '{fv.MSG_EXACT_DUPLICATE}'
      WHEN 'semantic' THEN printf('{fv.MSG_NEAR_DUPLICATE}', u.similarity_score::DOUBLE)
      ELSE '' END AS d_reason,
    CASE WHEN NOT j.r_passed THEN 'rejected'
         WHEN NOT j.f_passed THEN CASE WHEN decision IN ('manual_review', 'slm_escalate')
                                       THEN 'review' ELSE 'rejected' END
         WHEN kind = 'too_short' THEN 'rejected'
         WHEN kind <> 'pass' THEN 'review'
         WHEN u.duplicate_type <> '' THEN 'rejected' ELSE 'accepted' END AS status
  FROM judged j LEFT JOIN duplicates u ON u.job_id = j.job_id),
ingested AS (
  SELECT *, CASE WHEN status = 'accepted' THEN '' ELSE coalesce(nullif(d_reason, ''),
    nullif(c_reason, ''), nullif(f_reason, ''), nullif(r_reason, ''), '') END AS rejection_reason
  FROM final)"""

INGEST_CASCADE = f"""
WITH RECURSIVE {INGEST_CTES}
SELECT job_id, filename, status, rejection_reason, sha256, decision AS format_decision,
  extractor_used, char_count, confidence, duplicate_type,
  round(similarity_score, 6) AS similarity_score
FROM ingested
"""

_VECTOR_PAIRS = f"""
vectored AS MATERIALIZED (
  SELECT r.id, CAST(e.embedding AS DOUBLE[]) AS v FROM reps r JOIN embeddings e ON e.vec_id = r.id),
pairs AS MATERIALIZED (
  SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS cosine
  FROM vectored x JOIN vectored y ON x.id < y.id
  WHERE list_cosine_similarity(x.v, y.v) >= {dq.VECTOR_THRESHOLD})"""
VECTOR_INGEST = INGEST_CASCADE.replace(dq.word_pair_ctes("reps", fv.COSINE_THRESHOLD), _VECTOR_PAIRS)


def steps_long(spark: SparkSession, folder: str) -> DataFrame:
    steps = tracking.steps_long(_run(spark, folder).results)
    return steps.select("job_id", "step_order", "node", "status", "passed", "rejection_reason")


def _step_rows_sql() -> str:
    parts = [
        (1, fv.NODE_RECEPTION, "r_passed", "r_reason", "TRUE"),
        (2, fv.NODE_FORMAT, "f_passed", "f_reason", "r_passed"),
        (3, fv.NODE_EXTRACTION, "TRUE", "''", "f_passed"),
        (4, fv.NODE_CONTENT, "(kind = 'pass')", "c_reason", "f_passed"),
        (5, fv.NODE_DUPLICATE, "(duplicate_type = '')", "d_reason", "duplicate_type IS NOT NULL"),
    ]
    return "\nUNION ALL\n".join(
        f"SELECT job_id, {order} AS step_order, '{node}' AS node,"
        f" CASE WHEN {passed} THEN 'passed' ELSE 'failed' END AS status, {passed} AS passed,"
        f" nullif({reason}, '') AS rejection_reason FROM ingested WHERE {reached}"
        for order, node, passed, reason, reached in parts
    )


STEPS_LONG = f"WITH RECURSIVE {INGEST_CTES}\n{_step_rows_sql()}"


def run_events(spark: SparkSession, folder: str) -> DataFrame:
    return events.run_events(_run(spark, folder).results).drop("timestamp")


RUN_EVENTS = f"""
WITH RECURSIVE {INGEST_CTES},
steps AS ({_step_rows_sql()})
SELECT job_id, CAST(2 * step_order - 1 AS BIGINT) AS seq, node, 'started' AS status FROM steps
UNION ALL SELECT job_id, CAST(2 * step_order AS BIGINT), node, status FROM steps
UNION ALL SELECT job_id, CAST(11 AS BIGINT), '{fv.NODE_WHOLE_RUN}', 'done' FROM ingested
"""


def audit_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = tracking.gate_audit(_run(spark, folder).results)
    detail = F.col("detail")
    return rows.select(
        "job_id",
        "node",
        "event",
        F.get_json_object(detail, "$.filename").alias("filename"),
        F.get_json_object(detail, "$.sha256").alias("sha256"),
        F.get_json_object(detail, "$.decision").alias("decision"),
        F.get_json_object(detail, "$.char_count").cast("int").alias("char_count"),
        F.get_json_object(detail, "$.duplicate_type").alias("duplicate_type"),
        F.get_json_object(detail, "$.rejection_reason").alias("rejection_reason"),
    )


AUDIT_ROWS = f"""
WITH RECURSIVE {INGEST_CTES},
steps AS ({_step_rows_sql()})
SELECT s.job_id, s.node, s.status AS event, i.filename,
  CASE WHEN step_order IN (1, 5) THEN i.sha256 END AS sha256,
  CASE WHEN step_order = 2 THEN i.decision END AS decision,
  CASE WHEN step_order = 3 THEN i.char_count WHEN step_order = 4 THEN CAST(length(i.text) AS INTEGER)
    END AS char_count,
  CASE WHEN step_order = 5 THEN i.duplicate_type END AS duplicate_type,
  CASE WHEN step_order <> 3 THEN coalesce(s.rejection_reason, '') END AS rejection_reason
FROM steps s JOIN ingested i ON i.job_id = s.job_id
"""


def _enriched(run: IngestRun, spark: SparkSession, folder: str) -> EnrichRun:
    attempts = b.entity_attempts(spark, folder).select("job_id", "attempt", "response")
    return enrich(accepted_documents(run), attempts)


def finalize_jobs(spark: SparkSession, folder: str) -> DataFrame:
    run = _run(spark, folder)
    return persist.finalize_jobs(run, _enriched(run, spark, folder).patches)


ENRICH_CTES = f"""{INGEST_CTES},
accepted AS (SELECT * FROM ingested WHERE status = 'accepted'),
{aq.RETRY_CTES},
failed_jobs AS (
  SELECT a.job_id, last_error FROM accepted a JOIN retried r ON r.job_id = a.job_id
  WHERE NOT succeeded)"""
FINALIZE_JOBS = f"""
WITH RECURSIVE {ENRICH_CTES}
SELECT i.job_id, CASE WHEN f.job_id IS NOT NULL THEN 'review' ELSE status END AS status,
  CASE WHEN f.job_id IS NOT NULL THEN '{fv.MSG_ENRICHMENT_FAILED}' || f.last_error
       ELSE nullif(rejection_reason, '') END AS rejection_reason,
  CASE WHEN f.job_id IS NOT NULL THEN '{fv.NODE_ENRICHMENT}'
       WHEN NOT r_passed THEN '{fv.NODE_RECEPTION}' WHEN NOT f_passed THEN '{fv.NODE_FORMAT}'
       WHEN kind <> 'pass' THEN '{fv.NODE_CONTENT}'
       WHEN duplicate_type <> '' THEN '{fv.NODE_DUPLICATE}' END AS failed_at_node,
  CASE WHEN f.job_id IS NOT NULL THEN '{fv.REVIEW_ENRICHMENT_FAILED}'
       WHEN status = 'review' THEN '{fv.REVIEW_PENDING}' END AS review_action_needed,
  CASE WHEN status <> 'accepted' THEN nullif(text, '') END AS extracted_text
FROM ingested i LEFT JOIN failed_jobs f ON f.job_id = i.job_id
"""


def enriched(spark: SparkSession, folder: str) -> DataFrame:
    """Stored records of the accepted documents of a whole run."""
    run = _enriched(_run(spark, folder), spark, folder)
    return run.records.select(
        "job_id",
        "cleaned_text",
        "entities.doc_type_hint",
        "entities.year",
        F.array_join("entities.signatories", "|").alias("signatories"),
        F.col("metadata.source").alias("source"),
        F.col("metadata.language").alias("language"),
        F.col("metadata.stage2_extractor_used").alias("extractor_used"),
    )


# cleaning works on the extracted text of the accepted documents here
_CLEAN_ACCEPTED = tq.CLEAN_CTES.replace("FROM documents d", "FROM clean_input d").replace(
    "FROM documents", "FROM clean_input"
)
ENRICHED = f"""
WITH RECURSIVE {ENRICH_CTES},
clean_input AS (SELECT job_id AS doc_id, text FROM accepted),
{_CLEAN_ACCEPTED}
SELECT a.job_id, c.cleaned_text, r.doc_type_hint, r.year, r.signatories,
  '{fv.METADATA_SOURCE}' AS source, a.language, a.extractor_used
FROM accepted a JOIN retried r ON r.job_id = a.job_id AND r.succeeded
JOIN cleaned c ON c.doc_id = a.job_id
"""


def enrich_metadata(spark: SparkSession, folder: str) -> DataFrame:
    from inkgate.operators.entities import with_metadata

    docs = b.document_files(spark, folder).select(
        "job_id",
        "filename",
        "language",
        F.sha2("content", 256).alias("sha256"),
        F.when(F.expr(b.TEXT_LAYER_SPARK).isNull(), "ocr")
        .otherwise("text_layer")
        .alias("extractor_used"),
    )
    filled = with_metadata(
        docs, filename="filename", language="language", sha256="sha256", extractor="extractor_used"
    )
    return filled.select("job_id", "metadata.*")


ENRICH_METADATA = f"""
SELECT {b.DOC_JOB} AS job_id, '{fv.METADATA_SOURCE}' AS source, {b.DOC_NAME} AS filename,
  lang AS language, sha256({b.DOC_BODY}) AS sha256,
  CASE WHEN {_EXTRACTED_LAYER} IS NULL THEN 'ocr' ELSE 'text_layer' END AS stage2_extractor_used
FROM documents
"""

def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The gate as a stream over both tables in order of arrival: documents in two parts, then
    pages, each a run of its own that meets the store of those before; the job table it wrote."""
    root = new_path(spark, "ingest")
    responses = b.run_responses(spark, folder)

    def run(stream: DataFrame) -> None:
        ingest_stream(stream, root, f"{root}/checkpoint", extractors(), responses).awaitTermination()

    b.in_turns(b.document_files(spark, folder), "arrival", f"{root}/inbox", 2, run)
    b.in_turns(b.page_files(spark, folder), "arrival", f"{root}/inbox", 1, run)
    jobs = spark.read.parquet(tables.table_path(root, "jobs"))
    return jobs.select("job_id", "status", *tracking.PATCH_FIELDS)


def stream_review_queue(spark: SparkSession, folder: str) -> DataFrame:
    """From arrival to the review queue in one stream: three parts that arrive in turn are
    registered, judged, enriched and tracked; the queue is read from the tables it wrote."""
    root = new_path(spark, "review")
    responses = b.run_responses(spark, folder)
    attempts = b.entity_attempts(spark, folder).select("job_id", "attempt", "response")

    def run(stream: DataFrame) -> None:
        ingest_stream(
            stream, root, f"{root}/checkpoint", extractors(), responses, attempts=attempts
        ).awaitTermination()

    b.in_turns(b.document_files(spark, folder), "arrival", f"{root}/inbox", 2, run)
    b.in_turns(b.page_files(spark, folder), "arrival", f"{root}/inbox", 1, run)
    read = lambda name: spark.read.parquet(tables.table_path(root, name))
    queue = tracking.review_queue(read("jobs"), read("document_steps"), "node", "status")
    audit = read("audit_records").groupBy("job_id").agg(F.count(F.lit(1)).alias("n_audit"))
    entries = F.transform("document_steps", lambda s: F.concat_ws(":", s["step_order"].cast("string"), s["node"], s["status"]))
    return queue.join(audit, "job_id", "left").select(
        "job_id", "filename", "rejection_reason", F.array_join(entries, "|").alias("document_steps"), "n_audit"
    )


STREAM_INGEST = f"""
WITH RECURSIVE {INGEST_CTES}
SELECT job_id, status, nullif(rejection_reason, '') AS rejection_reason,
  CASE WHEN NOT r_passed THEN '{fv.NODE_RECEPTION}' WHEN NOT f_passed THEN '{fv.NODE_FORMAT}'
       WHEN kind <> 'pass' THEN '{fv.NODE_CONTENT}'
       WHEN duplicate_type <> '' THEN '{fv.NODE_DUPLICATE}' END AS failed_at_node,
  CASE WHEN status = 'review' THEN '{fv.REVIEW_PENDING}' END AS review_action_needed,
  CASE WHEN status <> 'accepted' THEN nullif(text, '') END AS extracted_text
FROM ingested
"""

STREAM_REVIEW_QUEUE = f"""
WITH RECURSIVE {ENRICH_CTES},
steps AS ({_step_rows_sql()}),
listed AS (
  SELECT job_id, string_agg(step_order || ':' || node || ':' || status, '|' ORDER BY step_order) AS document_steps,
    count(*) AS n FROM steps GROUP BY 1)
SELECT i.job_id, filename, CASE WHEN f.job_id IS NOT NULL THEN '{fv.MSG_ENRICHMENT_FAILED}' || f.last_error
    ELSE nullif(rejection_reason, '') END AS rejection_reason, document_steps,
  n + CASE WHEN f.job_id IS NOT NULL THEN 2 ELSE 0 END AS n_audit
FROM ingested i JOIN listed USING (job_id) LEFT JOIN failed_jobs f ON f.job_id = i.job_id
WHERE status = 'review' OR f.job_id IS NOT NULL
"""


def enrichment_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What the three steps of enrichment leave in the audit of a run."""
    run = _enriched(_run(spark, folder), spark, folder)
    detail = F.col("detail")
    return tracking.enrichment_audit(run.everything).select(
        "job_id",
        "node",
        "event",
        F.get_json_object(detail, "$.input_chars").cast("int").alias("input_chars"),
        F.get_json_object(detail, "$.error").alias("error"),
    )


ENRICHMENT_AUDIT = f"""
WITH RECURSIVE {ENRICH_CTES},
done AS (SELECT a.job_id, a.text, r.succeeded, r.last_error FROM accepted a JOIN retried r ON r.job_id = a.job_id)
SELECT job_id, '{fv.NODE_CLEANER}' AS node, 'passed' AS event, CAST(length(text) AS INTEGER) AS input_chars,
  CAST(NULL AS VARCHAR) AS error FROM done
UNION ALL SELECT job_id, '{fv.NODE_ENTITIES}', CASE WHEN succeeded THEN 'passed' ELSE 'failed' END, NULL, last_error FROM done
UNION ALL SELECT job_id, '{fv.NODE_METADATA}', 'passed', NULL, NULL FROM done WHERE succeeded
"""

QUERIES = {
    "stream_ingest": stream_ingest,
    "stream_review_queue": stream_review_queue,
    "enrichment_audit": enrichment_audit,
    "ingest_cascade": ingest_cascade,
    "vector_ingest": vector_ingest,
    "steps_long": steps_long,
    "run_events": run_events,
    "audit_rows": audit_rows,
    "finalize_jobs": finalize_jobs,
    "enrich": enriched,
    "enrich_metadata": enrich_metadata,
}
ORACLES = {
    "stream_ingest": STREAM_INGEST,
    "stream_review_queue": STREAM_REVIEW_QUEUE,
    "enrichment_audit": ENRICHMENT_AUDIT,
    "ingest_cascade": INGEST_CASCADE,
    "vector_ingest": VECTOR_INGEST,
    "steps_long": STEPS_LONG,
    "run_events": RUN_EVENTS,
    "audit_rows": AUDIT_ROWS,
    "finalize_jobs": FINALIZE_JOBS,
    "enrich": ENRICHED,
    "enrich_metadata": ENRICH_METADATA,
}
