"""Lookups, durations, chunks and files of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgate.catalog import answer_queries as aq
from inkgate.catalog import bindings as b
from inkgate.config import FormatRules
from inkgate.operators import answers, gates
from inkgate.operators.chunks import overlapping_chunks, retrieve
from inkgate.operators.durations import duration_sketch, duration_summary, merge_sketches
from inkgate.operators.lookups import look_up
from inkgate.session import new_path
from inkgate.sources.files import read_files, write_apart


def job_record(spark: SparkSession, folder: str) -> DataFrame:
    """Every job with its enriched record, if enrichment made one."""
    tried = answers.first_success(b.entity_attempts(spark, folder).select("job_id", "attempt", "response"))
    records = tried.where("entities IS NOT NULL").select("job_id", "entities.doc_type_hint", "entities.year")
    jobs = b.table(spark, folder, "documents").select(F.expr(b.DOC_JOB).alias("job_id"))
    return look_up(jobs, records, "job_id")


JOB_RECORD = f"""
WITH {aq.RETRY_CTES}
SELECT {b.DOC_JOB} AS job_id, doc_type_hint, year
FROM documents d LEFT JOIN (SELECT * FROM retried WHERE succeeded) r ON r.job_id = {b.DOC_JOB}
"""


def user_by_email(spark: SparkSession, folder: str) -> DataFrame:
    """Who stands behind the address of each order: one user or none."""
    named = lambda key: F.concat(F.lit("user"), F.col(key).cast("string"), F.lit("@example.org")).alias("email")
    users = b.table(spark, folder, "customer").where("c_acctbal >= 0").select(named("c_custkey"), F.col("c_name").alias("name"))
    return look_up(b.table(spark, folder, "orders").select("o_orderkey", named("o_custkey")), users, "email")


USER_BY_EMAIL = """
SELECT o_orderkey, 'user' || o_custkey || '@example.org' AS email, c_name AS name
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0
"""


def duration_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Count, average and percentiles of each step, from the merged sketches of two runs."""
    audit = b.node_events(spark, folder).withColumnRenamed("status", "event")
    runs = [duration_sketch(audit.where(F.col("seq") % 2 == i)) for i in (0, 1)]
    found = duration_summary(merge_sketches(*runs), 50, 95)
    return found.withColumn("avg_ms", F.round("avg_ms", 6))


DURATION_PERCENTILES = f"""
WITH {b.NODE_EVENTS_SQL},
sketch AS (
  SELECT node, status AS event, CASE WHEN duration_ms <= 0 THEN -1
      ELSE CAST(ceil(ln(CAST(duration_ms AS DOUBLE)) / ln(CAST(1.02 AS DOUBLE))) AS INTEGER) END AS bucket,
    count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS total_ms
  FROM node_events WHERE duration_ms IS NOT NULL GROUP BY ALL),
counted AS (
  SELECT *, sum(n) OVER (PARTITION BY node, event ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY node, event) AS whole,
    CASE WHEN bucket < 0 THEN 0 ELSE CAST(round(pow(1.02, bucket)) AS BIGINT) END AS top
  FROM sketch)
SELECT node, event, CAST(sum(n) AS BIGINT) AS n, round(sum(total_ms) / CAST(sum(n) AS DOUBLE), 6) AS avg_ms,
  min(top) FILTER (WHERE upto * 100 >= whole * 50) AS p50_ms, min(top) FILTER (WHERE upto * 100 >= whole * 95) AS p95_ms
FROM counted GROUP BY node, event
"""


def text_chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = b.documents(spark, folder).select("doc_id", "text")
    return overlapping_chunks(docs, key="doc_id").select("doc_id", "chunk", "start", F.sha2("text", 256).alias("sha256"))


TEXT_CHUNKS = """
WITH sized AS (
  SELECT doc_id, text, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1000 THEN 1
    ELSE CAST(ceil((length(text) - 1000) / 800.0) AS INTEGER) + 1 END AS n
  FROM documents WHERE text IS NOT NULL),
places AS (SELECT doc_id, text, CAST(unnest(range(0, n)) AS INTEGER) AS chunk FROM sized)
SELECT doc_id, chunk, CAST(chunk AS BIGINT) * 800 AS start, sha256(substring(text, chunk * 800 + 1, 1000)) AS sha256
FROM places
"""


def nearest_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The three nearest of all embeddings for each of them, with the files they stand for."""
    vectors = b.table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    names = b.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.expr(b.DOC_NAME).alias("source"))
    found = retrieve(vectors, vectors.join(names, "id", "left"), k=3)
    return found.select("id", "rank", "chunk_id", "source", F.round("cosine", 6).alias("cosine"))


NEAREST_SOURCES = f"""
WITH sims AS (
  SELECT x.vec_id AS id, y.vec_id AS chunk_id,
    list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS cosine
  FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY cosine DESC, chunk_id) AS INTEGER) AS rank FROM sims)
SELECT id, rank, chunk_id, CASE WHEN doc_id IS NOT NULL THEN {b.DOC_NAME} END AS source, round(cosine, 6) AS cosine
FROM ranked LEFT JOIN documents ON doc_id = chunk_id WHERE rank <= 3
"""

# Bytes; some documents are larger.
FILE_LIMIT_MB = 0.002


def files_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Reception over files: every document is written as a file of its own, then listed, judged by
    size, and read where it passes."""
    inbox = new_path(spark, "inbox")
    docs = b.documents(spark, folder).select("doc_id", F.coalesce("text", F.lit("")).alias("value"))
    write_apart(docs, "doc_id", inbox)
    rules = FormatRules(max_file_size_mb=FILE_LIMIT_MB)
    found = gates.receive(read_files(spark, inbox, limit=int(rules.max_file_size_bytes)), rules)
    return found.select("reception.passed", "reception.sha256", "reception.file_size_bytes", (F.col("content").isNull()).alias("unread"))


_TOO_LARGE = f"strlen(text) + 1 > {int(FILE_LIMIT_MB * 1024 * 1024)}"
FILES_GATE = f"""
SELECT NOT {_TOO_LARGE} AS passed, CASE WHEN {_TOO_LARGE} THEN '' ELSE sha256(text || chr(10)) END AS sha256,
  CAST(strlen(text) + 1 AS BIGINT) AS file_size_bytes, {_TOO_LARGE} AS unread
FROM (SELECT coalesce(text, '') AS text FROM documents)
"""

QUERIES = {
    "job_record": job_record,
    "user_by_email": user_by_email,
    "duration_percentiles": duration_percentiles,
    "text_chunks": text_chunks,
    "nearest_sources": nearest_sources,
    "files_gate": files_gate,
}
ORACLES = {
    "job_record": JOB_RECORD,
    "user_by_email": USER_BY_EMAIL,
    "duration_percentiles": DURATION_PERCENTILES,
    "text_chunks": TEXT_CHUNKS,
    "nearest_sources": NEAREST_SOURCES,
    "files_gate": FILES_GATE,
}
