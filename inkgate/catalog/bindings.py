"""How the given tables stand in for uploads, answers and events.

Every row of a table takes part. Expressions shared with the checking SQL are written once as
SQL text both engines read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgate import fixed_values as fv
from inkgate.session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def in_turns(
    rows: DataFrame, order: str, inbox: str, turns: int, run: Callable[[DataFrame], None]
) -> None:
    """``rows`` arrive in the folder ``inbox`` in ``turns`` parts by ``order``, equally wide; after
    each part ``run`` gets the stream over the folder, so every part is a micro-batch of its own."""
    spark = rows.sparkSession
    low, high = rows.agg(F.min(order), F.max(order)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // turns))
    part = F.coalesce(F.expr(f"({order} - {low or 0}L) div {width}L"), F.lit(0))
    for turn in range(turns):
        rows.where(part == turn).write.mode("append").parquet(inbox)
        run(spark.readStream.schema(rows.schema).parquet(inbox))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


# --- uploads ----------------------------------------------------------------------------------
# Every third length makes a PDF, so equal texts make equal files.
IS_PDF = "(n_chars % 3 = 0)"
DOC_JOB = "concat('doc-', cast(doc_id as string))"
# Every fifth length of those carries a wrong extension and asks a model.
DOC_SUFFIX = f"case when {IS_PDF} and n_chars % 5 = 0 then '.doc' when {IS_PDF} then '.pdf' else '.txt' end"
DOC_NAME = f"concat('doc_', cast(doc_id as string), {DOC_SUFFIX})"
DOC_BODY = f"concat(case when {IS_PDF} then '%PDF-1.4 ' else '' end, text)"
PAGE_JOB = "concat('page-', cast(page_id as string))"
PAGE_NAME = "concat('page_', cast(page_id as string), '.html')"
# pages arrive after all documents
PAGE_ARRIVAL = "(1000000000000 + page_id)"

# A converter that fails on some files, finds only numerals in scans, or reads the text; and a
# recogniser that reads everything.
TEXT_LAYER = (
    "case when n_chars % 7 = 0 then cast(null as string)"
    f" when {IS_PDF} and n_chars % 2 = 0 then regexp_replace(text, '[^0-9]', '', 'g')"
    " else text end"
)
# Spark replaces all matches without the flag.
TEXT_LAYER_SPARK = TEXT_LAYER.replace(", 'g')", ")")


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """(job_id, arrival, filename, content, language, text, n_chars) of ``documents``."""
    return as_document_files(documents(spark, folder))


def as_document_files(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.expr(DOC_JOB).alias("job_id"),
        F.col("doc_id").alias("arrival"),
        F.expr(DOC_NAME).alias("filename"),
        F.encode(F.expr(DOC_BODY), "UTF-8").alias("content"),
        F.col("lang").alias("language"),
        "text",
        "n_chars",
    )


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    return as_page_files(spread(table(spark, folder, "pages"), "page_id"))


def as_page_files(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.expr(PAGE_JOB).alias("job_id"),
        F.expr(PAGE_ARRIVAL).alias("arrival"),
        F.expr(PAGE_NAME).alias("filename"),
        F.encode("html", "UTF-8").alias("content"),
        F.lit("unknown").alias("language"),
        F.col("html").alias("text"),
        F.length("html").cast("bigint").alias("n_chars"),
    )


def all_files(spark: SparkSession, folder: str) -> DataFrame:
    return document_files(spark, folder).unionByName(page_files(spark, folder))


ALL_FILES_SQL = f"""
files AS (
  SELECT {DOC_JOB} AS job_id, doc_id AS arrival, {DOC_NAME} AS filename, {DOC_BODY} AS body,
         lang AS language, text, n_chars FROM documents
  UNION ALL
  SELECT {PAGE_JOB}, {PAGE_ARRIVAL}, {PAGE_NAME}, html, 'unknown', html, length(html) FROM pages
)"""


# --- answers of models -------------------------------------------------------------------------
CONFIDENCE = "concat('0.', cast(50 + n_chars % 50 as string))"
LEGIT_RESPONSE = f"""case doc_id % 10
 when 0 then concat('{{"is_legitimate": true, "confidence": ', {CONFIDENCE}, ', "reasoning": "numbered clauses"}}')
 when 1 then concat('Sure: {{"is_legitimate": true, "confidence": ', {CONFIDENCE}, ', "reasoning": "act"}} as asked.')
 when 2 then concat('{{"is_legitimate": "maybe", "confidence": 0.9}} {{"is_legitimate": true, "confidence": ', {CONFIDENCE}, ', "reasoning": "second"}}')
 when 3 then concat('{{"isLegitimate": false, "confidence": ', {CONFIDENCE}, ', "reasoning": "advert"}}')
 when 4 then concat('{{"is_legitimate": true, "reasoning": "cites ("Ordenanza", 5)", "confidence": ', {CONFIDENCE}, '}}')
 when 5 then 'not json at all'
 when 6 then concat('{{"confidence": "', {CONFIDENCE}, '"}}')
 when 7 then '{{"is_legitimate": 1, "confidence": 1, "reasoning": "whole numbers"}}'
 when 8 then '{{"is_legitimate": true, "confidence": null, "reasoning": "no number"}}'
 else '{{}}' end"""

# Answers of the whole run follow the labels; one length in eleven has no usable answer.
RUN_RESPONSE = f"""case when n_chars % 11 = 0 then 'no answer'
 else concat('{{"is_legitimate": ',
   case when coalesce(quality, 1) = 1 and coalesce(toxic, 0) = 0 then 'true' else 'false' end,
   ', "confidence": ', {CONFIDENCE}, ', "reasoning": "label"}}') end"""

# Answers to format questions, read or not by the kind of the length.
FORMAT_RESPONSE = """case n_chars % 4
 when 0 then '{"decision": "accept", "reasoning": "slip"}'
 when 1 then 'I say {"decision": "reject", "confidence": 0.8, "reasoning": "disguise"}'
 when 2 then '{"decision": "manual_review"}'
 else 'cannot tell' end"""

ENTITY_RESPONSE = f"""case (doc_id + attempt) % 8
 when 0 then concat('{{"doc_type_hint": "ordenanza", "number": "', cast(n_chars as string), '", "year": 1999, "issuing_body": "Concejo", "signatories": ["A. Uno", "B. Dos"], "article_count": ', cast(n_chars % 40 as string), '}}')
 when 1 then concat('Found: {{"docTypeHint": "decreto", "number": null, "year": "', cast(1950 + n_chars % 70 as string), '", "signatories": []}} end')
 when 2 then '{{"year": 1999.5}} {{"doc_type_hint": "resolucion", "year": 2001.0, "articleCount": "7"}}'
 when 3 then 'not json at all'
 when 4 then '{{}}'
 when 5 then '{{"number": 5}}'
 when 6 then '{{"signatories": ["A", 1]}}'
 else '{{"doc_type_hint": null, "signatories": null}}' end"""


def run_responses(spark: SparkSession, folder: str) -> DataFrame:
    """(job_id, task, response): the content and format answers of every document."""
    labelled = table(spark, folder, "documents").select("doc_id", "n_chars").join(
        table(spark, folder, "labels"), "doc_id", "left"
    )
    content = labelled.select(
        F.expr(DOC_JOB).alias("job_id"),
        F.lit("content").alias("task"),
        F.expr(RUN_RESPONSE).alias("response"),
    )
    formats = table(spark, folder, "documents").select(
        F.expr(DOC_JOB).alias("job_id"),
        F.lit("format").alias("task"),
        F.expr(FORMAT_RESPONSE).alias("response"),
    )
    return content.unionByName(formats)


def entity_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, job_id, attempt, response): four attempts for every document."""
    return (
        table(spark, folder, "documents")
        .select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt"))
        .select(
            "doc_id",
            F.expr(DOC_JOB).alias("job_id"),
            "attempt",
            F.expr(ENTITY_RESPONSE).alias("response"),
        )
    )


ENTITY_ATTEMPTS_SQL = f"""
attempts AS (
  SELECT doc_id, {DOC_JOB} AS job_id, attempt, {ENTITY_RESPONSE} AS response
  FROM documents, (SELECT unnest([0, 1, 2, 3]) AS attempt) a
)"""


# --- events ----------------------------------------------------------------------------------
EVENT_JOB = "concat('job-', cast(user_id as string))"
EVENT_NODE = (
    "case event_id % 5"
    f" when 0 then '{fv.NODE_RECEPTION}' when 1 then '{fv.NODE_FORMAT}'"
    f" when 2 then '{fv.NODE_EXTRACTION}' when 3 then '{fv.NODE_CONTENT}'"
    f" else '{fv.NODE_DUPLICATE}' end"
)
EVENT_STATUS = (
    "case event_type when 'view' then 'started' when 'click' then 'passed'"
    " when 'error' then 'failed' when 'purchase' then 'done' else 'review' end"
)
EVENT_MILLIS = "cast(floor(value * 10) as int)"


def node_events(spark: SparkSession, folder: str) -> DataFrame:
    """(job_id, seq, node, status, timestamp, duration_ms) of ``events``."""
    return table(spark, folder, "events").select(
        F.expr(EVENT_JOB).alias("job_id"),
        F.col("event_id").alias("seq"),
        F.expr(EVENT_NODE).alias("node"),
        F.expr(EVENT_STATUS).alias("status"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.expr(EVENT_MILLIS).alias("duration_ms"),
    )


NODE_EVENTS_SQL = f"""
node_events AS (
  SELECT {EVENT_JOB} AS job_id, event_id AS seq, {EVENT_NODE} AS node, {EVENT_STATUS} AS status,
         ts AS "timestamp", {EVENT_MILLIS} AS duration_ms FROM events
)"""


# --- SQL pieces ---------------------------------------------------------------------------------
def quoted(values: tuple[str, ...]) -> str:
    return ", ".join("'" + value.replace("'", "''") + "'" for value in values)


WS_SQL = " || ".join(f"chr({ord(c)})" for c in fv.WHITESPACE_CHARS)
WS_CLASS = (
    r"\t\n\x0b\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}"
)
