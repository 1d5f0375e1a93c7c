"""Reception, format, extraction, content and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgate import fixed_values as fv
from inkgate.catalog import bindings as b
from inkgate.config import ContentRules, ExtractionRules, FormatRules
from inkgate.functions import text as tx
from inkgate.functions.mime import detect_mime
from inkgate.operators import answers, extraction, gates

FORMATS = FormatRules()
EXTRACTION = ExtractionRules()
CONTENT = ContentRules()


def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    files = b.all_files(spark, folder)
    return files.select(
        "job_id",
        F.octet_length("content").cast("bigint").alias("n_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


CONTENT_HASH = f"""
WITH {b.ALL_FILES_SQL}
SELECT job_id, octet_length(encode(body)) AS n_bytes, sha256(body) AS sha256 FROM files
"""

# Leading bytes put before each document's text, chosen by its length.
_LEADS = (
    "25504446",
    "89504E470D0A1A0A",
    "FFD8FFE0",
    "49492A00",
    "504B0304",
    "504B0304776F72642F",
    "504B0304786C2F",
    "1F8B08",
    "",
)


def mime_sniff(spark: SparkSession, folder: str) -> DataFrame:
    docs = b.documents(spark, folder)
    lead = F.lit("")
    for i, magic in enumerate(_LEADS):
        lead = F.when(F.col("n_chars") % len(_LEADS) == i, F.lit(magic)).otherwise(lead)
    docs = docs.select(
        "doc_id",
        F.concat(F.unhex(lead), F.encode("text", "UTF-8")).alias("content"),
        F.expr(b.DOC_NAME).alias("filename"),
    )
    return docs.select(
        "doc_id",
        detect_mime(F.col("content")).alias("mime"),
        tx.file_suffix(F.col("filename")).alias("suffix"),
    )


MIME_SNIFF = f"""
SELECT doc_id,
       CASE n_chars % {len(_LEADS)}
         WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg'
         WHEN 3 THEN 'image/tiff'
         WHEN 4 THEN CASE WHEN contains(text, 'word/') THEN '{fv.ZIP_MEMBER_FOLDERS[0][0]}'
                          WHEN contains(text, 'xl/') THEN '{fv.ZIP_MEMBER_FOLDERS[1][0]}'
                          WHEN contains(text, 'ppt/') THEN '{fv.ZIP_MEMBER_FOLDERS[2][0]}'
                          ELSE 'application/zip' END
         WHEN 5 THEN '{fv.ZIP_MEMBER_FOLDERS[0][0]}'
         WHEN 6 THEN CASE WHEN contains(text, 'word/') THEN '{fv.ZIP_MEMBER_FOLDERS[0][0]}'
                          ELSE '{fv.ZIP_MEMBER_FOLDERS[1][0]}' END
         WHEN 7 THEN 'application/gzip'
         ELSE CASE WHEN starts_with(text, '%!') THEN 'application/postscript'
                   WHEN starts_with(text, 'BM') THEN 'image/bmp'
                   WHEN starts_with(text, 'MZ') THEN 'application/x-msdownload'
                   WHEN starts_with(text, 'BZh') THEN 'application/x-bzip2'
                   WHEN starts_with(text, 'ID3') THEN 'audio/mpeg'
                   ELSE 'application/octet-stream' END END AS mime,
       {b.DOC_SUFFIX} AS suffix
FROM documents
"""


def _received(spark: SparkSession, folder: str) -> DataFrame:
    return gates.receive(b.all_files(spark, folder), FORMATS)


def reception_gate(spark: SparkSession, folder: str) -> DataFrame:
    return _received(spark, folder).select("job_id", "reception.*")


RECEPTION_CTES = f"""
{b.ALL_FILES_SQL},
reception AS (
  SELECT *, octet_length(encode(body)) AS file_size_bytes,
    CASE WHEN body IS NULL THEN '{fv.MSG_NO_FILE}'
         WHEN octet_length(encode(body)) = 0 THEN '{fv.MSG_EMPTY_FILE}'
         WHEN octet_length(encode(body)) > {FORMATS.max_file_size_bytes}
         THEN '{fv.MSG_TOO_LARGE.format(limit_mb=FORMATS.max_file_size_mb)}' ELSE '' END AS r_reason
  FROM files),
received AS (
  SELECT *, r_reason = '' AS r_passed,
    CASE WHEN r_reason = '' THEN sha256(body) ELSE '' END AS sha256,
    CASE WHEN r_reason <> '' THEN '' WHEN starts_with(body, '%PDF') THEN 'application/pdf'
         WHEN starts_with(body, '%!') THEN 'application/postscript'
         WHEN starts_with(body, 'BM') THEN 'image/bmp'
         WHEN starts_with(body, 'MZ') THEN 'application/x-msdownload'
         WHEN starts_with(body, 'BZh') THEN 'application/x-bzip2'
         WHEN starts_with(body, 'ID3') THEN 'audio/mpeg'
         ELSE 'application/octet-stream' END AS detected_mime
  FROM reception)"""

RECEPTION_GATE = f"""
WITH {RECEPTION_CTES}
SELECT job_id, r_passed AS passed, sha256, detected_mime, file_size_bytes,
       r_reason AS rejection_reason FROM received
"""


def format_gate(spark: SparkSession, folder: str) -> DataFrame:
    return gates.check_format(_received(spark, folder), FORMATS).select(
        "job_id", "filename", "format_validation.*"
    )


_MISMATCH_SQL = " OR ".join(
    f"(detected_mime = '{mime}' AND suffix IN ({b.quoted(exts)}))"
    for mime, exts in fv.KNOWN_MISMATCHES.items()
)
_WRONG_SQL = " OR ".join(
    f"(detected_mime = '{mime}' AND suffix NOT IN ({b.quoted(exts)}))"
    for mime, exts in fv.MIME_TO_EXTENSIONS.items()
)
FORMAT_CTES = f"""{RECEPTION_CTES},
suffixed AS (SELECT *, lower(regexp_extract(filename, '^.+(\\.[^.]+)$', 1)) AS suffix FROM received),
ruled AS (
  SELECT *, CASE
    WHEN detected_mime IN ({b.quoted(fv.DISABLED_MIME_TYPES)})
      OR suffix IN ({b.quoted(fv.DISABLED_EXTENSIONS)}) THEN 'reject'
    WHEN detected_mime NOT IN ({b.quoted(fv.ALLOWED_MIME_TYPES)})
      THEN CASE WHEN {_MISMATCH_SQL} THEN 'accept' ELSE 'manual_review' END
    WHEN {_WRONG_SQL} THEN 'slm_escalate' ELSE 'accept' END AS decision
  FROM suffixed),
formatted AS (
  SELECT *, decision = 'accept' AS f_passed, FALSE AS used_slm,
    CASE decision WHEN 'accept' THEN '' WHEN 'slm_escalate' THEN ''
      WHEN 'reject' THEN '{fv.MSG_FORMAT_REJECTED}' || detected_mime
      ELSE '{fv.MSG_UNKNOWN_MIME}' || detected_mime END AS f_reason
  FROM ruled)"""

FORMAT_GATE = f"""
WITH {FORMAT_CTES}
SELECT job_id, filename, f_passed AS passed, decision, used_slm, f_reason AS rejection_reason
FROM formatted
"""


def _attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Long attempts table: rank 1 the text layer, rank 2 the recogniser."""
    docs = b.documents(spark, folder)
    layer = F.expr(b.TEXT_LAYER_SPARK)
    rows = F.array(
        F.struct(
            F.lit(1).alias("rank"),
            F.lit("text_layer").alias("extractor"),
            layer.alias("text"),
            F.when(layer.isNull(), "conversion failed").alias("error"),
        ),
        F.struct(
            F.lit(2).alias("rank"),
            F.lit("ocr").alias("extractor"),
            F.col("text").alias("text"),
            F.when(F.col("n_chars") % 5 == 0, "recognition failed").alias("error"),
        ),
    )
    return docs.select(F.expr(b.DOC_JOB).alias("job_id"), F.explode(rows).alias("a")).select(
        "job_id", "a.*"
    )


def extraction_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.from_attempts(_attempts(spark, folder), EXTRACTION).select(
        "job_id", "extraction.text", "extraction.extractor_used", "extraction.char_count"
    )


EXTRACTION_CASCADE = f"""
WITH attempts AS (
  SELECT {b.DOC_JOB} AS job_id, 1 AS rank, 'text_layer' AS extractor, {b.TEXT_LAYER} AS text,
         {b.TEXT_LAYER} IS NOT NULL AS ok FROM documents
  UNION ALL
  SELECT {b.DOC_JOB}, 2, 'ocr', text, n_chars % 5 <> 0 FROM documents),
ranked AS (
  SELECT job_id,
    min(rank) FILTER (WHERE ok AND length(text) >= {fv.MIN_TEXT_FOR_OCR}) AS enough,
    max(rank) FILTER (WHERE ok) AS last_ok
  FROM attempts GROUP BY job_id),
picked AS (
  SELECT r.job_id, coalesce(a.text, '') AS text, coalesce(a.extractor, '') AS extractor
  FROM ranked r LEFT JOIN attempts a
    ON a.job_id = r.job_id AND a.rank = coalesce(r.enough, r.last_ok))
SELECT job_id, CASE WHEN length(text) >= {fv.MIN_USABLE_TEXT} THEN text ELSE '' END AS text,
       extractor AS extractor_used, CAST(length(text) AS INTEGER) AS char_count
FROM picked
"""


def content_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Content verdicts of the documents, with the varied answers of ``LEGIT_RESPONSE``."""
    docs = b.documents(spark, folder).select(
        F.expr(b.DOC_JOB).alias("job_id"),
        F.col("lang").alias("language"),
        F.expr(b.LEGIT_RESPONSE).alias("response"),
        F.struct("text").alias("extraction"),
        F.struct(
            F.when(F.expr(b.IS_PDF), fv.PDF_MIME).otherwise(fv.UNKNOWN_MIME).alias("detected_mime")
        ).alias("reception"),
    )
    judged = gates.check_content(
        answers.parse_legitimacy(docs, "response"), CONTENT, response="response"
    )
    return judged.select("job_id", "content_validation.*")


def content_case_sql(text: str, language: str, is_pdf: str) -> str:
    return f"""CASE
    WHEN length({text}) < {CONTENT.ocr_char_threshold} AND {is_pdf} THEN 'no_text'
    WHEN length({text}) < {CONTENT.min_chars} THEN 'too_short'
    WHEN {language} NOT IN ({b.quoted(CONTENT.allowed_languages)}) THEN 'language'
    WHEN legit IS NULL THEN 'unparsable'
    WHEN legit AND confidence >= {CONTENT.slm_confidence_threshold} THEN 'pass'
    ELSE 'doubtful' END"""


def content_reason_sql(text: str, language: str) -> str:
    return f"""CASE kind
    WHEN 'no_text' THEN '{fv.MSG_NO_TEXT}'
    WHEN 'too_short' THEN 'Text too short: ' || length({text}) || ' chars (min {CONTENT.min_chars})'
    WHEN 'language' THEN '{fv.MSG_LANGUAGE}' || {language}
    WHEN 'unparsable' THEN '{fv.MSG_UNPARSABLE}{fv.MSG_NO_JSON}' || response
    WHEN 'doubtful' THEN '{fv.MSG_MODEL}' || reasoning ||
      CASE WHEN confidence < {CONTENT.slm_confidence_threshold}
      THEN printf(' (confidence %.2f below %.2f threshold)', confidence::DOUBLE,
                  {CONTENT.slm_confidence_threshold}::DOUBLE)
      ELSE '' END
    ELSE '' END"""


# What each kind of LEGIT_RESPONSE means once parsed.
LEGIT_MEANING = f"""
  CASE doc_id % 10 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN TRUE WHEN 3 THEN FALSE
    WHEN 4 THEN TRUE WHEN 6 THEN FALSE WHEN 7 THEN TRUE END AS legit,
  CASE WHEN doc_id % 10 IN (0, 1, 2, 3, 4, 6) THEN CAST({b.CONFIDENCE} AS DOUBLE)
       WHEN doc_id % 10 = 7 THEN 1.0::DOUBLE END AS confidence,
  CASE doc_id % 10 WHEN 0 THEN 'numbered clauses' WHEN 1 THEN 'act' WHEN 2 THEN 'second'
    WHEN 3 THEN 'advert' WHEN 4 THEN 'cites ("Ordenanza", 5)' WHEN 6 THEN ''
    WHEN 7 THEN 'whole numbers' END AS reasoning"""

CONTENT_GATE = f"""
WITH parsed AS (
  SELECT doc_id, {b.DOC_JOB} AS job_id, text, lang, n_chars, {b.LEGIT_RESPONSE} AS response,
  {LEGIT_MEANING} FROM documents),
kinds AS (SELECT *, {content_case_sql("text", "lang", b.IS_PDF)} AS kind FROM parsed)
SELECT job_id, kind = 'pass' AS passed,
  CASE WHEN kind IN ('no_text', 'too_short') THEN '' ELSE lang END AS detected_language,
  CAST(length(text) AS INTEGER) AS char_count,
  kind IN ('no_text', 'language', 'unparsable', 'doubtful') AS needs_agent_review,
  kind = 'no_text' AS requires_ocr,
  {content_reason_sql("text", "lang")} AS rejection_reason,
  CASE WHEN kind IN ('pass', 'doubtful') THEN confidence ELSE 0.0 END AS confidence
FROM kinds
"""


def route_status(spark: SparkSession, folder: str) -> DataFrame:
    """Routing of every combination of step outcomes ``lineitem`` rows stand for."""
    items = b.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey"
    )
    n, p, s = F.col("l_quantity").cast("int"), F.col("l_partkey"), F.col("l_suppkey")
    reception = F.struct(
        (n != 1).alias("passed"),
        F.when(n == 1, fv.MSG_EMPTY_FILE).otherwise("").alias("rejection_reason"),
    )
    decision = (
        F.when(p % 10 == 0, "reject")
        .when(p % 10 == 1, "manual_review")
        .when(p % 10 == 2, "slm_escalate")
        .otherwise("accept")
    )
    df = items.withColumn("reception", reception).withColumn("_d", decision)
    df = df.withColumn(
        "format_validation",
        F.when(
            F.col("reception.passed"),
            F.struct(
                (F.col("_d") == "accept").alias("passed"),
                F.col("_d").alias("decision"),
                (s % 2 == 0).alias("used_slm"),
                F.when(F.col("_d") == "accept", "").otherwise("format").alias("rejection_reason"),
            ),
        ),
    )
    content_ok = s % 3 != 0
    df = df.withColumn(
        "content_validation",
        F.when(
            F.col("format_validation.passed"),
            F.struct(
                content_ok.alias("passed"),
                (~content_ok & (s % 2 == 0)).alias("needs_agent_review"),
                F.when(content_ok, "").otherwise("content").alias("rejection_reason"),
            ),
        ),
    )
    unique = n % 4 != 0
    df = df.withColumn(
        "duplicate_control",
        F.when(
            F.col("content_validation.passed"),
            F.struct(
                unique.alias("passed"),
                F.when(unique, "").otherwise(fv.MSG_EXACT_DUPLICATE).alias("rejection_reason"),
            ),
        ),
    )
    return gates.route(df).groupBy("status", "rejection_reason").agg(F.count("*").alias("n"))


ROUTE_STATUS = f"""
WITH base AS (
  SELECT CAST(l_quantity AS INTEGER) AS n, l_suppkey AS s,
    CASE l_partkey % 10 WHEN 0 THEN 'reject' WHEN 1 THEN 'manual_review'
      WHEN 2 THEN 'slm_escalate' ELSE 'accept' END AS d FROM lineitem),
routed AS (
  SELECT CASE
    WHEN n = 1 THEN 'rejected|{fv.MSG_EMPTY_FILE}'
    WHEN d = 'manual_review' OR (d = 'slm_escalate' AND s % 2 <> 0) THEN 'review|format'
    WHEN d <> 'accept' THEN 'rejected|format'
    WHEN s % 3 = 0 THEN CASE WHEN s % 2 = 0 THEN 'review|content' ELSE 'rejected|content' END
    WHEN n % 4 = 0 THEN 'rejected|{fv.MSG_EXACT_DUPLICATE}'
    ELSE 'accepted|' END AS r FROM base)
SELECT split_part(r, '|', 1) AS status, split_part(r, '|', 2) AS rejection_reason,
       count(*) AS n FROM routed GROUP BY 1, 2
"""

QUERIES = {
    "content_hash": content_hash,
    "mime_sniff": mime_sniff,
    "reception_gate": reception_gate,
    "format_gate": format_gate,
    "extraction_cascade": extraction_cascade,
    "content_gate": content_gate,
    "route_status": route_status,
}
ORACLES = {
    "content_hash": CONTENT_HASH,
    "mime_sniff": MIME_SNIFF,
    "reception_gate": RECEPTION_GATE,
    "format_gate": FORMAT_GATE,
    "extraction_cascade": EXTRACTION_CASCADE,
    "content_gate": CONTENT_GATE,
    "route_status": ROUTE_STATUS,
}
