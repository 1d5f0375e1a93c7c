"""Requests to models and what their responses mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgate import fixed_values as fv
from inkgate.catalog import bindings as b
from inkgate.catalog.gate_queries import FORMAT_CTES
from inkgate.operators import answers, cleaning, gates


def request_table(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of all three tasks; every file is named .dat here, so known types escalate."""
    files = b.all_files(spark, folder)
    renamed = files.withColumn("filename", F.concat(F.col("filename"), F.lit(".dat")))
    formats = answers.format_requests(gates.check_format(gates.receive(renamed)))
    docs = files.where(F.col("job_id").startswith("doc-"))
    content = answers.content_requests(docs)
    cleaned = cleaning.clean_text(docs)
    return formats.unionByName(content).unionByName(answers.entity_requests(cleaned))


def _prompt_sql(template: tuple[str, ...], **values: str) -> str:
    sql = "'" + "\n".join(template).replace("'", "''") + "'"
    for name, value in values.items():
        sql = f"replace({sql}, '{{{name}}}', {value})"
    return sql


def _request_oracle() -> str:
    from inkgate.catalog.text_queries import CLEAN_CTES

    expected = "CASE detected_mime " + " ".join(
        f"WHEN '{mime}' THEN '{', '.join(exts)}'" for mime, exts in fv.MIME_TO_EXTENSIONS.items()
    ) + " ELSE 'unknown' END"
    ctes = FORMAT_CTES.replace(
        "suffixed AS (SELECT *,", "suffixed AS (SELECT * REPLACE (filename || '.dat' AS filename),"
    ).replace("regexp_extract(filename,", "regexp_extract(filename || '.dat',")
    return f"""
WITH {ctes},
{CLEAN_CTES}
SELECT job_id, 'format' AS task,
  {_prompt_sql(answers.FORMAT_PROMPT, filename="filename", mime="detected_mime", expected=expected)}
  AS prompt FROM formatted WHERE decision = 'slm_escalate'
UNION ALL
SELECT {b.DOC_JOB}, 'content',
  {_prompt_sql(answers.CONTENT_PROMPT, language="lang", text=f"substring(text, 1, {fv.EXCERPT_LEN})")}
  FROM documents
UNION ALL
SELECT {b.DOC_JOB}, 'entities',
  {_prompt_sql(answers.ENTITY_PROMPT, text=f"substring(cleaned_text, 1, {fv.ENTITY_EXCERPT_LEN})")}
  FROM cleaned
"""


def parse_responses(spark: SparkSession, folder: str) -> DataFrame:
    docs = b.documents(spark, folder).select(
        "doc_id", F.expr(b.LEGIT_RESPONSE).alias("response")
    )
    parsed = answers.parse_legitimacy(docs, "response")
    return parsed.select(
        "doc_id",
        F.col("legitimacy").isNotNull().alias("parsed"),
        "legitimacy.is_legitimate",
        "legitimacy.confidence",
        "legitimacy.reasoning",
    )


def _field(name: str, camel: str, span: str = "span") -> str:
    return f"coalesce(json_extract({span}, '$.{camel}'), json_extract({span}, '$.{name}'))"


_NUMBERS = "('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT')"
_TRUE = b.quoted(fv.TRUE_WORDS)
_FALSE = b.quoted(fv.FALSE_WORDS)
PARSE_RESPONSES = rf"""
WITH responses AS (SELECT doc_id, {b.LEGIT_RESPONSE} AS response FROM documents),
spans AS (
  SELECT doc_id, unnest(regexp_extract_all(response, '\{{[^{{}}]+\}}')) AS span,
         generate_subscripts(regexp_extract_all(response, '\{{[^{{}}]+\}}'), 1) AS i FROM responses),
fields AS (
  SELECT doc_id, i, {_field("is_legitimate", "isLegitimate")} AS l,
         json_extract(span, '$.confidence') AS c, json_extract(span, '$.reasoning') AS r
  FROM (SELECT * FROM spans WHERE json_valid(span))),
valid AS (
  SELECT *, l ->> '$' AS lt, c ->> '$' AS ct FROM fields
  WHERE (r IS NULL OR json_type(r) = 'VARCHAR')
    AND (c IS NULL OR json_type(c) IN {_NUMBERS} OR json_type(c) = 'BOOLEAN'
         OR (json_type(c) = 'VARCHAR' AND TRY_CAST(c ->> '$' AS DOUBLE) IS NOT NULL))
    AND (l IS NULL OR json_type(l) = 'BOOLEAN'
         OR (json_type(l) IN {_NUMBERS} AND TRY_CAST(l ->> '$' AS DOUBLE) IN (0, 1))
         OR (json_type(l) = 'VARCHAR' AND lower(l ->> '$') IN ({_TRUE}, {_FALSE})))),
firsts AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1),
loose AS (
  SELECT doc_id,
    lower(regexp_extract(response, '(?i)"is_legitimate"\s*:\s*(true|false)', 1)) AS l,
    regexp_extract(response, '"confidence"\s*:\s*([0-9]*\.?[0-9]+)', 1) AS c,
    regexp_extract(response, '(?s)"reasoning"\s*:\s*"(.*)"\s*,\s*"confidence"', 1) AS r
  FROM responses)
SELECT o.doc_id, f.doc_id IS NOT NULL OR (o.l <> '' AND o.c <> '') AS parsed,
  CASE WHEN f.doc_id IS NOT NULL
       THEN coalesce(lower(lt) IN ({_TRUE}) OR TRY_CAST(lt AS DOUBLE) = 1, FALSE)
       WHEN o.l <> '' AND o.c <> '' THEN o.l = 'true' END AS is_legitimate,
  CASE WHEN f.doc_id IS NOT NULL THEN coalesce(TRY_CAST(ct AS DOUBLE), {fv.DEFAULT_CONFIDENCE})
       WHEN o.l <> '' AND o.c <> '' THEN CAST(o.c AS DOUBLE) END AS confidence,
  CASE WHEN f.doc_id IS NOT NULL THEN coalesce(f.r ->> '$', '')
       WHEN o.l <> '' AND o.c <> '' THEN o.r END AS reasoning
FROM loose o LEFT JOIN firsts f ON o.doc_id = f.doc_id
"""


def _flat(entities: Column) -> list[Column]:
    return [
        entities["doc_type_hint"].alias("doc_type_hint"),
        entities["number"].alias("number"),
        entities["year"].alias("year"),
        entities["issuing_body"].alias("issuing_body"),
        F.array_join(entities["signatories"], "|").alias("signatories"),
        entities["article_count"].alias("article_count"),
    ]


def parse_entities(spark: SparkSession, folder: str) -> DataFrame:
    parsed = answers.parse_entities(b.entity_attempts(spark, folder), "response")
    return parsed.select(
        "doc_id",
        "attempt",
        F.col("entities").isNotNull().alias("parsed"),
        *_flat(F.col("entities")),
    )


def _int_ok(value: str) -> str:
    return f"""({value} IS NULL OR json_type({value}) IN ('NULL', 'BOOLEAN')
    OR (json_type({value}) IN {_NUMBERS}
        AND TRY_CAST({value} ->> '$' AS DOUBLE) = floor(TRY_CAST({value} ->> '$' AS DOUBLE)))
    OR (json_type({value}) = 'VARCHAR'
        AND regexp_matches({value} ->> '$', '^\\s*[+-]?\\d+(\\.0*)?\\s*$')))"""


def _text_ok(value: str) -> str:
    return f"({value} IS NULL OR json_type({value}) IN ('NULL', 'VARCHAR'))"


ENTITY_CTES = rf"""{b.ENTITY_ATTEMPTS_SQL},
spans AS (
  SELECT doc_id, attempt, unnest(regexp_extract_all(response, '\{{[^{{}}]*\}}')) AS span,
         generate_subscripts(regexp_extract_all(response, '\{{[^{{}}]*\}}'), 1) AS i FROM attempts),
fields AS (
  SELECT doc_id, attempt, i,
    {_field("doc_type_hint", "docTypeHint")} AS d, json_extract(span, '$.number') AS n,
    json_extract(span, '$.year') AS y, {_field("issuing_body", "issuingBody")} AS b,
    json_extract(span, '$.signatories') AS s, {_field("article_count", "articleCount")} AS c
  FROM (SELECT * FROM spans WHERE json_valid(span))),
valid AS (
  SELECT * FROM fields
  WHERE {_text_ok("d")} AND {_text_ok("n")} AND {_text_ok("b")}
    AND {_int_ok("y")} AND {_int_ok("c")}
    AND (s IS NULL OR (json_type(s) = 'ARRAY' AND len(list_filter(
      CAST(s AS JSON[]), lambda e: json_type(e) <> 'VARCHAR')) = 0))),
parsed_entities AS (
  SELECT a.doc_id, a.job_id, a.attempt, a.response, v.doc_id IS NOT NULL AS parsed,
    v.d ->> '$' AS doc_type_hint, v.n ->> '$' AS number,
    CAST(TRY_CAST(v.y ->> '$' AS DOUBLE) AS INTEGER) AS year, v.b ->> '$' AS issuing_body,
    CASE WHEN v.doc_id IS NOT NULL THEN coalesce(array_to_string(CAST(v.s AS VARCHAR[]), '|'), '')
      END AS signatories,
    CAST(TRY_CAST(v.c ->> '$' AS DOUBLE) AS INTEGER) AS article_count
  FROM attempts a LEFT JOIN (
    SELECT * FROM valid
    QUALIFY row_number() OVER (PARTITION BY doc_id, attempt ORDER BY i) = 1) v
  ON v.doc_id = a.doc_id AND v.attempt = a.attempt)"""

PARSE_ENTITIES = f"""
WITH {ENTITY_CTES}
SELECT doc_id, attempt, parsed, doc_type_hint, number, year, issuing_body, signatories,
       article_count FROM parsed_entities
"""


def enrichment_retry(spark: SparkSession, folder: str) -> DataFrame:
    outcome = answers.first_success(b.entity_attempts(spark, folder))
    return outcome.select(
        "job_id",
        "attempts_made",
        F.col("entities").isNotNull().alias("succeeded"),
        *_flat(F.col("entities")),
        "last_error",
    )


RETRY_CTES = f"""{ENTITY_CTES},
tried AS (SELECT * FROM parsed_entities WHERE attempt <= {fv.MAX_ENRICHMENT_RETRIES}),
summed AS (
  SELECT job_id, min(attempt) FILTER (WHERE parsed) AS first_ok, count(*) AS n,
         arg_max(response, attempt) AS last_response FROM tried GROUP BY 1),
retried AS (
  SELECT s.job_id, CAST(coalesce(first_ok + 1, n) AS INTEGER) AS attempts_made,
    first_ok IS NOT NULL AS succeeded, t.doc_type_hint, t.number, t.year, t.issuing_body,
    t.signatories, t.article_count,
    CASE WHEN first_ok IS NULL THEN '{fv.MSG_NO_JSON}' || last_response END AS last_error
  FROM summed s LEFT JOIN tried t ON t.job_id = s.job_id AND t.attempt = s.first_ok)"""

ENRICHMENT_RETRY = f"WITH {RETRY_CTES} SELECT * FROM retried"

QUERIES = {
    "request_table": request_table,
    "parse_responses": parse_responses,
    "parse_entities": parse_entities,
    "enrichment_retry": enrichment_retry,
}
ORACLES = {
    "request_table": _request_oracle(),
    "parse_responses": PARSE_RESPONSES,
    "parse_entities": PARSE_ENTITIES,
    "enrichment_retry": ENRICHMENT_RETRY,
}
