"""Model calls as tables: requests go out, responses come back and are joined by job and task.

The engine that answers is not part of this package; any batch scorer may read the request
table and write (job_id, task, attempt, response) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgate import fixed_values as fv
from inkgate.config import ContentRules, EnrichmentRules, FormatRules
from inkgate.functions import responses as rs
from inkgate.functions import text as tx
from inkgate.operators.gates import expected_extensions

FORMAT_TASK = "format"
CONTENT_TASK = "content"
ENTITY_TASK = "entities"

FORMAT_PROMPT = (
    "The file {filename} was detected as {mime}, which usually has the extension(s) {expected}.",
    "Is the odd extension an honest naming slip (accept), a disguise (reject) or unclear"
    " (manual_review)?",
    'Answer only with JSON: {"decision": ..., "confidence": ..., "reasoning": ...}',
)
CONTENT_PROMPT = (
    "Is the following text (language: {language}) part of an official act, or unrelated?",
    "{text}",
    'Answer only with JSON: {"is_legitimate": ..., "confidence": ..., "reasoning": ...}',
)
ENTITY_PROMPT = (
    "List what this official act states itself; use null for what it does not state.",
    "{text}",
    'Answer only with JSON: {"doc_type_hint": ..., "number": ..., "year": ...,'
    ' "issuing_body": ..., "signatories": [...], "article_count": ...}',
)


def render(template: tuple[str, ...], values: dict[str, Column]) -> Column:
    """Fill the named places of a template with columns."""
    pieces: list[Column] = []
    rest = "\n".join(template)
    while True:
        places = [(rest.find("{" + name + "}"), name) for name in values]
        places = [(at, name) for at, name in places if at >= 0]
        if not places:
            break
        at, name = min(places)
        pieces += [F.lit(rest[:at]), values[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces, F.lit(rest))


def format_requests(df: DataFrame, rules: FormatRules | None = None) -> DataFrame:
    """(job_id, task, prompt) for documents whose extension does not fit their type."""
    rules = rules or FormatRules()
    mime = F.col("reception.detected_mime")
    open_cases = df.where(
        (F.col("format_validation.decision") == "slm_escalate")
        & ~F.col("format_validation.used_slm")
    )
    prompt = render(
        FORMAT_PROMPT,
        {
            "filename": F.col("filename"),
            "mime": mime,
            "expected": expected_extensions(mime, rules),
        },
    )
    return open_cases.select("job_id", F.lit(FORMAT_TASK).alias("task"), prompt.alias("prompt"))


def content_requests(
    df: DataFrame, rules: ContentRules | None = None, *, text: str = "text"
) -> DataFrame:
    """(job_id, task, prompt) asking whether the opening of each text is legitimate."""
    rules = rules or ContentRules()
    prompt = render(
        CONTENT_PROMPT,
        {"text": tx.excerpt(F.col(text), rules.excerpt_len), "language": F.col("language")},
    )
    return df.select("job_id", F.lit(CONTENT_TASK).alias("task"), prompt.alias("prompt"))


def entity_requests(
    df: DataFrame, rules: EnrichmentRules | None = None, *, text: str = "cleaned_text"
) -> DataFrame:
    """(job_id, task, prompt) asking for the entities of each cleaned text."""
    rules = rules or EnrichmentRules()
    prompt = render(
        ENTITY_PROMPT, {"text": tx.excerpt(F.col(text), rules.entity_excerpt_len)}
    )
    return df.select("job_id", F.lit(ENTITY_TASK).alias("task"), prompt.alias("prompt"))


def with_response(df: DataFrame, responses: DataFrame, task: str, output: str) -> DataFrame:
    """Left-join the response of one task: of several for a job, that of the last attempt.

    Without attempts, or among equal ones, the greatest text counts: a job never multiplies.
    """
    order = ["attempt", "response"] if "attempt" in responses.columns else ["response"]
    wanted = (
        responses.where(F.col("task") == task)
        .groupBy("job_id")
        .agg(F.max(F.struct(*order))["response"].alias(output))
    )
    return df.join(wanted, "job_id", "left")


def parse_legitimacy(df: DataFrame, response: str, output: str = "legitimacy") -> DataFrame:
    """Add the verdict struct; the parsed object is a column so that it is built once."""
    df = df.withColumn("_object", rs.legitimacy_object(F.col(response)))
    return df.withColumn(output, rs.legitimacy_from(F.col("_object"), F.col(response))).drop(
        "_object"
    )


def parse_entities(df: DataFrame, response: str, output: str = "entities") -> DataFrame:
    df = df.withColumn("_object", rs.entity_object(F.col(response)))
    return df.withColumn(output, rs.entities_from(F.col("_object"))).drop("_object")


def parse_format(df: DataFrame, response: str, output: str = "format_answer") -> DataFrame:
    df = df.withColumn("_object", rs.format_object(F.col(response)))
    return df.withColumn(output, rs.format_decision_from(F.col("_object"))).drop("_object")


def first_success(
    attempts: DataFrame, rules: EnrichmentRules | None = None, *, response: str = "response"
) -> DataFrame:
    """(job_id, entities, attempts_made, last_error) from (job_id, attempt, response) rows.

    Attempts count from 0 and stop after the allowed retries. ``entities`` is NULL when all
    of them failed; ``last_error`` then tells why. An ``error`` column, when present, marks
    attempts that produced no response at all.
    """
    rules = rules or EnrichmentRules()
    tried = parse_entities(
        attempts.where(F.col("attempt") <= rules.max_enrichment_retries), response
    )
    parse_error = F.concat(F.lit(fv.MSG_NO_JSON), F.coalesce(F.col(response), F.lit("")))
    error = parse_error
    if "error" in attempts.columns:
        error = F.coalesce(F.col("error"), parse_error)
        tried = tried.withColumn(
            "entities", F.when(F.col("error").isNull(), F.col("entities"))
        )
    worked = F.col("entities").isNotNull()
    tried = tried.withColumn("_error", F.when(~worked, error))
    first = F.min(F.when(worked, F.col("attempt")))
    return tried.groupBy("job_id").agg(
        F.min_by("entities", F.when(worked, F.col("attempt"))).alias("entities"),
        F.coalesce(first + 1, F.count("*")).cast("int").alias("attempts_made"),
        F.when(first.isNull(), F.max_by("_error", "attempt")).alias("last_error"),
    )
