"""The checks a document passes in order. Each adds one struct column; NULL = not reached.

All gates are projections: rules become predicates in the plan, so a whole corpus is judged
in the scan stage without a shuffle. Model answers come in as columns (see ``responses``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgate import fixed_values as fv
from inkgate.config import ContentRules, FormatRules
from inkgate.functions import text as tx
from inkgate.functions.mime import detect_mime


def _listed(table: dict[str, tuple[str, ...]], key: Column) -> Column:
    """The list a rule table has for a key, empty when it has none."""
    nothing = F.array().cast("array<string>")
    if not table:
        return nothing
    entries = []
    for name, values in table.items():
        entries += [F.lit(name), F.array(*[F.lit(value) for value in values])]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), nothing)


def receive(
    df: DataFrame,
    rules: FormatRules | None = None,
    *,
    content: str = "content",
    length: str = "length",
    mime: Callable[[Column], Column] = detect_mime,
) -> DataFrame:
    """Add ``reception``: presence and size checks, then hash and type of what passed.

    Where there is a ``length`` column, as ``read_files`` gives it, size is judged by it and a body
    above the limit need not be there at all. ``mime`` tells the type of a body: an expression, or
    a pandas UDF applied to the column.
    """
    rules = rules or FormatRules()
    body = F.col(content)
    size = F.octet_length(body).cast("bigint")
    if length in df.columns:
        size = F.coalesce(F.col(length).cast("bigint"), size)
    limit = rules.max_file_size_bytes
    reason = (
        F.when(body.isNull() & F.coalesce(size <= limit, F.lit(True)), fv.MSG_NO_FILE)
        .when(size == 0, fv.MSG_EMPTY_FILE)
        .when(size > limit, fv.MSG_TOO_LARGE.format(limit_mb=limit // (1024 * 1024)))
        .otherwise("")
    )
    df = df.withColumn("_reason", reason)
    passed = F.col("_reason") == ""
    return df.withColumn(
        "reception",
        F.struct(
            passed.alias("passed"),
            F.when(passed, F.sha2(body, 256)).otherwise("").alias("sha256"),
            F.when(passed, mime(body)).otherwise("").alias("detected_mime"),
            F.coalesce(size, F.lit(0).cast("bigint")).alias("file_size_bytes"),
            F.col("_reason").alias("rejection_reason"),
        ),
    ).drop("_reason")


def format_rule(filename: Column, mime: Column, rules: FormatRules) -> Column:
    """accept / reject / manual_review / slm_escalate from type and extension alone."""
    suffix = tx.file_suffix(filename)
    expected = _listed(rules.mime_to_extensions, mime)
    known_mismatch = F.array_contains(_listed(rules.known_mismatches, mime), suffix)
    wrong_suffix = (F.size(expected) > 0) & ~F.array_contains(expected, suffix)
    disabled = mime.isin(*rules.disabled_mime_types) | suffix.isin(*rules.disabled_extensions)
    return (
        F.when(disabled, "reject")
        .when(
            ~mime.isin(*rules.allowed_mime_types),
            F.when(known_mismatch, "accept").otherwise("manual_review"),
        )
        .when(wrong_suffix, "slm_escalate")
        .otherwise("accept")
    )


def expected_extensions(mime: Column, rules: FormatRules) -> Column:
    """Usual extensions of a type as a comma list, ``unknown`` when there are none."""
    listed = F.array_join(_listed(rules.mime_to_extensions, mime), ", ")
    return F.coalesce(F.nullif(listed, F.lit("")), F.lit("unknown"))


def check_format(
    df: DataFrame, rules: FormatRules | None = None, *, answer: str | None = None
) -> DataFrame:
    """Add ``format_validation`` for documents that passed reception.

    ``answer`` names a struct column (decision, reasoning) holding the parsed model answer
    for escalated documents. An escalated document without a usable answer keeps the
    decision ``slm_escalate`` and is routed to review.
    """
    rules = rules or FormatRules()
    mime = F.col("reception.detected_mime")
    df = df.withColumn("_rule", format_rule(F.col("filename"), mime, rules))
    escalated = F.col("_rule") == "slm_escalate"
    if answer is None:
        answered = F.lit(False)
        decision, reasoning = F.col("_rule"), F.lit("")
    else:
        answered = escalated & F.col(answer).isNotNull()
        decision = F.when(answered, F.col(f"{answer}.decision")).otherwise(F.col("_rule"))
        reasoning = F.col(f"{answer}.reasoning")
    df = df.withColumn("_decision", decision)
    passed = F.col("_decision") == "accept"
    reason = (
        F.when(passed, "")
        .when(answered, F.concat(F.lit(fv.MSG_MODEL), reasoning))
        .when(F.col("_decision") == "reject", F.concat(F.lit(fv.MSG_FORMAT_REJECTED), mime))
        .when(escalated, "")
        .otherwise(F.concat(F.lit(fv.MSG_UNKNOWN_MIME), mime))
    )
    return df.withColumn(
        "format_validation",
        F.when(
            F.col("reception.passed"),
            F.struct(
                passed.alias("passed"),
                F.col("_decision").alias("decision"),
                answered.alias("used_slm"),
                reason.alias("rejection_reason"),
            ),
        ),
    ).drop("_rule", "_decision")


def check_content(
    df: DataFrame,
    rules: ContentRules | None = None,
    *,
    language: str = "language",
    answer: str = "legitimacy",
    response: str | None = None,
    chars: str | None = None,
) -> DataFrame:
    """Add ``content_validation`` for documents whose text was extracted.

    Expects ``extraction`` and ``reception``; ``answer`` is the parsed verdict struct
    (is_legitimate, confidence, reasoning), NULL when there was none or it was unusable.
    ``response`` names the raw answer, shown in the reason of unusable ones; ``chars`` a
    column with the text's length where the text itself is kept elsewhere.
    """
    rules = rules or ContentRules()
    length = F.col(chars) if chars else tx.char_count(F.col("extraction.text"))
    chars = length
    spoken = F.coalesce(F.col(language), F.lit("unknown"))
    verdict = F.col(answer)
    low = F.col(f"{answer}.confidence") < F.lit(rules.slm_confidence_threshold)
    outcome = (
        F.when(
            (chars < rules.ocr_char_threshold)
            & (F.col("reception.detected_mime") == fv.PDF_MIME),
            "no_text",
        )
        .when(chars < rules.min_chars, "too_short")
        .when(~spoken.isin(*rules.allowed_languages), "language")
        .when(verdict.isNull(), "unparsable")
        .when(F.col(f"{answer}.is_legitimate") & ~low, "pass")
        .otherwise("doubtful")
    )
    df = df.withColumn("_outcome", outcome)
    kind = F.col("_outcome")
    raw = F.coalesce(F.col(response), F.lit("")) if response else F.lit("")
    doubt = F.concat(F.lit(fv.MSG_MODEL), F.col(f"{answer}.reasoning"))
    doubt_low = F.concat(
        doubt,
        F.format_string(
            fv.MSG_LOW_CONFIDENCE,
            F.col(f"{answer}.confidence"),
            F.lit(float(rules.slm_confidence_threshold)),
        ),
    )
    short_head, short_tail = fv.MSG_TOO_SHORT.format(
        chars="\x00", min_chars=rules.min_chars
    ).split("\x00")
    reason = (
        F.when(kind == "no_text", fv.MSG_NO_TEXT)
        .when(
            kind == "too_short",
            F.concat(F.lit(short_head), chars.cast("string"), F.lit(short_tail)),
        )
        .when(kind == "language", F.concat(F.lit(fv.MSG_LANGUAGE), spoken))
        .when(kind == "unparsable", F.concat(F.lit(fv.MSG_UNPARSABLE + fv.MSG_NO_JSON), raw))
        .when(kind == "doubtful", F.when(low, doubt_low).otherwise(doubt))
        .otherwise("")
    )
    language_known = kind.isin("language", "unparsable", "pass", "doubtful")
    return df.withColumn(
        "content_validation",
        F.when(
            F.col("extraction").isNotNull(),
            F.struct(
                (kind == "pass").alias("passed"),
                F.when(language_known, spoken).otherwise("").alias("detected_language"),
                chars.alias("char_count"),
                kind.isin("no_text", "language", "unparsable", "doubtful").alias(
                    "needs_agent_review"
                ),
                (kind == "no_text").alias("requires_ocr"),
                reason.alias("rejection_reason"),
                F.when(kind.isin("pass", "doubtful"), F.col(f"{answer}.confidence"))
                .otherwise(F.lit(0.0))
                .alias("confidence"),
            ),
        ),
    ).drop("_outcome")


def route(df: DataFrame) -> DataFrame:
    """Add ``status`` and ``rejection_reason`` from whichever steps were reached."""
    formats, content = F.col("format_validation"), F.col("content_validation")
    duplicate = F.col("duplicate_control")

    def ok(step: Column) -> Column:
        return F.coalesce(step["passed"], F.lit(False))

    # an escalation nobody answered waits for a person, as manual_review does
    unresolved = (formats["decision"] == "slm_escalate") & ~formats["used_slm"]
    status = (
        F.when(~ok(F.col("reception")), "rejected")
        .when(
            ~ok(formats),
            F.when(
                F.coalesce((formats["decision"] == "manual_review") | unresolved, F.lit(False)),
                "review",
            ).otherwise("rejected"),
        )
        .when(
            ~ok(content),
            F.when(F.coalesce(content["needs_agent_review"], F.lit(False)), "review").otherwise(
                "rejected"
            ),
        )
        .when(~ok(duplicate), "rejected")
        .otherwise("accepted")
    )
    reason = F.coalesce(
        *[
            tx.empty_to_null(F.col(f"{step}.rejection_reason"))
            for step in (
                "duplicate_control",
                "content_validation",
                "format_validation",
                "reception",
            )
        ],
        F.lit(""),
    )
    df = df.withColumn("status", status)
    return df.withColumn(
        "rejection_reason", F.when(F.col("status") == "accepted", "").otherwise(reason)
    )
