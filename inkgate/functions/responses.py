"""Typed values out of free-form model responses, on the JVM with VARIANT.

A response is searched for flat JSON objects; the first one whose fields all have acceptable
types wins. Field rules are those of a lenient validator: numbers may arrive as numeric
strings, booleans as common words, integers as integral decimals, but text must be text.
Keys may be written in camelCase or snake_case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkgate import fixed_values as fv
from inkgate.functions.naming import camel

_NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"
_INTEGRAL_TEXT = r"^\s*[+-]?\d+(\.0*)?\s*\z"


def field(obj: Column, name: str) -> Column:
    """The raw field under its camelCase or snake_case key; SQL NULL when absent."""
    first = F.variant_get(obj, f"$.{camel(name)}", "variant")
    if camel(name) == name:
        return first
    return F.coalesce(first, F.variant_get(obj, f"$.{name}", "variant"))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _double(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def _is_null(value: Column) -> Column:
    return value.isNull() | (_kind(value) == "VOID")


def valid_text(value: Column) -> Column:
    return value.isNull() | (_kind(value) == "STRING")


def valid_optional_text(value: Column) -> Column:
    return _is_null(value) | (_kind(value) == "STRING")


def valid_double(value: Column) -> Column:
    kind = _kind(value)
    return (
        value.isNull()
        | _is_number(kind)
        | (kind == "BOOLEAN")
        | ((kind == "STRING") & _text(value).rlike(_NUMERIC_TEXT))
    )


def as_double(value: Column) -> Column:
    kind = _kind(value)
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
        .when(kind == "STRING", F.trim(_text(value)).try_cast("double"))
        .otherwise(_double(value))
    )


def valid_boolean(value: Column) -> Column:
    kind = _kind(value)
    return (
        value.isNull()
        | (kind == "BOOLEAN")
        | (_is_number(kind) & _double(value).isin(0.0, 1.0))
        | ((kind == "STRING") & F.lower(_text(value)).isin(*fv.TRUE_WORDS, *fv.FALSE_WORDS))
    )


def as_boolean(value: Column) -> Column:
    kind = _kind(value)
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", F.lower(_text(value)).isin(*fv.TRUE_WORDS))
        .when(kind.isNotNull(), _double(value) == 1.0)
    )


def valid_optional_int(value: Column) -> Column:
    kind = _kind(value)
    integral = _is_number(kind) & (_double(value) == F.floor(_double(value)))
    return (
        _is_null(value)
        | integral
        | (kind == "BOOLEAN")
        | ((kind == "STRING") & _text(value).rlike(_INTEGRAL_TEXT))
    )


def as_int(value: Column) -> Column:
    kind = _kind(value)
    digits = F.regexp_extract(_text(value), r"[+-]?\d+", 0)
    return (
        F.when(kind == "STRING", digits.try_cast("int"))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int"))
        .when(kind != "VOID", _double(value).try_cast("int"))
    )


def valid_text_list(value: Column) -> Column:
    kind = _kind(value)
    empty = (kind == "ARRAY<VOID>") & (
        F.size(F.try_variant_get(value, "$", "array<variant>")) == 0
    )
    return value.isNull() | (kind == "ARRAY<STRING>") | empty


def as_text_list(value: Column) -> Column:
    return F.coalesce(
        F.try_variant_get(value, "$", "array<string>"), F.array().cast("array<string>")
    )


def first_valid_object(
    response: Column, pattern: str, is_valid: Callable[[Column], Column]
) -> Column:
    """First flat JSON object in the response that parses and passes ``is_valid``."""
    spans = F.regexp_extract_all(response, F.lit(pattern), F.lit(0))
    objects = F.transform(spans, lambda span: F.try_parse_json(span))
    return F.get(F.filter(objects, lambda v: v.isNotNull() & is_valid(v)), F.lit(0))


def legitimacy_object(response: Column) -> Column:
    return first_valid_object(
        response,
        fv.LEGITIMACY_OBJECT_PATTERN,
        lambda v: valid_text(field(v, "reasoning"))
        & valid_double(field(v, "confidence"))
        & valid_boolean(field(v, "is_legitimate")),
    )


def legitimacy_from(obj: Column, response: Column) -> Column:
    """Struct of the verdict; NULL when the response holds nothing usable.

    Broken JSON is read field by field when both the verdict and the confidence are there.
    """
    from_object = F.struct(
        F.coalesce(as_boolean(field(obj, "is_legitimate")), F.lit(False)).alias("is_legitimate"),
        F.coalesce(as_double(field(obj, "confidence")), F.lit(fv.DEFAULT_CONFIDENCE)).alias(
            "confidence"
        ),
        F.coalesce(_text(field(obj, "reasoning")), F.lit("")).alias("reasoning"),
    )
    verdict = F.regexp_extract(response, fv.IS_LEGITIMATE_PATTERN, 1)
    confidence = F.regexp_extract(response, fv.CONFIDENCE_PATTERN, 1)
    from_fields = F.struct(
        (F.lower(verdict) == "true").alias("is_legitimate"),
        confidence.try_cast("double").alias("confidence"),
        F.regexp_extract(response, fv.REASONING_PATTERN, 1).alias("reasoning"),
    )
    return F.when(obj.isNotNull(), from_object).when(
        (verdict != "") & (confidence != ""), from_fields
    )


def entity_object(response: Column) -> Column:
    return first_valid_object(
        response,
        fv.ENTITY_OBJECT_PATTERN,
        lambda v: valid_optional_text(field(v, "doc_type_hint"))
        & valid_optional_text(field(v, "number"))
        & valid_optional_int(field(v, "year"))
        & valid_optional_text(field(v, "issuing_body"))
        & valid_text_list(field(v, "signatories"))
        & valid_optional_int(field(v, "article_count")),
    )


def entities_from(obj: Column) -> Column:
    """Struct of the entities; NULL when no object in the response was usable."""
    return F.when(
        obj.isNotNull(),
        F.struct(
            _text(field(obj, "doc_type_hint")).alias("doc_type_hint"),
            _text(field(obj, "number")).alias("number"),
            as_int(field(obj, "year")).alias("year"),
            _text(field(obj, "issuing_body")).alias("issuing_body"),
            as_text_list(field(obj, "signatories")).alias("signatories"),
            as_int(field(obj, "article_count")).alias("article_count"),
        ),
    )


def format_object(response: Column) -> Column:
    return first_valid_object(
        response,
        fv.LEGITIMACY_OBJECT_PATTERN,
        lambda v: (_kind(field(v, "decision")) == "STRING")
        & _text(field(v, "decision")).isin(*fv.FORMAT_DECISIONS)
        & (_is_null(field(v, "confidence")) | valid_double(field(v, "confidence")))
        & valid_text(field(v, "reasoning")),
    )


def format_decision_from(obj: Column) -> Column:
    return F.when(
        obj.isNotNull(),
        F.struct(
            _text(field(obj, "decision")).alias("decision"),
            F.coalesce(_text(field(obj, "reasoning")), F.lit("")).alias("reasoning"),
        ),
    )
