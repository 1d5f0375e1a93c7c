"""Entities and legitimacy signals a text shows by itself, as plain expressions.

They stand in where no model answers: what a rule can read is filled in, the issuing body and
the signatories stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgate import fixed_values as fv
from inkgate.functions import text as tx

_TYPE_PATTERN = r"(ordenanza|decreto|resoluci[oó]n)"
_NUMBER_PATTERN = r"n[°º]\s*([0-9][0-9./-]*)"
_YEAR_PATTERN = r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"
_ARTICLE_PATTERN = r"art[ií]culo\s+[0-9]+"


def signal_counts(
    df: DataFrame, *, text: str = "text", markers: tuple[str, ...] = fv.ACT_MARKERS
) -> DataFrame:
    """Add ``signals`` (occurrences of each marker) and ``n_signals`` (their sum)."""
    counts = [F.regexp_count(F.col(text), F.lit(marker)) for marker in markers]
    df = df.withColumn("signals", F.array(*counts))
    return df.withColumn(
        "n_signals", F.aggregate("signals", F.lit(0), lambda total, n: total + n)
    )


def rule_entities(text: Column) -> Column:
    """The entity struct from patterns in the whole text."""
    lowered = F.lower(text)
    kind = F.replace(F.regexp_extract(lowered, _TYPE_PATTERN, 1), F.lit("ó"), F.lit("o"))
    return F.struct(
        tx.empty_to_null(kind).alias("doc_type_hint"),
        tx.empty_to_null(F.regexp_extract(lowered, _NUMBER_PATTERN, 1)).alias("number"),
        F.regexp_extract(lowered, _YEAR_PATTERN, 1).try_cast("int").alias("year"),
        F.lit(None).cast("string").alias("issuing_body"),
        F.array().cast("array<string>").alias("signatories"),
        F.regexp_count(lowered, F.lit(_ARTICLE_PATTERN)).alias("article_count"),
    )


def with_metadata(
    df: DataFrame, *, filename: str, language: str, sha256: str, extractor: str
) -> DataFrame:
    """Add the ``metadata`` struct from columns known since the gates."""
    return df.withColumn(
        "metadata",
        F.struct(
            F.lit(fv.METADATA_SOURCE).alias("source"),
            F.col(filename).alias("filename"),
            F.col(language).alias("language"),
            F.col(sha256).alias("sha256"),
            F.col(extractor).alias("stage2_extractor_used"),
        ),
    )
