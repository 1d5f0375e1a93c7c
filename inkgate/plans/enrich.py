"""Cleaning, entities and metadata of accepted documents, with retries and a way to review."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgate import fixed_values as fv
from inkgate.config import EnrichmentRules
from inkgate.operators import answers
from inkgate.operators.cleaning import clean_text
from inkgate.operators.entities import with_metadata
from inkgate.plans.ingest import IngestRun


@dataclass(frozen=True)
class EnrichRun:
    """``everything``: one row per accepted document with ``created_at``, ``entities`` NULL where all
    attempts failed."""

    everything: DataFrame

    @property
    def records(self) -> DataFrame:
        """The rows to store."""
        done = self.everything.where(F.col("entities").isNotNull())
        return done.select("job_id", "cleaned_text", "entities", "metadata", "created_at")

    @property
    def patches(self) -> DataFrame:
        """What sends the rest to review."""

        def change(value: Column) -> Column:
            return F.struct(value.cast("string").alias("v"))

        reason = F.concat(
            F.lit(fv.MSG_ENRICHMENT_FAILED), F.coalesce("last_error", F.lit("no response"))
        )
        return self.everything.where(F.col("entities").isNull()).select(
            "job_id",
            F.lit("review").alias("status"),
            change(reason).alias("rejection_reason"),
            change(F.lit(fv.NODE_ENRICHMENT)).alias("failed_at_node"),
            change(F.lit(fv.REVIEW_ENRICHMENT_FAILED)).alias("review_action_needed"),
            F.lit(None).cast("struct<v:string>").alias("extracted_text"),
        )


def accepted_documents(run: IngestRun) -> DataFrame:
    """What enrichment needs of the accepted rows of an ingest run."""
    return run.with_texts(run.results.where(F.col("status") == "accepted")).select(
        "job_id",
        "filename",
        F.col("extraction.text").alias("text"),
        F.col("content_validation.detected_language").alias("language"),
        F.col("reception.sha256").alias("sha256"),
        F.col("extraction.extractor_used").alias("extractor_used"),
    )


def enrich(
    accepted: DataFrame,
    attempts: DataFrame,
    rules: EnrichmentRules | None = None,
    *,
    now: Column | None = None,
) -> EnrichRun:
    """accepted(job_id, filename, text, language, sha256, extractor_used) with the
    attempts(job_id, attempt, response) of the entity model."""
    rules = rules or EnrichmentRules()
    stamp = F.current_timestamp() if now is None else now
    cleaned = clean_text(accepted, rules)
    outcome = answers.first_success(attempts, rules)
    everything = with_metadata(
        cleaned.join(outcome, "job_id", "left"),
        filename="filename",
        language="language",
        sha256="sha256",
        extractor="extractor_used",
    )
    return EnrichRun(everything.withColumn("created_at", stamp))
