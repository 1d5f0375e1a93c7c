"""Tracking tables of a finished run, ready for the append sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgate.operators import tracking
from inkgate.plans.enrich import EnrichRun
from inkgate.plans.ingest import IngestRun


def finalize_jobs(run: IngestRun, enrichment_patches: DataFrame | None = None) -> DataFrame:
    """Final job state: the run's own patch, then a failed enrichment's.

    Texts are joined to the jobs that keep one, those not accepted.
    """
    accepted = F.col("status") == "accepted"
    nothing = F.col("extraction").withField("text", F.lit(None).cast("string"))
    patches = tracking.final_patch(run.with_texts(run.results.where(~accepted))).unionByName(
        tracking.final_patch(run.results.where(accepted).withColumn("extraction", nothing))
    )
    patches = patches.withColumn("seq", F.lit(1).cast("bigint"))
    if enrichment_patches is not None:
        patches = patches.unionByName(
            enrichment_patches.withColumn("seq", F.lit(2).cast("bigint"))
        )
    return tracking.merge_patches(patches)


def tracking_tables(
    results: DataFrame, enriched: EnrichRun | None = None, *, timestamp: Column | None = None
) -> dict[str, DataFrame]:
    """document_steps, audit_records, refused_audit and hash_records of an ingest run; with its
    enrichment also that one's audit, and enriched_records."""
    stamp = F.current_timestamp() if timestamp is None else timestamp
    audit = tracking.gate_audit(results)
    if enriched is not None:
        audit = audit.unionByName(tracking.enrichment_audit(enriched.everything))
    audit = (
        audit.withColumn("timestamp", stamp)
        .withColumn("duration_ms", F.lit(None).cast("int"))
    )
    valid, refused = tracking.split_audit(audit)
    hashes = results.where(F.col("status") == "accepted").select(
        F.col("reception.sha256").alias("sha256"), "job_id", stamp.alias("ingested_at")
    )
    tables = {
        "document_steps": tracking.steps_long(results, timestamp=stamp),
        "audit_records": valid,
        "refused_audit": refused,
        "hash_records": hashes,
    }
    if enriched is not None:
        tables["enriched_records"] = enriched.records
    return tables


def job_table(
    files: DataFrame, run: IngestRun, enriched: EnrichRun | None = None, *, now: Column | None = None
) -> DataFrame:
    """The whole job table of a run: as files were registered, with what became of them."""
    final = finalize_jobs(run, None if enriched is None else enriched.patches)
    stamps = tracking.register_jobs(files, now=now).select("job_id", "filename", "created_at", "updated_at")
    return stamps.join(final, "job_id")
