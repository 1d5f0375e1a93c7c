"""Jobs, steps, audit, decisions and the review queue, all keyed by ``job_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgate import fixed_values as fv
from inkgate.functions import text as tx

STEPS = (
    ("reception", fv.NODE_RECEPTION),
    ("format_validation", fv.NODE_FORMAT),
    ("extraction", fv.NODE_EXTRACTION),
    ("content_validation", fv.NODE_CONTENT),
    ("duplicate_control", fv.NODE_DUPLICATE),
)
PATCH_FIELDS = ("rejection_reason", "failed_at_node", "review_action_needed", "extracted_text")


def outcome(passed: Column) -> Column:
    return F.when(passed, "passed").otherwise("failed")


# --- steps -----------------------------------------------------------------------------------
def steps_long(df: DataFrame, *, timestamp: Column | None = None) -> DataFrame:
    """Step structs -> one row per step reached, in fixed order numbers."""
    rows = [
        F.struct(
            F.lit(order).alias("step_order"),
            F.lit(node).alias("node"),
            F.col(f"{name}.passed").alias("passed"),
            tx.empty_to_null(F.col(f"{name}.rejection_reason")).alias("rejection_reason"),
            F.to_json(F.col(name)).alias("detail"),
        )
        for order, (name, node) in enumerate(STEPS, start=1)
    ]
    stamp = F.current_timestamp() if timestamp is None else timestamp
    return (
        df.select("job_id", stamp.alias("timestamp"), F.explode(F.array(*rows)).alias("s"))
        .where(F.col("s.passed").isNotNull())
        .select(
            "job_id",
            "s.step_order",
            "s.node",
            outcome(F.col("s.passed")).alias("status"),
            "s.passed",
            "s.rejection_reason",
            F.lit(None).cast("int").alias("duration_ms"),
            "s.detail",
            "timestamp",
        )
    )


def failed_at() -> Column:
    """Name of the last failing step of a row with step structs."""
    failing = [
        F.when(~F.col(f"{name}.passed"), F.lit(node)) for name, node in reversed(STEPS)
    ]
    return F.coalesce(*failing)


def failed_step(steps: DataFrame) -> DataFrame:
    """(job_id, failed_at_node) from a step table."""
    return steps.groupBy("job_id").agg(
        F.max_by("node", F.when(~F.col("passed"), F.col("step_order"))).alias("failed_at_node")
    )


def ordered_steps(steps: DataFrame, *columns: str) -> DataFrame:
    """(job_id, document_steps): the at most five steps of a job, in order."""
    fields = ["step_order", *columns]
    return steps.groupBy("job_id").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("document_steps")
    )


def step_trails(steps: DataFrame) -> DataFrame:
    """(job_id, trail): ``1_file_reception=passed  2_...=failed``."""
    entry = F.concat(
        F.regexp_replace("node", "^node", ""), F.lit("="), F.col("status")
    ).alias("entry")
    listed = steps.groupBy("job_id").agg(
        F.sort_array(F.collect_list(F.struct("step_order", entry))).alias("_entries")
    )
    return listed.select(
        "job_id", F.array_join(F.col("_entries.entry"), "  ").alias("trail")
    )


# --- jobs --------------------------------------------------------------------------------------
def register_jobs(files: DataFrame, *, now: Column | None = None) -> DataFrame:
    """New rows of the job table for arriving files; unnamed files get a stand-in name."""
    stamp = F.current_timestamp() if now is None else now
    name = F.coalesce(tx.empty_to_null(F.col("filename")), F.lit(fv.UNNAMED_FILE))
    return files.select(
        "job_id",
        F.lit("started").alias("status"),
        name.alias("filename"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
        *[F.lit(None).cast("string").alias(field) for field in PATCH_FIELDS[:3]],
        F.lit(None).cast("string").alias("extracted_text"),
    )


def final_patch(df: DataFrame) -> DataFrame:
    """The update each finished run makes to its job.

    A NULL field struct leaves the old value, a struct holding NULL clears it. Text is kept
    only for documents that were not accepted.
    """

    def change(value: Column) -> Column:
        return F.struct(value.cast("string").alias("v"))

    not_accepted = F.col("status") != "accepted"
    return df.select(
        "job_id",
        "status",
        change(tx.empty_to_null(F.col("rejection_reason"))).alias("rejection_reason"),
        change(failed_at()).alias("failed_at_node"),
        change(F.when(F.col("status") == "review", fv.REVIEW_PENDING)).alias(
            "review_action_needed"
        ),
        F.when(not_accepted, change(tx.empty_to_null(F.col("extraction.text")))).alias(
            "extracted_text"
        ),
    )


def merge_patches(patches: DataFrame) -> DataFrame:
    """Patches (job_id, seq, status, field structs) folded into one row per job.

    The newest set value of each field wins. Plain aggregates: a job with a third of all
    patches is combined before the shuffle.
    """
    newest = [
        F.max_by(F.col(field)["v"], F.when(F.col(field).isNotNull(), F.col("seq"))).alias(field)
        for field in PATCH_FIELDS
    ]
    return patches.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), *newest)


def apply_patches(jobs: DataFrame, patches: DataFrame, *, now: Column | None = None) -> DataFrame:
    """The job table after the patches; fields no patch set keep their value."""
    stamp = F.current_timestamp() if now is None else now
    touched = patches.groupBy("job_id").agg(
        F.max_by("status", "seq").alias("_status"),
        *[
            F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"_{f}")
            for f in PATCH_FIELDS
        ],
    )
    joined = jobs.join(touched, "job_id", "left")
    changed = F.col("_status").isNotNull()
    values = {
        "status": F.coalesce("_status", "status"),
        "updated_at": F.when(changed, stamp).otherwise(F.col("updated_at")),
        **{
            f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}")["v"]).otherwise(F.col(f))
            for f in PATCH_FIELDS
        },
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in jobs.columns])


# --- review ---------------------------------------------------------------------------------------
def review_queue(jobs: DataFrame, steps: DataFrame, *step_columns: str) -> DataFrame:
    """Jobs waiting for a person with their ordered steps; ``[]`` when a job has none."""
    waiting = jobs.where(F.col("status") == "review").select(
        "job_id", "filename", "status", "rejection_reason", "created_at"
    )
    # steps of other jobs are left out before any list is built
    wanted = steps.join(waiting.select("job_id"), "job_id", "left_semi")
    nested = ordered_steps(wanted, *step_columns)
    empty = F.array().cast(nested.schema["document_steps"].dataType)
    return waiting.join(nested, "job_id", "left").withColumn(
        "document_steps", F.coalesce("document_steps", empty)
    )


def decision_outcomes(decisions: DataFrame, jobs: DataFrame) -> DataFrame:
    """decisions + (outcome, new_status).

    The earliest decision on a job in review is recorded, whatever comes later finds the job
    no longer in review. The earliest is found by an aggregate, not a window, so a job with
    very many decisions is combined before the shuffle.
    """
    first = decisions.groupBy("job_id").agg(
        F.min(F.struct("decided_at", "decision_id")).alias("_first")
    )
    state = first.join(
        jobs.select("job_id", F.col("status").alias("_status")), "job_id", "left"
    )
    joined = decisions.join(state, "job_id")
    is_first = (F.col("decision_id") == F.col("_first.decision_id")) & (
        F.col("decided_at") == F.col("_first.decided_at")
    )
    result = (
        F.when(F.col("_status").isNull(), "not_found")
        .when((F.col("_status") != "review") | ~is_first, "not_in_review")
        .otherwise("recorded")
    )
    becomes = F.when(F.lit(False), "")
    for decision, status in fv.DECISION_TO_STATUS.items():
        becomes = becomes.when(F.col("decision") == decision, F.lit(status))
    return (
        joined.withColumn("outcome", result)
        .withColumn("new_status", F.when(F.col("outcome") == "recorded", becomes))
        .select(*decisions.columns, "outcome", "new_status")
    )


def decision_patches(outcomes: DataFrame) -> DataFrame:
    """Status-only patches of the recorded decisions; every other field stays as it was."""
    unset = F.lit(None).cast("struct<v:string>")
    return outcomes.where(F.col("outcome") == "recorded").select(
        "job_id",
        F.lit(1).cast("bigint").alias("seq"),
        F.col("new_status").alias("status"),
        *[unset.alias(field) for field in PATCH_FIELDS],
    )


def allowed(requests: DataFrame, users: DataFrame, *, email: str = "email") -> DataFrame:
    """Requests by people on the list who are active and not blocked."""
    listed = users.where(F.col("is_active") & ~F.col("is_blocked")).select(
        F.col("email").alias(email)
    )
    return requests.join(listed, email, "left_semi")


# --- upkeep ----------------------------------------------------------------------------------------
def after_delete(child: DataFrame, deleted_jobs: DataFrame) -> DataFrame:
    """Rows of a child table that survive the removal of their jobs."""
    return child.join(deleted_jobs.select("job_id"), "job_id", "left_anti")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once where they must be unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


# --- audit -----------------------------------------------------------------------------------------
def _audit_row(node: str, step: str, **detail: Column) -> Column:
    fields = [column.alias(name) for name, column in detail.items()]
    return F.struct(
        F.lit(node).alias("node"),
        outcome(F.col(f"{step}.passed")).alias("event"),
        F.col(step).isNotNull().alias("reached"),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("detail"),
    )


def gate_audit(df: DataFrame) -> DataFrame:
    """(job_id, node, event, detail): what each reached step left behind, never full texts."""

    def of(step: str, *names: str) -> dict[str, Column]:
        return {name: F.col(f"{step}.{name}") for name in names}

    file = {"filename": F.col("filename")}
    verdict = ("passed", "rejection_reason")
    rows = [
        _audit_row(
            fv.NODE_RECEPTION,
            "reception",
            **file,
            **of("reception", "sha256", "detected_mime", "file_size_bytes", *verdict),
        ),
        _audit_row(
            fv.NODE_FORMAT,
            "format_validation",
            **file,
            **of("reception", "detected_mime"),
            **of("format_validation", "decision", "used_slm", *verdict),
        ),
        _audit_row(
            fv.NODE_EXTRACTION,
            "extraction",
            **file,
            **of("extraction", "extractor_used", "char_count"),
        ),
        _audit_row(
            fv.NODE_CONTENT,
            "content_validation",
            **file,
            **of(
                "content_validation",
                "char_count",
                "detected_language",
                "requires_ocr",
                "needs_agent_review",
                *verdict,
            ),
        ),
        _audit_row(
            fv.NODE_DUPLICATE,
            "duplicate_control",
            **file,
            **of("reception", "sha256"),
            **of(
                "duplicate_control",
                "is_duplicate",
                "duplicate_type",
                "similarity_score",
                *verdict,
            ),
        ),
    ]
    return (
        df.select("job_id", F.explode(F.array(*rows)).alias("a"))
        .where("a.reached")
        .select("job_id", "a.node", "a.event", "a.detail")
    )


def enrichment_audit(enriched: DataFrame) -> DataFrame:
    """Audit rows of the three enrichment steps."""
    failed = F.col("entities").isNull()
    rows = F.array(
        F.struct(
            F.lit(fv.NODE_CLEANER).alias("node"),
            F.lit("passed").alias("event"),
            F.to_json(
                F.struct(
                    "filename",
                    tx.char_count(F.col("text")).alias("input_chars"),
                    tx.char_count(F.col("cleaned_text")).alias("output_chars"),
                )
            ).alias("detail"),
        ),
        F.struct(
            F.lit(fv.NODE_ENTITIES).alias("node"),
            F.when(failed, "failed").otherwise("passed").alias("event"),
            F.when(failed, F.to_json(F.struct("filename", F.col("last_error").alias("error"))))
            .otherwise(
                F.to_json(
                    F.struct("filename", "entities.doc_type_hint", "entities.article_count"),
                    {"ignoreNullFields": "false"},
                )
            )
            .alias("detail"),
        ),
        F.when(
            ~failed,
            F.struct(
                F.lit(fv.NODE_METADATA).alias("node"),
                F.lit("passed").alias("event"),
                F.to_json(
                    F.struct("filename", F.lit(fv.METADATA_SOURCE).alias("source"))
                ).alias("detail"),
            ),
        ),
    )
    return (
        enriched.select("job_id", F.explode(rows).alias("a"))
        .where(F.col("a").isNotNull())
        .select("job_id", "a.node", "a.event", "a.detail")
    )


def split_audit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, refused): job, node and event must not be empty."""
    filled = F.lit(True)
    for column in ("job_id", "node", "event"):
        filled = filled & (F.length(F.coalesce(F.col(column), F.lit(""))) > 0)
    return rows.where(filled), rows.where(~filled)


def audit_trail(audit: DataFrame, *job_ids: str) -> DataFrame:
    """Audit rows of the named jobs (all when none is named) in time order."""
    if job_ids:
        audit = audit.where(F.col("job_id").isin(*job_ids))
    return audit.orderBy("job_id", "timestamp", "node", "event")
