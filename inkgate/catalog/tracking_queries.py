"""Jobs, steps, decisions and audit. Orders stand in for jobs, line items for their steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgate import fixed_values as fv
from inkgate.catalog import bindings as b
from inkgate.functions.naming import as_json_items
from inkgate.operators import tracking

_JOB = "concat('order-', cast({key} as string))"
_STATUS = "case o_orderstatus when 'O' then 'review' when 'F' then 'accepted' else 'rejected' end"
_NODE = (
    "case l_linenumber"
    f" when 1 then '{fv.NODE_RECEPTION}' when 2 then '{fv.NODE_FORMAT}'"
    f" when 3 then '{fv.NODE_EXTRACTION}' when 4 then '{fv.NODE_CONTENT}'"
    f" else '{fv.NODE_DUPLICATE}' end"
)
_DECISION = "case event_type when 'click' then 'accept' when 'view' then 'reject' else 'escalate' end"
_DECIDED_JOB = "concat('order-', cast(cast(floor(value * 1000) as bigint) as string))"
_INSTANT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_DATE = "date_format(created_at, 'yyyy-MM-dd')"


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    return b.table(spark, folder, "orders").select(
        F.expr(_JOB.format(key="o_orderkey")).alias("job_id"),
        F.expr(_STATUS).alias("status"),
        F.concat(F.col("o_orderpriority"), F.lit(".pdf")).alias("filename"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(F.col("o_orderstatus") == "O", F.lit("low")).alias("rejection_reason"),
    )


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    return b.table(spark, folder, "lineitem").select(
        F.expr(_JOB.format(key="l_orderkey")).alias("job_id"),
        F.col("l_linenumber").alias("step_order"),
        F.expr(_NODE).alias("node"),
        F.col("l_returnflag").isin("A", "N").alias("passed"),
        tracking.outcome(F.col("l_returnflag").isin("A", "N")).alias("status"),
    )


def _decisions(spark: SparkSession, folder: str) -> DataFrame:
    return b.table(spark, folder, "events").select(
        F.col("event_id").alias("decision_id"),
        F.expr(_DECIDED_JOB).alias("job_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("decided_by"),
        F.expr(_DECISION).alias("decision"),
        F.col("ts").cast("timestamp").alias("decided_at"),
    )


CTES = f"""
jobs AS (
  SELECT {_JOB.format(key="o_orderkey")} AS job_id, {_STATUS} AS status,
    o_orderpriority || '.pdf' AS filename, o_orderdate AS created_at,
    CASE WHEN o_orderstatus = 'O' THEN 'low' END AS rejection_reason FROM orders),
steps AS (
  SELECT {_JOB.format(key="l_orderkey")} AS job_id, l_linenumber AS step_order, {_NODE} AS node,
    l_returnflag IN ('A', 'N') AS passed,
    CASE WHEN l_returnflag IN ('A', 'N') THEN 'passed' ELSE 'failed' END AS status FROM lineitem),
decisions AS (
  SELECT event_id AS decision_id, {_DECIDED_JOB} AS job_id,
    'user-' || user_id AS decided_by, {_DECISION} AS decision, ts AS decided_at FROM events)"""


def register_jobs(spark: SparkSession, folder: str) -> DataFrame:
    registered = tracking.register_jobs(b.all_files(spark, folder))
    return registered.select(
        "job_id", "status", "filename", (F.col("created_at") == F.col("updated_at")).alias("fresh")
    )


REGISTER_JOBS = f"""
WITH {b.ALL_FILES_SQL}
SELECT job_id, 'started' AS status, filename, TRUE AS fresh FROM files
"""


def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    queue = tracking.review_queue(
        _jobs(spark, folder), _steps(spark, folder), "node", "status"
    )
    entries = F.transform(
        "document_steps",
        lambda s: F.concat_ws(":", s["step_order"].cast("string"), s["node"], s["status"]),
    )
    return queue.select(
        "job_id",
        "filename",
        "status",
        "rejection_reason",
        F.expr(_DATE).alias("created_on"),
        F.array_join(entries, "|").alias("document_steps"),
    ).orderBy("created_on", "job_id")


REVIEW_QUEUE = f"""
WITH {CTES},
nested AS (
  SELECT job_id, string_agg(step_order || ':' || node || ':' || status, '|'
    ORDER BY step_order, node, status) AS document_steps FROM steps GROUP BY 1)
SELECT j.job_id, filename, j.status, rejection_reason,
       strftime(created_at, '%Y-%m-%d') AS created_on,
       coalesce(document_steps, '') AS document_steps
FROM jobs j LEFT JOIN nested n ON n.job_id = j.job_id WHERE j.status = 'review'
"""


def review_queue_items(spark: SparkSession, folder: str) -> DataFrame:
    """The queue as JSON items with camelCase names."""
    queue = tracking.review_queue(
        _jobs(spark, folder).withColumn("created_at", F.expr(_DATE)),
        _steps(spark, folder),
        "node",
        "status",
    )
    return as_json_items(queue)


REVIEW_QUEUE_ITEMS = f"""
WITH {CTES},
nested AS (
  SELECT job_id, string_agg('{{"stepOrder":' || step_order || ',"node":"' || node || '","status":"'
    || status || '"}}', ',' ORDER BY step_order, node, status) AS listed FROM steps GROUP BY 1)
SELECT '{{"jobId":"' || j.job_id || '","filename":"' || filename || '","status":"' || j.status
  || '","rejectionReason":"' || rejection_reason || '","createdAt":"'
  || strftime(created_at, '%Y-%m-%d') || '","documentSteps":[' || coalesce(listed, '') || ']}}'
  AS item
FROM jobs j LEFT JOIN nested n ON n.job_id = j.job_id WHERE j.status = 'review'
"""


def apply_decisions(spark: SparkSession, folder: str) -> DataFrame:
    outcomes = tracking.decision_outcomes(_decisions(spark, folder), _jobs(spark, folder))
    return outcomes.select("decision_id", "job_id", "decision", "outcome", "new_status")


APPLY_DECISIONS = f"""
WITH {CTES},
joined AS (
  SELECT d.*, j.status AS job_status,
    row_number() OVER (PARTITION BY d.job_id ORDER BY decided_at, decision_id) AS nth
  FROM decisions d LEFT JOIN jobs j ON j.job_id = d.job_id),
judged AS (
  SELECT *, CASE WHEN job_status IS NULL THEN 'not_found'
                 WHEN job_status <> 'review' OR nth > 1 THEN 'not_in_review'
                 ELSE 'recorded' END AS outcome FROM joined)
SELECT decision_id, job_id, decision, outcome,
  CASE WHEN outcome = 'recorded' THEN CASE decision WHEN 'accept' THEN 'accepted'
    WHEN 'reject' THEN 'rejected' ELSE 'escalated' END END AS new_status FROM judged
"""


def decided_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The job table once the decisions are in: only the status moves."""
    jobs = _jobs(spark, folder).select(
        "*",
        F.col("created_at").alias("updated_at"),
        F.lit(None).cast("string").alias("failed_at_node"),
        F.lit(fv.REVIEW_PENDING).alias("review_action_needed"),
        F.lit(None).cast("string").alias("extracted_text"),
    )
    outcomes = tracking.decision_outcomes(_decisions(spark, folder), jobs)
    after = tracking.apply_patches(jobs, tracking.decision_patches(outcomes))
    return after.select("job_id", "status", "rejection_reason", "review_action_needed")


DECIDED_JOBS = f"""
WITH {CTES},
firsts AS (
  SELECT * FROM decisions
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY decided_at, decision_id) = 1)
SELECT j.job_id,
  CASE WHEN j.status = 'review' AND f.decision IS NOT NULL
       THEN CASE f.decision WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected'
            ELSE 'escalated' END ELSE j.status END AS status,
  rejection_reason, '{fv.REVIEW_PENDING}' AS review_action_needed
FROM jobs j LEFT JOIN firsts f ON f.job_id = j.job_id
"""


def decision_history(spark: SparkSession, folder: str) -> DataFrame:
    decisions = _decisions(spark, folder)
    return decisions.orderBy("job_id", "decided_at", "decision_id").select(
        "job_id", "decided_by", "decision", F.date_format("decided_at", _INSTANT).alias("decided")
    )


DECISION_HISTORY = f"""
WITH {CTES}
SELECT job_id, decided_by, decision, strftime(decided_at, '%Y-%m-%d %H:%M:%S.%f') AS decided
FROM decisions ORDER BY job_id, decided_at, decision_id
"""


def allowlist(spark: SparkSession, folder: str) -> DataFrame:
    users = b.table(spark, folder, "customer").select(
        F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.org")).alias(
            "email"
        ),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        (F.col("c_mktsegment") == "MACHINERY").alias("is_blocked"),
    )
    requests = b.table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat(F.lit("user"), F.col("o_custkey").cast("string"), F.lit("@example.org")).alias(
            "email"
        ),
    )
    return tracking.allowed(requests, users).select("o_orderkey", "email")


ALLOWLIST = """
SELECT o_orderkey, 'user' || o_custkey || '@example.org' AS email FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer
                    WHERE c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY')
"""

_PATCH_SQL = {
    # set to a text, cleared, or left alone
    "rejection_reason": (
        "event_type in ('error', 'view')",
        "case when event_type = 'error' then concat('code ', cast(event_id as string)) end",
    ),
    "failed_at_node": ("event_type in ('error', 'click')", "case when event_type = 'error' then 'n' end"),
    "review_action_needed": ("event_type = 'signup'", "'pending'"),
    "extracted_text": ("event_type = 'purchase'", "props"),
}


def merge_patches(spark: SparkSession, folder: str) -> DataFrame:
    events = b.table(spark, folder, "events")
    patches = events.select(
        F.expr(b.EVENT_JOB).alias("job_id"),
        F.col("event_id").alias("seq"),
        F.expr(b.EVENT_STATUS).alias("status"),
        *[
            F.when(F.expr(is_set), F.struct(F.expr(value).alias("v"))).alias(field)
            for field, (is_set, value) in _PATCH_SQL.items()
        ],
    )
    return tracking.merge_patches(patches)


MERGE_PATCHES = f"""
WITH merged AS (
  SELECT {b.EVENT_JOB} AS job_id, max(event_id) AS last_seq,
    {", ".join(f"max(event_id) FILTER (WHERE {s}) AS {f}_seq" for f, (s, _) in _PATCH_SQL.items())}
  FROM events GROUP BY 1)
SELECT m.job_id, (SELECT {b.EVENT_STATUS} FROM events e WHERE e.event_id = last_seq) AS status,
  {", ".join(
      f"(SELECT {v} FROM events e WHERE e.event_id = {f}_seq) AS {f}"
      for f, (_, v) in _PATCH_SQL.items())}
FROM merged m
"""


def failed_steps(spark: SparkSession, folder: str) -> DataFrame:
    return tracking.failed_step(_steps(spark, folder))


FAILED_STEPS = f"""
WITH {CTES}
SELECT job_id, arg_max(node, step_order) FILTER (WHERE NOT passed) AS failed_at_node
FROM steps GROUP BY 1
"""


def batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    trails = tracking.step_trails(_steps(spark, folder))
    return (
        _jobs(spark, folder)
        .select("job_id", "filename", "status", "rejection_reason")
        .join(trails, "job_id", "left")
    )


BATCH_SUMMARY = f"""
WITH {CTES},
trails AS (
  SELECT job_id, string_agg(regexp_replace(node, '^node', '') || '=' || status, '  '
    ORDER BY step_order, regexp_replace(node, '^node', '') || '=' || status) AS trail
  FROM steps GROUP BY 1)
SELECT j.job_id, filename, j.status, rejection_reason, trail
FROM jobs j LEFT JOIN trails t ON t.job_id = j.job_id
"""


def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    gone = _jobs(spark, folder).where(F.col("status") == "rejected")
    left = tracking.after_delete(_steps(spark, folder), gone)
    return left.select("job_id", "step_order", "node", "status")


CASCADE_DELETE = f"""
WITH {CTES}
SELECT job_id, step_order, node, status FROM steps
WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE status = 'rejected')
"""


def uniqueness_violations(spark: SparkSession, folder: str) -> DataFrame:
    hashes = b.document_files(spark, folder).select(F.sha2("content", 256).alias("sha256"))
    return tracking.duplicate_keys(hashes, "sha256")


UNIQUENESS_VIOLATIONS = f"""
SELECT sha256({b.DOC_BODY}) AS sha256, count(*) AS occurrences FROM documents
GROUP BY 1 HAVING count(*) > 1
"""


def audit_trail(spark: SparkSession, folder: str) -> DataFrame:
    audit = b.node_events(spark, folder).withColumnRenamed("status", "event")
    return tracking.audit_trail(audit).select(
        "job_id", "node", "event", "duration_ms", F.date_format("timestamp", _INSTANT).alias("at")
    )


AUDIT_TRAIL = f"""
WITH {b.NODE_EVENTS_SQL}
SELECT job_id, node, status AS event, duration_ms, strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') AS at
FROM node_events ORDER BY job_id, "timestamp", node, event
"""


def node_durations(spark: SparkSession, folder: str) -> DataFrame:
    audit = b.node_events(spark, folder).withColumnRenamed("status", "event")
    return audit.groupBy("job_id", "node", "event").agg(
        F.count("*").alias("n"),
        F.sum("duration_ms").alias("total_ms"),
        F.max("duration_ms").alias("max_ms"),
    )


NODE_DURATIONS = f"""
WITH {b.NODE_EVENTS_SQL}
SELECT job_id, node, status AS event, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS total_ms,
       max(duration_ms) AS max_ms
FROM node_events GROUP BY 1, 2, 3
"""

QUERIES = {
    "register_jobs": register_jobs,
    "review_queue": review_queue,
    "review_queue_items": review_queue_items,
    "apply_decisions": apply_decisions,
    "decided_jobs": decided_jobs,
    "decision_history": decision_history,
    "allowlist": allowlist,
    "merge_patches": merge_patches,
    "failed_steps": failed_steps,
    "batch_summary": batch_summary,
    "cascade_delete": cascade_delete,
    "uniqueness_violations": uniqueness_violations,
    "audit_trail": audit_trail,
    "node_durations": node_durations,
}
ORACLES = {
    "register_jobs": REGISTER_JOBS,
    "review_queue": REVIEW_QUEUE,
    "review_queue_items": REVIEW_QUEUE_ITEMS,
    "apply_decisions": APPLY_DECISIONS,
    "decided_jobs": DECIDED_JOBS,
    "decision_history": DECISION_HISTORY,
    "allowlist": ALLOWLIST,
    "merge_patches": MERGE_PATCHES,
    "failed_steps": FAILED_STEPS,
    "batch_summary": BATCH_SUMMARY,
    "cascade_delete": CASCADE_DELETE,
    "uniqueness_violations": UNIQUENESS_VIOLATIONS,
    "audit_trail": AUDIT_TRAIL,
    "node_durations": NODE_DURATIONS,
}
