"""The gate over files as they arrive, against a growing store of accepted documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from inkgate.config import GateRules
from inkgate.operators import token_similarity as ts
from inkgate.operators.duplicates import Control, Store, VectorStore, duplicate_control
from inkgate.operators.extraction import Loader, is_column
from inkgate.plans.ingest import Lookup, ingest
from inkgate.plans.enrich import accepted_documents, enrich
from inkgate.plans.persist import job_table, tracking_tables
from inkgate.session import cut, scratch
from inkgate.sources import tables
from inkgate.streaming.events import run_events

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("words", T.ArrayType(T.LongType())),
    ]
)
MEMBER_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("n_words", T.IntegerType()),
        T.StructField("prefix", T.ArrayType(T.IntegerType())),
        T.StructField("bits", T.BinaryType()),
    ]
)
# What earlier versions stored of a member, in rows of a prefix word each: now only whose they are is read.
PREFIX_ROW_SCHEMA = T.StructType([T.StructField("id", T.StringType())])
VECTOR_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("cell", T.IntegerType()),
        T.StructField("angle", T.DoubleType()),
        T.StructField("vec", T.ArrayType(T.DoubleType())),
    ]
)
PIVOT_SCHEMA = T.StructType(
    [T.StructField("cell", T.IntegerType()), T.StructField("vec", T.ArrayType(T.DoubleType()))]
)
RADIUS_SCHEMA = T.StructType(
    [T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())]
)
SLOT_SCHEMA = T.StructType(
    [T.StructField("slot", T.IntegerType()), T.StructField("count", T.LongType())]
)


def open_store(
    spark: SparkSession, root: str, batch_id: int, texts: DataFrame, threshold: float
) -> Store:
    """The store as earlier batches left it.

    The word order is fixed by the first batch's ``texts`` and kept, so that members written
    by any batch can be compared with those of every other. Of documents that an earlier version
    stored the sketches are made here.
    """
    slots = tables.read_table(spark, root, "word_order", SLOT_SCHEMA)
    if slots.isEmpty():
        counted = ts.slot_counts(texts.select(ts.distinct_words(F.col("text")).alias("words")))
        # the extra row marks an order as fixed even where the first batch has no words
        mark = spark.createDataFrame([(0, 0)], SLOT_SCHEMA)
        counted = counted.unionByName(mark)
        counted.write.mode("overwrite").parquet(tables.table_path(root, "word_order"))
        slots = tables.read_table(spark, root, "word_order", SLOT_SCHEMA)
    order = ts.slot_frequencies(slots)
    documents = tables.read_before(spark, root, "accepted", DOCUMENT_SCHEMA, batch_id)
    members = tables.read_before(spark, root, "accepted_sketches", MEMBER_SCHEMA, batch_id)
    rows = tables.read_before(spark, root, "accepted_members", PREFIX_ROW_SCHEMA, batch_id)
    if not rows.isEmpty():
        named = documents.join(rows.distinct(), "id", "left_semi")
        members = members.unionByName(ts.word_sketches(named, threshold, order))
    return Store(documents, members, order)


def open_vector_store(spark: SparkSession, root: str, batch_id: int) -> VectorStore:
    """The store as earlier batches left it; its vectors are parted by cell.

    The pivots are those of the first batch that had vectors. They and the radii, a number for each
    cell and batch, are what the driver reads.
    """
    rows = tables.read_table(spark, root, "pivots", PIVOT_SCHEMA).orderBy("cell").collect()
    radii = tables.read_before(spark, root, "radii", RADIUS_SCHEMA, batch_id).groupBy("cell").agg(F.max("radius").alias("r"))
    pivots = widths = None
    if rows:
        pivots = np.array([r["vec"] for r in rows], dtype=np.float64)
        widths = np.full(len(pivots), -np.inf)
        for r in radii.collect():
            widths[r["cell"]] = r["r"]
    return VectorStore(
        tables.read_before(spark, root, "accepted", DOCUMENT_SCHEMA, batch_id).drop("words"),
        tables.read_before(spark, root, "accepted_vectors", VECTOR_SCHEMA, batch_id),
        pivots,
        widths,
    )


def extend_store(control: Control, root: str, batch_id: int) -> None:
    if control.cells is None:
        tables.append_batch(control.documents, root, "accepted", batch_id)
        tables.append_batch(control.members, root, "accepted_sketches", batch_id)
        return
    spark = control.documents.sparkSession
    nothing = F.lit(None).cast("array<bigint>")
    tables.append_batch(control.documents.withColumn("words", nothing), root, "accepted", batch_id)
    stored = cut(control.members, "stored")
    tables.append_batch(stored, root, "accepted_vectors", batch_id, by=("cell",))
    radii = stored.groupBy("cell").agg(F.max("angle").alias("radius"))
    tables.append_batch(radii, root, "radii", batch_id)
    if not stored.isEmpty() and tables.read_table(spark, root, "pivots", PIVOT_SCHEMA).isEmpty():
        named = [(i, p.tolist()) for i, p in enumerate(control.cells.pivots)]
        spark.createDataFrame(named, PIVOT_SCHEMA).write.mode("overwrite").parquet(tables.table_path(root, "pivots"))


def control_batch(docs: DataFrame, batch_id: int, root: str, rules: GateRules) -> None:
    """Judge one micro-batch docs(id, arrival, sha256, text) and extend the store.

    The batch sees what earlier batches accepted and overwrites its own partitions, so a
    replayed batch leaves the same tables behind.
    """
    texts = docs.select("id", "text")
    threshold = rules.duplicates.cosine_similarity_threshold
    control = duplicate_control(
        docs.select("id", "arrival", "sha256"),
        texts,
        threshold=threshold,
        store=open_store(docs.sparkSession, root, batch_id, texts, threshold),
    )
    extend_store(control, root, batch_id)
    tables.append_batch(
        control.verdicts.select("id", "duplicate_control.*"), root, "verdicts", batch_id
    )


def control_stream(
    docs: DataFrame, root: str, checkpoint: str, rules: GateRules | None = None
) -> StreamingQuery:
    """Duplicate control over a stream of documents that passed the earlier checks."""
    rules = rules or GateRules()

    def write(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            control_batch(batch, batch_id, root, rules)

    return (
        docs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_batch(
    uploads: DataFrame,
    batch_id: int,
    root: str,
    extractors: Sequence[tuple[str, Column | Loader]],
    responses: DataFrame,
    rules: GateRules,
    attempts: DataFrame | None = None,
    **hooks: Lookup | None,
) -> None:
    """Judge one micro-batch of uploads and write its tables under ``root``.

    uploads(job_id, arrival, filename, content, ...) are compared with each other
    and with everything earlier batches accepted, by vectors where the hooks of ``ingest`` name an
    ``embed``. With ``attempts`` of the entity model the accepted ones are enriched in the same
    batch; those that fail go to review. Written are jobs, document_steps, audit_records,
    refused_audit, hash_records, node_events and enriched_records. Every table keeps the batch as
    a partition that a replay overwrites.
    """
    spark = uploads.sparkSession
    if hooks.get("embed") is not None:
        store = open_vector_store(spark, root, batch_id)
    else:
        # any text will do to fix the word order: the first extractor's that is a column
        texts = [text for _, text in extractors if is_column(text)] or [F.col("content").cast("string")]
        threshold = rules.duplicates.cosine_similarity_threshold
        store = open_store(spark, root, batch_id, uploads.select(texts[0].alias("text")), threshold)
    run = ingest(uploads, extractors, responses, rules, store=store, **hooks)
    extend_store(run.control, root, batch_id)
    enriched = None
    if attempts is not None:
        enriched = enrich(accepted_documents(run), attempts, rules.enrichment)
        # read by the job table, the audit and the records
        enriched = replace(enriched, everything=cut(enriched.everything, "enriched"))
    tables.append_batch(job_table(uploads, run, enriched), root, "jobs", batch_id)
    tables.append_batch(run_events(run.results), root, "node_events", batch_id)
    for name, table in tracking_tables(run.results, enriched).items():
        tables.append_batch(table, root, name, batch_id)


def ingest_stream(
    uploads: DataFrame,
    root: str,
    checkpoint: str,
    extractors: Sequence[tuple[str, Column | Loader]],
    responses: DataFrame,
    rules: GateRules | None = None,
    attempts: DataFrame | None = None,
    **hooks: Lookup | None,
) -> StreamingQuery:
    """The whole gate over uploads as they arrive, until the source is drained.

    ``attempts``(job_id, attempt, response) are the entity model's answers; ``hooks`` are those of
    ``ingest``: mime, language, embed.
    """
    rules = rules or GateRules()

    def judge(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            ingest_batch(batch, batch_id, root, extractors, responses, rules, attempts, **hooks)

    return watch(uploads, judge, checkpoint)


def watch(
    uploads: DataFrame, judge: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Hand each micro-batch of uploads to ``judge(batch, batch_id)``."""
    return (
        uploads.writeStream.foreachBatch(judge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

