"""The operators over the given tables: thin steps, and SQL where SQL can express them.

Every query maps ``documents`` or ``pages`` to records (``doc_id`` is the job id), applies one
operator to the whole table and maps its result to the columns asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgate.llm import dialogue
from inkgate.llm import exact_copies as ec
from inkgate.llm import id_files, packing, page_text, separators
from inkgate.llm import phrase_index as pi
from inkgate.llm import quality, resampling
from inkgate.llm import shingle_join as sj
from inkgate.llm import turn_repair, vector_graph, web_archive
from inkgate.llm.common import same_splits, scratch_path
from inkgate.llm.tokens import tokenizer_path
from inkgate.session import cut

# Documents with this quality score or more are accepted.
ACCEPTED_FROM = 0.3


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_records(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents").select(
        F.col("doc_id").alias("job_id"), F.col("text").alias("cleaned_text")
    )


def packed(records: DataFrame) -> DataFrame:
    pieces = packing.pack(records, tokenizer_path("byte_bpe_50k.json"), end_id=1, max_length=2048)
    return pieces.select(
        F.col("job_id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        F.col("tokens").alias("doc_tokens"),
        "sequence_id",
        "offset",
    )


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(document_records(spark, folder))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    # The files know no ids: record i of file p is row i of the table's partition p.
    with same_splits(spark):
        docs = document_records(spark, folder)
        separators.write_token_files(docs, tokenizer_path("byte_bpe_50k.json"), path)
        rows = docs.select(
            F.col("job_id").alias("doc_id"),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("int").alias("turn"),
        )
        rows = cut(rows, "places")
    counts = separators.token_counts(spark, path)
    part = F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("int")
    return counts.withColumn("part", part).join(rows, ["part", "turn"], "full").select("doc_id", "start", "n_tokens")


def op3_web_archive(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select(
        F.col("page_id").alias("job_id"), F.col("url").alias("filename"), F.col("html").cast("binary").alias("content")
    )
    path = scratch_path(spark, "archives")
    web_archive.write_archives(pages, path)
    return web_archive.read_archives(spark, path).select(
        F.col("job_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


OP3_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS origin FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND origin <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND origin <> page_id THEN origin END AS refers_to
FROM f
"""


def op4_id_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "id-files")
    id_files.write_id_files(document_records(spark, folder), tokenizer_path("word_bpe_49k.json"), path, end_id=2)
    return id_files.read_id_files(spark, path).select(
        F.col("job_id").alias("doc_id"),
        "start",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = pi.contamination(document_records(spark, folder), _table(spark, folder, "benchmark"))
    ids = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select(
        F.col("job_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, len(x) AS width, array_to_string(x, ' ') AS phrase
  FROM (SELECT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: w[i:i + 9])) AS x
        FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM windows),
starts AS MATERIALIZED (
  SELECT doc_id, width, s, array_to_string(w[s:s + width - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS s FROM d CROSS JOIN widths WHERE len(w) >= width)),
hits AS MATERIALIZED (SELECT doc_id, item_id, s, width FROM starts JOIN windows USING (width, phrase)),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + width)) AS p FROM (SELECT DISTINCT doc_id, s, width FROM hits)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return sj.jaccard_components(document_records(spark, folder)).withColumnRenamed("job_id", "doc_id")


OP6_SQL = r"""
WITH RECURSIVE lists AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1),
      lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM lists),
sized AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s FROM sets),
tokens AS MATERIALIZED (SELECT doc_id, n, hash(unnest(s)) AS t FROM sized),
pairs AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id <> y.doc_id
   AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM sized UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT doc_id, n AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM sized
"""


def _held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Learned from the labels that are not held out."""
    decisions = labels.where(~_held_out("doc_id")).select(
        F.col("doc_id").alias("job_id"), F.when(F.col("quality") == 1, "accept").otherwise("reject").alias("decision")
    )
    return quality.fit(docs, decisions, job_id="doc_id", cleaned_text="text")


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    model = quality_model(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return quality.quality_scores(document_records(spark, folder), model).select(
        F.col("job_id").alias("doc_id"),
        _held_out("job_id").alias("held_out"),
        "score",
        (F.col("score") >= ACCEPTED_FROM).cast("int").alias("predicted"),
    )


def op8_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.perspectives(_table(spark, folder, "conversations"))


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, name AS perspective FROM t),
p AS (
  SELECT t.conv_id, perspective, turn, name, CASE WHEN name = perspective THEN 'assistant' ELSE 'user' END AS role,
    CASE WHEN name = perspective THEN '<|assistant|>' ELSE '<|user:' || name || '|>' END || chr(10) AS head, text
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
q AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS piece, length(head) + length(text) + 8 AS n_chars FROM p),
r AS (
  SELECT *, CAST(coalesce(sum(n_chars) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, name, piece
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM q)
SELECT conv_id, perspective, turn, role, name, piece, start, n_chars,
  CASE WHEN role = 'assistant' THEN start + length(head) END AS loss_start,
  CASE WHEN role = 'assistant' THEN start + n_chars END AS loss_end
FROM r
"""


def op9_page_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    return page_text.main_text(pages, job_id="page_id", filename="url", content="html").select(
        F.col("job_id").alias("page_id"), F.col("filename").alias("url"), "text", F.length("text").cast("long").alias("n_chars")
    )


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return ec.exact_copies(document_records(spark, folder)).select(
        F.col("job_id").alias("doc_id"),
        F.col("first_job_id").alias("keep_id"),
        "group_size",
        (~F.col("is_duplicate")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept, text_sha256
FROM d
"""

def damaged_turns(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by the checksum of dialogue and turn number."""
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(f"{c}_name") for c in ("conv_id", "turn")),
    )
    kind = F.crc32(F.concat("conv_id_name", F.lit(":"), "turn_name").cast("binary")) % 20
    rows = rows.withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = _table(spark, folder, "conversations")
    found = turn_repair.repair(damaged_turns(conversations))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    judged = found.dialogues.select(F.col("conv_id").alias("judged"), *counts, "audit")
    hashed = turn_repair.fingerprints(found).select(F.col("conv_id").alias("hashed"), "repaired_sha256")
    return (
        conversations.select("conv_id")
        .distinct()
        .join(judged, F.col("conv_id").eqNullSafe(F.col("judged")), "left")
        .join(hashed, F.col("conv_id").eqNullSafe(F.col("hashed")), "left")
        .select(
            "conv_id",
            *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
        )
    )


def op12_vector_graph(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    index = vector_graph.build_index(vectors)
    found = vector_graph.nearest(index, vectors.where("id % 50 = 0"), k=5)
    return found.select(F.col("id").alias("query_id"), "rank", F.col("neighbour_id").alias("vec_id"), F.col("cosine").alias("score"))


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resampling.resample(document_records(spark, folder), _table(spark, folder, "benchmark"))
    return drawn.select(F.col("job_id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_token_counts": op2_token_counts,
    "op3_web_archive": op3_web_archive,
    "op4_id_files": op4_id_files,
    "op5_decontamination": op5_decontamination,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_quality": op7_quality,
    "op8_perspectives": op8_perspectives,
    "op9_page_text": op9_page_text,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_turn_repair": op11_turn_repair,
    "op12_vector_graph": op12_vector_graph,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLES = {
    "op3_web_archive": OP3_SQL,
    "op5_decontamination": OP5_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op8_perspectives": OP8_SQL,
    "op10_exact_dedup": OP10_SQL,
}
