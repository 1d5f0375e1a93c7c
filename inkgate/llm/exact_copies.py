"""Exact duplicates of enriched records by two-pass Bloom filtering, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgate.llm.common import (
    ASCII_SPACE,
    MAX_FILTER_BITS,
    filter_bits,
    free_name,
    records,
    repeat_filter,
    with_flag,
)
from inkgate.session import cut


def _digest(text: Column) -> Column:
    return F.sha2(F.translate(text, ASCII_SPACE, "").cast("binary"), 256)


def _keyed(table: DataFrame) -> DataFrame:
    """Narrow rows (job_id, sha256, char_count), written once: texts are hashed in the scan."""
    return cut(
        table.select(
            "job_id",
            _digest(F.col("cleaned_text")).alias("sha256"),
            F.length("cleaned_text").cast("long").alias("char_count"),
        ),
        "digests",
    )


def _groups(maybe: DataFrame) -> DataFrame:
    """(sha256, group_size, first_job_id) of digests with two rows or more."""
    best = F.min(F.struct((-F.col("char_count")).alias("n"), F.col("job_id").isNull().alias("nil"), "job_id"))
    return (
        maybe.groupBy("sha256")
        .agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
        .where("group_size > 1")
        .select("sha256", "group_size", F.col("best.job_id").alias("first_job_id"))
    )


def _passes(keyed: DataFrame, max_filter_bits: int) -> tuple[DataFrame, int]:
    bits = filter_bits(keyed.count(), most=max_filter_bits)
    return cut(repeat_filter(keyed, "sha256", bits), "filter"), bits


def exact_copies(
    enriched_records: DataFrame,
    *,
    job_id: str = "job_id",
    cleaned_text: str = "cleaned_text",
    max_filter_bits: int = MAX_FILTER_BITS,
) -> DataFrame:
    """One row per record: which record of its group of equal texts stays.

    Texts are equal when identical without ASCII white space. The longest original text stays,
    then the smallest job id. The first pass hits two slots per digest; slots hit twice or more
    form the filter, which is broadcast (at most ``max_filter_bits / 64`` rows of two longs).
    The second pass sends digests that may be repeated to an aggregation, combined in the map
    tasks; all other rows pass straight through. Texts never move.

    Returns job_id, sha256, char_count, group_size, first_job_id, is_duplicate.

    Nulls and empty texts are one group (the digest of nothing). Rows that repeat the job id of
    the record that stays all stay. A null job id comes after all others. No rows in, no rows
    out. Other columns are ignored.
    """
    keyed = _keyed(records(enriched_records, job_id, cleaned_text))
    words, bits = _passes(keyed, max_filter_bits)
    flagged = with_flag(keyed, words, F.col("sha256"), bits, "maybe")
    maybe = cut(flagged.where("maybe").drop("maybe"), "maybe")
    groups = cut(_groups(maybe), "groups")
    alone = flagged.where(~F.col("maybe")).select(
        "job_id", "sha256", "char_count", F.lit(1).cast("long").alias("group_size"), F.col("job_id").alias("first_job_id")
    )
    grouped = maybe.join(groups, "sha256", "left").select(
        "job_id",
        "sha256",
        "char_count",
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("group_size").isNull(), F.col("job_id")).otherwise(F.col("first_job_id")).alias("first_job_id"),
    )
    return alone.unionByName(grouped).withColumn(
        "is_duplicate", ~F.col("job_id").eqNullSafe(F.col("first_job_id"))
    )


def without_copies(
    table: DataFrame,
    *,
    job_id: str = "job_id",
    cleaned_text: str = "cleaned_text",
    max_filter_bits: int = MAX_FILTER_BITS,
) -> DataFrame:
    """The rows of ``table`` that ``exact_copies`` lets stay, with all their columns.

    Only rows whose digest may be repeated shuffle, by job id and digest; the rest pass. Null and
    repeated ids are told apart by their texts.
    """
    keyed = _keyed(records(table, job_id, cleaned_text))
    words, bits = _passes(keyed, max_filter_bits)
    maybe = with_flag(keyed, words, F.col("sha256"), bits, "maybe").where("maybe")
    groups = cut(_groups(maybe), "groups")
    dropped = (
        maybe.join(groups, "sha256")
        .where(~F.col("job_id").eqNullSafe(F.col("first_job_id")))
        .select(F.col("job_id").alias("dropped_id"), F.col("sha256").alias("dropped_sha256"))
        .distinct()
    )
    flag, digest = free_name(table, "maybe"), free_name(table, "sha256")
    hashed = _digest(F.coalesce(F.col(cleaned_text).cast("string"), F.lit("")))
    flagged = with_flag(table, words, hashed, bits, flag)
    same = F.col(job_id).eqNullSafe(F.col("dropped_id")) & F.col(digest).eqNullSafe(F.col("dropped_sha256"))
    stays = flagged.where(F.col(flag)).withColumn(digest, hashed).join(dropped, same, "left_anti").drop(flag, digest)
    return flagged.where(~F.col(flag)).drop(flag).unionByName(stays)
