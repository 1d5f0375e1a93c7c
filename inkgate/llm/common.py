"""Parts that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgate.session import new_path

# ASCII white space: \x20 and \x09 to \x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def records(table: DataFrame, key: str = "job_id", text: str = "cleaned_text") -> DataFrame:
    """Only ``job_id`` and ``cleaned_text``, null texts empty: other columns can't clash."""
    return table.select(
        F.col(key).alias("job_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("cleaned_text"),
    )


def ids_as_text(table: DataFrame, *columns: str) -> DataFrame:
    """Ids as text for a stretch of Python: as numbers next to nulls, pandas would round long ones.

    ``ids_as`` gives them their type back.
    """
    return table.withColumns({c: F.col(c).cast("string") for c in columns})


def ids_as(table: DataFrame, kind: str, *columns: str) -> DataFrame:
    """Ids from ``ids_as_text`` in their own type again."""
    return table.withColumns({c: F.col(c).cast(kind) for c in columns})


def free_name(table: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``table`` has it."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share; ``session.scratch`` removes it."""
    return new_path(spark, label)


@contextmanager
def same_splits(spark: SparkSession) -> Iterator[None]:
    """Scans planned inside cut a table into the same partitions, also when executors come or go."""
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None):
        yield
        return
    spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(key)


def cut_tight(df: DataFrame, label: str) -> DataFrame:
    """Like ``cut``, for large binary columns: written with zstd."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---- bit filters -----------------------------------------------------------------------------
#
# A filter is a table (word, bits): 64 slots to a row, at most ``bits / 64`` rows. That bounds
# what is broadcast: 2^27 slots are 2^21 rows of two longs, some 60 MB as a hashed relation.

MAX_FILTER_BITS = 1 << 27


def filter_bits(rows: int, per_row: int = 16, most: int = MAX_FILTER_BITS) -> int:
    """Slots for ``rows`` keys, a power of two; past ``most`` only false alarms grow."""
    return min(most, 1 << max(12, (max(1, rows) * per_row - 1).bit_length()))


def _slots(key: Column, bits: int) -> list[Column]:
    mask = F.lit(bits - 1).cast("long")
    return [F.xxhash64(key, F.lit(seed)).bitwiseAND(mask) for seed in (11, 29)]


def _to_words(slots: DataFrame) -> DataFrame:
    return slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("bits")
    )


def member_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Filter that every key of ``keys`` passes."""
    return _to_words(keys.select(F.explode(F.array(*_slots(F.col(key), bits))).alias("slot")))


def repeat_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Filter that every key with two rows or more passes: slots hit at least twice."""
    slots = keys.select(F.explode(F.array(*_slots(F.col(key), bits))).alias("slot"))
    return _to_words(slots.groupBy("slot").count().where("count > 1"))


def with_flag(rows: DataFrame, words: DataFrame, key: Column, bits: int, flag: str) -> DataFrame:
    """``rows`` and a boolean: may its key be in the filter? No row moves."""
    out, hits = rows, []
    for i, slot in enumerate(_slots(key, bits)):
        word, hit = free_name(out, f"word_{i}"), free_name(out, f"hit_{i}")
        side = F.broadcast(words.select(F.col("word").alias(word), F.col("bits").alias(hit)))
        at = slot.bitwiseAND(F.lit(63).cast("long")).cast("int")
        out = out.join(side, F.shiftright(slot, 6) == F.col(word), "left").drop(word)
        out = out.withColumn(hit, F.coalesce(F.call_function("getbit", hit, at) == 1, F.lit(False)))
        hits.append(hit)
    return out.withColumn(flag, F.col(hits[0]) & F.col(hits[1])).drop(*hits)


# ---- components ------------------------------------------------------------------------------


def components(edges: DataFrame, cut) -> DataFrame:
    """(a, b) links -> (id, component): smallest id reachable, for every id that has a link.

    Alternating large and small stars: each step is one aggregation and one join on narrow
    rows and every step is written, so no lineage grows and no link meets the driver. Hot
    nodes shrink to their star in the first steps.
    """
    now = cut(edges.where("a <> b").select("a", "b").distinct(), "links")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct(), "links")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
        )
        now = cut(small.where("a <> b").distinct(), "links")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    members = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = members.select(F.col("component").alias("id"), "component").distinct()
    return members.unionByName(roots)


# ---- text helpers inside tasks ---------------------------------------------------------------


def slices(items: Iterable, weight, most: int) -> Iterator[list]:
    """Lists of consecutive items whose weights add up to about ``most``."""
    held, total = [], 0
    for item in items:
        held.append(item)
        total += weight(item)
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Exclusive prefix sums."""
    out = np.zeros(len(lengths), np.int64)
    if len(lengths) > 1:
        np.cumsum(lengths[:-1], out=out[1:])
    return out
