"""Language of a text from character trigrams.

Profiles are learned from labelled texts: every trigram of each language with a whole-number log
weight, one row per trigram and language. Scoring counts a text's trigrams inside its task, joins
the counts with the profiles and adds up. Neither the trigrams nor the languages are limited; the
join is left to AQE's size checks.

A trigram is one number: three code points of 21 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgate.session import cut

WEIGHT_SCALE = 1_000_000
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Profiles:
    """``table(gram, lang, base, extra)``, in long form.

    ``base`` is the language's weight of a trigram it never has, ``extra`` what its own count adds.
    Only trigrams that a language has are rows, but the language with the greatest ``base`` has a
    row for every known trigram: no language without any of a text's trigrams scores higher.
    """

    table: DataFrame


def _row_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count) of the trigrams of some texts, each text's for itself."""
    rows, grams, counts = [], [], []
    for row, text in enumerate(texts):
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if len(points) < 3:
            continue
        found, n = np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)
        rows.append(np.full(len(found), row))
        grams.append(found)
        counts.append(n)
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(rows), np.concatenate(grams), np.concatenate(counts)


def _grams(df: DataFrame, text: str, keep: str) -> DataFrame:
    """(keep, gram, n): how often each row's text has each of its trigrams. No row moves."""
    kind = df.schema[keep].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                row, gram, n = _row_counts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(gram), pa.array(n.astype(np.int64))], names=[keep, "gram", "n"]
                )

    lower = df.select(F.col(keep), F.lower(F.col(text)).alias("_text"))
    return lower.mapInArrow(count, f"`{keep}` {kind}, gram long, n long")


def learn_profiles(labelled: DataFrame, *, text: str = "text", label: str = "lang") -> Profiles:
    named = labelled.select(F.col(label).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL")
    counts = cut(_grams(named, "text", "lang").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    vocabulary = counts.select("gram").distinct()
    n_grams = vocabulary.count()

    def weight(count):
        return F.round(F.log(count / (F.col("total") + n_grams)) * WEIGHT_SCALE).cast("bigint")

    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).withColumn("base", weight(F.lit(1)))
    totals = cut(totals, "totals")
    extra = (weight(F.col("n") + 1) - F.col("base")).alias("extra")
    rows = counts.join(totals, "lang").select("gram", "lang", "base", extra)
    widest = totals.orderBy(F.desc("base"), "lang").select("lang", "base").limit(1)
    seen = counts.join(widest, "lang", "left_semi").select("gram")
    rest = vocabulary.join(seen, "gram", "left_anti").crossJoin(widest)
    return Profiles(
        cut(rows.unionByName(rest.withColumn("extra", F.lit(0).cast("bigint"))), "profiles")
    )


def detect_language(
    df: DataFrame, profiles: Profiles, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, language): the best scoring language, by name on ties.

    Texts without any known trigram are ``unknown``.
    """
    counted = _grams(df, text, key)
    sums = (
        counted.join(profiles.table, "gram")
        .groupBy(key, "lang")
        .agg(F.sum(F.col("n") * F.col("extra")).alias("extra"), F.sum("n").alias("n"), F.max("base").alias("base"))
    )
    # the language that has rows for every known trigram counts them all
    known = F.max("n").over(Window.partitionBy(key))
    score = F.col("extra") + known * F.col("base")
    winners = sums.select(key, "lang", score.alias("score")).groupBy(key).agg(
        F.min(F.struct((-F.col("score")).alias("s"), "lang")).alias("best")
    )
    winners = winners.select(key, F.col("best.lang").alias("language"))
    return (
        df.select(key)
        .join(winners, key, "left")
        .select(key, F.coalesce("language", F.lit(UNKNOWN)).alias("language"))
    )
