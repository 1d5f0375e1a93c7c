"""Best text out of several extraction attempts.

Attempts are tried by rank until one gives enough text. Every attempt that works replaces
the one before, even by a shorter text; one that fails changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgate.config import ExtractionRules
from inkgate.functions import text as tx
from inkgate.operators.hooks import run_extractor, still_thin
from inkgate.session import cut


def _result(text: Column, extractor: Column, rules: ExtractionRules) -> Column:
    found = F.coalesce(text, F.lit(""))
    chars = tx.char_count(found)
    return F.struct(
        F.lit(True).alias("passed"),
        F.when(chars >= rules.min_usable_text, found).otherwise("").alias("text"),
        F.coalesce(extractor, F.lit("")).alias("extractor_used"),
        chars.alias("char_count"),
        F.lit("").alias("rejection_reason"),
    )


def from_attempts(
    attempts: DataFrame, rules: ExtractionRules | None = None, *, key: str = "job_id"
) -> DataFrame:
    """(key, rank, extractor, text, error) rows -> one ``extraction`` struct per key.

    The winner is the first working attempt with enough text, else the last working one. One
    sort key says both, so each partial result holds a single text.
    """
    rules = rules or ExtractionRules()
    worked = F.col("error").isNull() & F.col("text").isNotNull()
    pick = F.struct("text", "extractor")
    enough = worked & (F.length("text") >= rules.min_text_for_ocr)
    preference = F.when(
        worked,
        F.when(enough, F.struct(F.lit(0).alias("late"), F.col("rank").alias("rank"))).otherwise(
            F.struct(F.lit(1).alias("late"), (-F.col("rank")).alias("rank"))
        ),
    )
    chosen = attempts.groupBy(key).agg(F.min_by(pick, preference).alias("_best"))
    return chosen.select(
        key, _result(F.col("_best.text"), F.col("_best.extractor"), rules).alias("extraction")
    )


Loader = Callable[[], Callable[[bytes, str], str]]


def is_column(extractor: Column | Loader) -> bool:
    return isinstance(extractor, Column)


def extract_in_passes(
    files: DataFrame,
    extractors: Sequence[tuple[str, Column | Loader]],
    rules: ExtractionRules | None = None,
) -> DataFrame:
    """(job_id, extraction) of files(job_id, filename, content, ...), extractors tried by rank.

    A run of text columns is one pass over the rows, without Python. Every other extractor is a
    loader (see ``hooks.run_extractor``) and gets a pass of its own, over the files that no pass
    before gave enough text: a costly one never sees the rest. Each pass writes its attempts, so
    none runs twice.
    """
    rules = rules or ExtractionRules()
    attempts, done = None, 0
    while done < len(extractors):
        columns = list(takewhile(lambda e: is_column(e[1]), extractors[done:]))
        thin = files if attempts is None else still_thin(files, attempts, rules.min_text_for_ocr)
        if columns:
            rows = [
                F.struct(F.lit(done + i).alias("rank"), F.lit(name).alias("extractor"), text.alias("text"))
                for i, (name, text) in enumerate(columns)
            ]
            found = thin.select("job_id", F.explode(F.array(*rows)).alias("a")).select(
                "job_id",
                "a.*",
                F.when(F.col("a.text").isNull(), "no text").alias("error"),
            )
            done += len(columns)
        else:
            name, load = extractors[done]
            found = run_extractor(thin, done, name, load)
            done += 1
        found = cut(found, "attempts")
        attempts = found if attempts is None else attempts.unionByName(found)
    return from_attempts(attempts, rules)


def extract_in_row(
    df: DataFrame,
    extractors: Sequence[tuple[str, Column]],
    rules: ExtractionRules | None = None,
    *,
    reached: Column | None = None,
) -> DataFrame:
    """Add ``extraction`` from text expressions in rank order, without a shuffle.

    Each extractor is (name, text column), NULL meaning that it failed; a pandas UDF column
    works as well as a built-in one.
    """
    rules = rules or ExtractionRules()
    names = []
    for rank, (name, text) in enumerate(extractors):
        names.append((f"_text{rank}", name))
        df = df.withColumn(f"_text{rank}", text)
    # reversed: the last working attempt stands unless an earlier one was long enough
    last_text, last_name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for column, name in names:
        last_text = F.coalesce(F.col(column), last_text)
        last_name = F.when(F.col(column).isNotNull(), F.lit(name)).otherwise(last_name)
    best_text, best_name = last_text, last_name
    for column, name in reversed(names):
        enough = F.length(column) >= rules.min_text_for_ocr
        best_text = F.when(enough, F.col(column)).otherwise(best_text)
        best_name = F.when(enough, F.lit(name)).otherwise(best_name)
    result = _result(best_text, best_name, rules)
    if reached is not None:
        result = F.when(reached, result)
    return df.withColumn("extraction", result).drop(*[column for column, _ in names])
