"""Lookups by a key that must name one row at most: a second row fails the job, none gives nulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(left: str, right: str, keys: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}") == F.col(f"{right}.{k}") for k in keys))


def at_most_one(table: DataFrame, *keys: str) -> DataFrame:
    """``table`` with the promise that no key has two rows, held while the rows are read.

    One aggregation that is combined before the shuffle; keys that hold a null name nothing and
    are left out.
    """
    named = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    rest = [c for c in table.columns if c not in keys]
    message = F.concat(F.lit(f"more than one row for {', '.join(keys)} = "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys)))
    one = table.where(named).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*keys, *rest)).alias("_row"))
    sound = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(message))
    return one.select(sound.alias("_row")).select(*(F.col(f"_row.{c}").alias(c) for c in table.columns))


def look_up(requests: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """Every request with the row of ``table`` that its keys name, or nulls.

    Only rows that some request names are counted: a double row nobody asks for fails nothing. A
    key that very many requests share is one row on the other side, so the join may be split.
    """
    asked = requests.select(*keys).distinct()
    found = at_most_one(table.join(asked, list(keys), "left_semi"), *keys)
    return requests.join(found, list(keys), "left")
