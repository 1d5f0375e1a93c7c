"""Output names in camelCase, at every level of a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def camel(name: str) -> str:
    head, *tail = name.split("_")
    return head + "".join(part[:1].upper() + part[1:] for part in tail)


def _renamed(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType(
            [T.StructField(camel(f.name), _renamed(f.dataType), f.nullable) for f in kind]
        )
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_renamed(kind.elementType), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _renamed(kind.valueType), kind.valueContainsNull)
    return kind


def camel_case(df: DataFrame) -> DataFrame:
    """The same rows under camelCase names; struct fields are renamed by a cast."""
    return df.select(
        *[F.col(f.name).cast(_renamed(f.dataType)).alias(camel(f.name)) for f in df.schema]
    )


def as_json_items(df: DataFrame, output: str = "item") -> DataFrame:
    """One JSON object per row, NULL fields written out."""
    named = camel_case(df)
    whole = F.struct(*[F.col(f"`{c}`") for c in named.columns])
    return named.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias(output))
