"""Files of raw bytes through Spark's own writers and readers, in any store Spark can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bytes(rows: DataFrame, path: str, last: bytes, part: str | None = None, gzip: bool = False) -> None:
    """Write the binary column ``content``, row after row, as files of nothing but these bytes.

    Every row must end with the byte ``last``: the text writer, which needs a line end, puts it
    back. With ``part`` rows go to one folder per value; with ``gzip`` each file is compressed.
    """
    body = F.expr("cast(substring(content, 1, length(content) - 1) AS string)").alias("value")
    out = rows.select(*([part] if part else []), body)
    writer = out.write.option("lineSep", last.decode("ascii")).option("compression", "gzip" if gzip else "none")
    (writer.partitionBy(part) if part else writer).text(path)


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file below ``path``, as it lies there; a file is one row."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt{,.gz}").load(path)
    return found.select("path", "content")
