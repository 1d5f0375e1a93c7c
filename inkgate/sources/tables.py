"""Append-only tables in a folder, safe against replays of a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def append(df: DataFrame, root: str, name: str) -> None:
    """Append rows in their current order of columns."""
    df.write.mode("append").parquet(table_path(root, name))


def append_batch(df: DataFrame, root: str, name: str, batch_id: int, by: tuple[str, ...] = ()) -> None:
    """Write a micro-batch as its own partition, parted further ``by`` columns; replaying the batch
    replaces it.

    The old partition goes first: a replay without rows must leave none behind.
    """
    spark = df.sparkSession
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{table_path(root, name)}/batch_id={batch_id}")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    (
        df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id", *by)
        .parquet(table_path(root, name))
    )


def read_table(
    spark: SparkSession, root: str, name: str, schema: T.StructType | str
) -> DataFrame:
    """The table so far; an empty frame before its first write."""
    path = table_path(root, name)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_before(
    spark: SparkSession, root: str, name: str, schema: T.StructType, batch_id: int
) -> DataFrame:
    """Rows that batches before ``batch_id`` wrote: what a replay must see again."""
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    table = read_table(spark, root, name, with_batch)
    return table.where(F.col("batch_id") < batch_id).drop("batch_id")
