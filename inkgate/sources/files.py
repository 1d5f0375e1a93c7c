"""Files as rows, in batch or as they arrive."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgate import fixed_values as fv
from inkgate.operators.first_wins import number_in_order
from inkgate.session import cut

BINARY_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

# Bytes of files that a task reads, about.
TASK_BYTES = 64 * 2**20


def as_uploads(binary_files: DataFrame, *, arrival: Column | None = None) -> DataFrame:
    """(job_id, arrival, filename, content, length) from binary-file rows.

    Job ids are derived from path and time, so a re-run names the same file alike. Files
    arrive in the order of their modification time, or of the numbers in ``arrival``; the job id
    breaks ties downstream.
    """
    name = F.element_at(F.split("path", "/"), -1)
    time = F.unix_micros("modificationTime")
    return binary_files.select(
        F.sha2(F.concat_ws(":", "path", time.cast("string")), 256).alias("job_id"),
        (time if arrival is None else arrival).alias("arrival"),
        F.coalesce(F.nullif(name, F.lit("")), F.lit(fv.UNNAMED_FILE)).alias("filename"),
        "content",
        "length",
    )


def _within(found: DataFrame, limit: int | None) -> DataFrame:
    """Bodies up to ``limit`` bytes; a larger file is a row without one, known by its listing.

    The size condition and the choice of columns reach the file source: bodies above the limit
    are not opened.
    """
    if limit is None:
        return found
    small = _many_a_task(found.where(F.col("length") <= limit), found)
    large = _many_a_task(found.where(F.col("length") > limit).drop("content"), found)
    return small.unionByName(large.withColumn("content", F.lit(None).cast("binary")))


def _many_a_task(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` of the files ``found`` with about ``TASK_BYTES`` of these to a task, or more tasks: Spark counts
    each file as some MB, so a folder of small ones would be as many tasks."""
    in_all = int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = found.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(max(8 * cores, math.ceil(in_all / TASK_BYTES)))


def _mounted(spark: SparkSession, folder: str) -> str | None:
    """Where machines find ``folder`` as one of their own folders; None where only Spark reaches it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)
    return path.toUri().getPath() if path.toUri().getScheme() == "file" else None


def write_apart(lines: DataFrame, key: str, folder: str) -> None:
    """lines(key, value): a text file of its own for each key, all in one folder, without one
    folder more for each of them to make, commit and list. Equal keys share a file.

    Tasks move their own files into place, so the driver does not move them one after another. Into a
    mounted folder they write from Python, as Hadoop starts a ``chmod`` for each file and for each one's
    checksums; a task that is tried again puts the same files in the same places.
    """
    whole = lines.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("value")), "\n").alias("value"))
    inside = _mounted(lines.sparkSession, folder)
    if inside is None:
        (
            whole.select("value")
            .write.option("maxRecordsPerFile", 1)
            .option("mapreduce.fileoutputcommitter.algorithm.version", 2)
            .text(folder)
        )
        return
    os.makedirs(inside)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist(), strict=True):
                own = f"{inside}/_{uuid.uuid4().hex}"
                with open(own, "wb") as file:
                    file.write(body + b"\n")
                os.replace(own, f"{inside}/part-{name}.txt")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    # keys may hold anything, or be null
    name = F.sha2(F.concat(F.col(key).isNull().cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    bodies = whole.select(name.alias("name"), F.col("value").cast("binary").alias("body"))
    bodies.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def read_files(
    spark: SparkSession,
    folder: str,
    *,
    pattern: str | None = None,
    listing: DataFrame | None = None,
    limit: int | None = None,
    by_path: bool = False,
) -> DataFrame:
    """Every file of a folder as one upload.

    ``limit`` is the largest size that reception lets pass (``FormatRules.max_file_size_bytes``):
    larger files are listed, not read. With ``by_path`` files arrive in the order of their paths
    instead of their times; their number then is their place in that order, gaps included.

    Spark's file sources leave out files of length zero. Where those matter (they are to be
    rejected as empty), pass a ``listing(path, modificationTime, length)`` of the folder, such
    as a storage inventory; its empty files are added.
    """
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    found = _within(reader.load(folder), limit)
    if listing is not None:
        empty = listing.where(F.col("length") == 0).select(
            "path", "modificationTime", "length", F.lit(b"").alias("content")
        )
        found = found.unionByName(empty)
    if not by_path:
        return as_uploads(found)
    # paths are put in order without their bodies
    places = cut(number_in_order(found.select(F.col("path").alias("named")), "named"), "paths")
    return as_uploads(found.join(places, F.col("path") == F.col("named")), arrival=F.col("number"))


def stream_files(
    spark: SparkSession, folder: str, *, pattern: str | None = None, per_batch: int = 10_000
) -> DataFrame:
    """Uploads as files land in a folder. Bodies are read with their listing here."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_SCHEMA)
        .option("maxFilesPerTrigger", per_batch)
    )
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return as_uploads(reader.load(folder))
