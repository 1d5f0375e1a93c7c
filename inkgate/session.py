"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "inkgate", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; sizes stay with the cluster."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # repeated keys in a model response: the last one wins, as in a plain dict
        "spark.sql.variant.allowDuplicateKeys": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; else one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    # The warehouse is shared too; a machine's own temp folder would not be.
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/inkgate/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path nobody uses yet, in the folder that ``scratch`` or ``drop_written`` removes."""
    return f"{_scope.get() or _own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    Lineage ends here, later steps read only the columns they need, and a lost executor
    costs a re-read rather than a re-run. The files stay until ``scratch`` or
    ``drop_written`` removes them.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside the block are removed at its end; write the results before."""
    folder = f"{_own_folder(spark)}/scratch-{uuid.uuid4().hex}"
    token = _scope.set(folder)
    try:
        yield
    finally:
        _scope.reset(token)
        _delete(spark, folder)


def drop_written(spark: SparkSession) -> None:
    """Remove every table this application cut. Frames built on them can no longer be read."""
    _delete(spark, _own_folder(spark))


def spread(table: DataFrame, key: str) -> DataFrame:
    """Deal a freshly read table out to all cores when it comes in fewer splits than that.

    Work inside rows (hashing, cleaning, word lists) then uses the whole cluster. A large
    table has more splits than there are cores and is left as it is.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= cores:
        return table
    return table.repartition(cores, key)
