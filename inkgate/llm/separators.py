"""Token counts of records in flat token files by a scan for end-of-document identifiers.

The files hold nothing but ids of one width: no index, no header. Blocks are searched as whole
arrays; what a block leaves open is closed by the first separator after it, found by running
sums over blocks in a file and over files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkgate.llm.common import records, slices
from inkgate.llm.files import read_bytes, write_bytes
from inkgate.llm.tokens import encoder, vocabulary_size
from inkgate.session import cut

BLOCK_IDS = 1 << 20


def write_token_files(
    enriched_records: DataFrame,
    tokenizer: str,
    path: str,
    *,
    job_id: str = "job_id",
    cleaned_text: str = "cleaned_text",
    separator: int = 50256,
    width: str = ">u2",
) -> None:
    """Ids of every record and the separator after each, in the order of the rows' partitions.

    One file per partition, in the order of the partitions' numbers; nothing shuffles. ``width``
    is the type of an id and must hold all of the tokenizer's; the separator's last byte must be
    ASCII. Null and empty texts are a separator alone, repeated rows are records of their own; no
    rows give no ids. Other columns are ignored.
    """
    table = records(enriched_records, job_id, cleaned_text).select("cleaned_text")
    last = np.array([separator], width).tobytes()[-1:]
    if last > b"\x7f" or np.array([separator], width)[0] != separator:
        raise ValueError(f"separator {separator} cannot be written as {width}")
    if vocabulary_size(tokenizer) > 1 << 8 * np.dtype(width).itemsize:
        raise ValueError(f"ids of {tokenizer} cannot be written as {width}")

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = encoder(tokenizer)
        for frame in frames:
            for some in slices(frame["cleaned_text"], len, 1_000_000):
                found = (np.append(np.frombuffer(x, "<u4"), separator).astype(width).tobytes() for x in ids_of(some))
                yield pd.DataFrame({"content": list(found)})

    write_bytes(table.mapInPandas(encode, "content binary"), path, last)


def block_ends(ids: np.ndarray, separator: int, block: int = BLOCK_IDS) -> np.ndarray:
    """Places of the separators, block by block."""
    found = [np.flatnonzero(ids[at : at + block] == separator) + at for at in range(0, len(ids), block)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def token_counts(spark: SparkSession, path: str, *, separator: int = 50256, width: str = ">u2") -> DataFrame:
    """One row per record: file, turn (in that file), start, n_tokens, closed.

    ``start`` counts all ids of the corpus before the record, ``n_tokens`` its ids without the
    separator. A record belongs to the file of its last id, and may have begun in earlier ones.
    Ids after the last separator are a record that is not ``closed``. Empty files have no record.
    Files are ordered by path; a file must fit in a task's memory and hold whole ids.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                ids = np.frombuffer(content, width)
                yield pd.DataFrame({"file": [file], "n_ids": [len(ids)], "ends": pd.Series([block_ends(ids, separator)], dtype=object)})

    found = cut(read_bytes(spark, path).mapInPandas(scan, "file string, n_ids long, ends array<long>"), "ends")
    # one narrow row per file; the last separator of each file, in places of the corpus
    sizes = found.select("file", "n_ids", F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("end"))
    files = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("base", F.coalesce(F.sum("n_ids").over(files), F.lit(0)))
    base = base.withColumn("open", F.coalesce(F.max(F.col("base") + F.col("end") + 1).over(files), F.lit(0)))
    base = base.withColumn("total", F.sum("n_ids").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    both = found.drop("n_ids").join(base.drop("end"), "file")
    place = both.select("file", "base", "open", "ends", F.posexplode("ends").alias("turn", "end"))
    before = F.when(F.col("turn") == 0, F.col("open")).otherwise(F.col("base") + F.try_element_at("ends", F.col("turn")) + 1)
    closed = place.select(
        "file", "turn", before.alias("start"), (F.col("base") + F.col("end") - before).alias("n_tokens"), F.lit(True).alias("closed")
    )
    after = F.coalesce(F.col("base") + F.try_element_at("ends", F.lit(-1)) + 1, F.col("open"))
    tail = both.where((F.col("base") + F.col("n_ids") == F.col("total")) & (F.col("n_ids") > 0) & (after < F.col("total")))
    return closed.unionByName(
        tail.select("file", F.size("ends").alias("turn"), after.alias("start"), (F.col("total") - after).alias("n_tokens"), F.lit(False).alias("closed"))
    )
