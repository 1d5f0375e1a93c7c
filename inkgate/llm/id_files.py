"""Token ids in files of canonical, length-limited Huffman code.

A file is a run of blocks. A block stands alone: its header names its records, their lengths and
the bit offset of every ``STRIDE``-th id, so that decoding starts anywhere and many stretches of
a block are decoded at once by table look-up. The code book is the list of code lengths: with
canonical codes that says everything.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from inkgate.llm.common import ids_as_text, records, scratch_path, slices, starts_of
from inkgate.llm.files import read_bytes, write_bytes
from inkgate.llm.tokens import encoder, vocabulary_size

STRIDE = 256
BLOCK_IDS = 1 << 17
# Pieces of text that a worker remembers: some 200 bytes each.
KNOWN_PIECES = 800_000
# magic, bytes of the block, first id's place in the corpus, records, ids, bytes of keys, of bits
_HEAD = "<4sIQIIII"
_MAGIC = b"IDH1"


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Lengths of an optimal prefix code with none over ``longest`` (0: id does not occur).

    Package-merge: on each level the ids, rarest first, are merged with pairs of the level
    before; how often an id is among the cheapest ``2 n - 2`` items gives its length.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids need codes longer than {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(longest - 1):
        even = len(level) // 2 * 2
        both = np.concatenate([leaves, level[:even:2] + level[1:even:2]])
        by = np.argsort(both, kind="stable")
        level = both[by]
        is_leaf.append(by < len(leaves))
    take, found = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for flags in reversed(is_leaf):
        chosen = int(flags[:take].sum())
        found[:chosen] += 1
        take = 2 * (take - chosen)
    lengths[order] = found
    return lengths


def canonical_codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes by id, ids in order of their codes, and the longest length."""
    longest = int(lengths.max(initial=1))
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    width = (1 << (longest - lengths[order].astype(np.int64))).astype(np.int64)
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (starts_of(width) >> (longest - lengths[order].astype(np.int64))).astype(np.uint64)
    return codes, order, longest


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of ``ids``, and the bit offset of every ``STRIDE``-th id."""
    size = lengths[ids].astype(np.int64)
    if not size.all():
        raise ValueError("an id has no code")
    at = starts_of(size)
    total = int(size.sum())
    word, room = at >> 6, 64 - (at & 63) - size
    code = codes[ids]
    words = np.zeros((total >> 6) + 2, np.uint64)
    high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    if len(ids):
        words[word[first]] = np.bitwise_or.reduceat(high, first)
    over = room < 0
    words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (total + 7) // 8], at[::STRIDE]


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and code length for every value of the next ``longest`` bits."""
    _, order, longest = canonical_codes(lengths)
    width = 1 << (longest - lengths[order].astype(np.int64))
    rest = (1 << longest) - int(width.sum())
    ids = np.concatenate([np.repeat(order, width), np.zeros(rest, np.int64)]).astype(np.uint32)
    sizes = np.concatenate([np.repeat(lengths[order], width), np.ones(rest, np.uint8)])
    return ids, sizes, longest


def decode_bits(data: np.ndarray, at: np.ndarray, counts: np.ndarray, table: tuple) -> np.ndarray:
    """Ids of all stretches one after another; stretch i has ``counts[i]`` ids from bit ``at[i]``.

    ``data`` ends with at least four spare bytes. All stretches advance by one id per step.
    """
    symbols, sizes, longest = table
    out = np.zeros(int(counts.sum()), np.uint32)
    order = np.argsort(-counts, kind="stable")
    to, at, counts = starts_of(counts)[order], at[order].astype(np.int64), counts[order]
    live = len(order)
    for step in range(int(counts[0]) if len(counts) else 0):
        while counts[live - 1] <= step:
            live = int(np.searchsorted(-counts, -step, "left"))
        here = at[:live]
        byte = here >> 3
        bits = data[byte].astype(np.uint32) << 24
        bits |= data[byte + 1].astype(np.uint32) << 16
        bits |= data[byte + 2].astype(np.uint32) << 8
        bits |= data[byte + 3]
        look = (bits << (here & 7).astype(np.uint32)) >> np.uint32(32 - longest)
        out[to[:live] + step] = symbols[look]
        at[:live] += sizes[look]
    return out


def pack_block(start: int, keys: list, ids: list[np.ndarray], codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """One block: header, keys, record lengths, checkpoints, bits, checksum, line end."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    bits, marks = encode_bits(flat, codes, lengths)
    names = json.dumps(keys).encode()
    body = names + np.array([len(x) for x in ids], "<u4").tobytes() + marks.astype("<u8").tobytes() + bits
    size = struct.calcsize(_HEAD) + len(body) + 5
    block = struct.pack(_HEAD, _MAGIC, size, start, len(keys), len(flat), len(names), len(bits)) + body
    return block + struct.pack("<I", zlib.crc32(block)) + b"\n"


def unpack_blocks(content: bytes, table: tuple) -> Iterator[tuple]:
    """(key, place of its first id in the corpus, ids) of every record of a file."""
    held, at = [], 0
    while at < len(content):
        magic, size, *rest = struct.unpack_from(_HEAD, content, at)
        if magic != _MAGIC or struct.unpack_from("<I", content, at + size - 5)[0] != zlib.crc32(content[at : at + size - 5]):
            raise ValueError(f"damaged block at byte {at}")
        held.append((at + struct.calcsize(_HEAD), *rest))
        at += size
    for part in slices(held, lambda h: h[3], 8 * BLOCK_IDS):
        yield from _unpack(content, part, table)


def _unpack(content: bytes, part: list, table: tuple) -> Iterator[tuple]:
    streams, marks, counts, heads, shift = [], [], [], [], 0
    for at, start, n_keys, n_ids, n_names, n_bits in part:
        keys = json.loads(content[at : at + n_names])
        at += n_names
        sizes = np.frombuffer(content, "<u4", n_keys, at).astype(np.int64)
        at += 4 * n_keys
        n_marks = -(-n_ids // STRIDE)
        marks.append(np.frombuffer(content, "<u8", n_marks, at).astype(np.int64) + 8 * shift)
        at += 8 * n_marks
        streams.append(content[at : at + n_bits])
        shift += n_bits
        counts.append(np.minimum(STRIDE, n_ids - STRIDE * np.arange(n_marks)))
        heads.append((start, keys, sizes))
    data = np.frombuffer(b"".join([*streams, bytes(8)]), np.uint8)
    ids = decode_bits(data, np.concatenate(marks), np.concatenate(counts), table)
    at = 0
    for start, keys, sizes in heads:
        for key, size in zip(keys, sizes.tolist(), strict=True):
            yield key, start, ids[at : at + size]
            at += size
            start += size


def write_id_files(
    enriched_records: DataFrame,
    tokenizer: str,
    path: str,
    *,
    job_id: str = "job_id",
    cleaned_text: str = "cleaned_text",
    end_id: int = 2,
) -> None:
    """Encode every record, close it by ``end_id`` and write all ids in ascending order of job id.

    ``path`` gets one folder per range of job ids and a code book. Null and empty texts are a
    single end id; equal job ids follow each other; a null job id comes first. No rows: no
    folders and an empty code book. Other columns are ignored.

    Texts shuffle once, into ranges; code counts and range totals are all that meets the driver
    (as many numbers as the vocabulary has ids, and as there are ranges).
    """
    table = records(enriched_records, job_id, cleaned_text)
    spark = table.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = isinstance(table.schema["job_id"].dataType, IntegralType)
    vocabulary = max(vocabulary_size(tokenizer), end_id + 1)
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, start = encoder(tokenizer, KNOWN_PIECES), TaskContext.get().partitionId(), 0
        sums = np.zeros(vocabulary, np.int64)
        for frame in frames:
            rows = zip(frame["job_id"], frame["cleaned_text"], strict=True)
            for some in slices(rows, lambda r: len(r[1]), 1_000_000):
                found = [
                    np.append(np.frombuffer(ids, "<u4"), end_id).astype(width)
                    for ids in encode([t for _, t in some])
                ]
                sizes = np.array([len(x) for x in found], np.int64)
                sums += np.bincount(np.concatenate(found), minlength=vocabulary)
                yield pd.DataFrame(
                    {
                        "job_id": [k for k, _ in some],
                        "part": part,
                        "start": start + starts_of(sizes),
                        "n": sizes,
                        "ids": [x.tobytes() for x in found],
                        "counts": None,
                    }
                )
                start += int(sizes.sum())
        # behind the records, one row of what the task counted
        counted = sums.astype("<u8").tobytes()
        yield pd.DataFrame({"job_id": [None], "part": part, "start": start, "n": 0, "ids": [None], "counts": [counted]})

    ordered = table.repartitionByRange(ranges, "job_id").sortWithinPartitions("job_id")
    held = scratch_path(spark, "ids")
    # zstd: ids of a large corpus are written once and read again
    schema = "job_id string, part int, start long, n long, ids binary, counts binary"
    ids_as_text(ordered, "job_id").mapInPandas(tokens, schema).write.option("compression", "zstd").parquet(held)
    written = spark.read.schema(schema).parquet(held)
    encoded = written.where("counts IS NULL").drop("counts")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(vocabulary, np.int64)
        for frame in frames:
            for counted in frame["counts"]:
                sums += np.frombuffer(counted, "<u8").astype(np.int64)
        used = np.flatnonzero(sums)
        yield pd.DataFrame({"id": used, "n": sums[used]})

    counted = written.select("counts").where("counts IS NOT NULL")
    total = counted.mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, np.int64)
    for row in total.collect():
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts, max(16, vocabulary.bit_length() + 1))
    codes, _, _ = canonical_codes(lengths)
    sums = encoded.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    first = dict(zip((r["part"] for r in sums), starts_of(np.array([r["n"] for r in sums], np.int64)).tolist(), strict=True))
    sent = spark.sparkContext.broadcast((codes, lengths, first))

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, lengths, first = sent.value
        for frame in frames:
            # rows of one task follow each other, but a task may hold rows of several ranges
            for part, rows in frame.groupby("part", sort=False):
                triples = zip(rows["job_id"], rows["start"], rows["ids"], strict=True)
                for some in slices(triples, lambda r: len(r[2]) // 2, BLOCK_IDS):
                    start = first[part] + int(some[0][1])
                    ids = [np.frombuffer(x, width).astype(np.int64) for _, _, x in some]
                    keys = [None if k is None else int(k) if whole else k for k, _, _ in some]
                    yield pd.DataFrame({"part": [part], "start": [start], "content": [pack_block(start, keys, ids, codes, lengths)]})

    out = encoded.mapInPandas(blocks, "part int, start long, content binary")
    write_bytes(out.sortWithinPartitions("part", "start"), f"{path}/ids", b"\n", "part")
    book = zlib.compress(lengths.tobytes()) + b"\n"
    write_bytes(spark.createDataFrame([(bytearray(book),)], "content binary"), f"{path}/codes", b"\n")


def read_id_files(spark: SparkSession, path: str, job_id_type: str = "long") -> DataFrame:
    """One row per record of the files: job_id, start, ids (little-endian unsigned 32-bit).

    Job ids are integers or strings, null where there was none; empty texts are an end id alone.
    Files without records give no rows.
    """
    book = b"".join(r["content"] for r in read_bytes(spark, f"{path}/codes").collect())
    lengths = np.frombuffer(zlib.decompress(book[:-1]), np.uint8)
    sent = spark.sparkContext.broadcast(lengths)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = decode_table(sent.value)
        for frame in frames:
            for content in frame["content"]:
                found = unpack_blocks(content, table)
                for some in slices(found, lambda r: len(r[2]), 2_000_000):
                    yield pd.DataFrame(
                        {
                            "job_id": pd.array([k for k, _, _ in some], "string" if job_id_type == "string" else "Int64"),
                            "start": [s for _, s, _ in some],
                            "ids": [x.astype("<u4").tobytes() for _, _, x in some],
                        }
                    )

    return read_bytes(spark, f"{path}/ids").select("content").mapInPandas(
        read, f"job_id {job_id_type}, start long, ids binary"
    )
