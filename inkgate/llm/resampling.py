"""Importance resampling of records towards target texts: hashed n-grams, Gumbel top-k, radix ranks.

Word n-grams of the records and of the target texts fall into a fixed number of buckets. The log
ratio of the two distributions is one array; a record's weight is the sum of the array over its
n-grams. Weights with Gumbel noise are drawn from the top: a distributed radix sort over the
digits of (score, id), least significant first, numbers the records. Each pass counts digits by
block, turns the counts into offsets by prefix sums, and deals every row to its destination.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgate.llm.common import records
from inkgate.session import cut

BUCKETS = 10_000
NGRAM_WORDS = 3
# Bytes and words worked on at once inside a task.
SLICE_BYTES = 2_000_000
SLICE_WORDS = 300_000

# ---- checksums of n-grams --------------------------------------------------------------------
#
# crc32(a + b) is crc32(a), shifted by the bytes of b, xor crc32(b). Shifts are linear: one table
# of 4 x 256 entries for each power of two of bytes, and for each short length.

_SHORT = 64
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[0x30:0x3A] = _WORD_BYTE[0x61:0x7B] = _WORD_BYTE[0x80:] = True


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1).astype(np.uint32)
    return table


_BYTE = _byte_table()


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = table[0][crc & 255]
    for i in (1, 2, 3):
        out = out ^ table[i][(crc >> np.uint32(8 * i)) & 255]
    return out


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    places = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    one = _BYTE[places & 255] ^ (places >> 8)
    powers, short = [one], [places, one]
    for _ in range(31):
        powers.append(_apply(powers[-1], powers[-1]))
    for _ in range(_SHORT - 1):
        short.append(_apply(one, short[-1]))
    return np.array(powers), np.array(short)


_POWERS, _SHIFTS = _shift_tables()
_FLAT = [np.ascontiguousarray(_SHIFTS[:, i]).ravel() for i in range(4)]


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums moved on by as many bytes as ``length`` says."""
    at = np.minimum(length, _SHORT).astype(np.int64) << 8
    out = _FLAT[0][at + (crc & 255)]
    for i in (1, 2, 3):
        out ^= _FLAT[i][at + ((crc >> np.uint32(8 * i)) & 255)]
    for row in np.flatnonzero(length > _SHORT):
        c, left = out[row : row + 1], int(length[row]) - _SHORT
        for bit, table in enumerate(_POWERS):
            if left >> bit & 1:
                c = _apply(table, c)
        out[row] = c[0]
    return out


def _word_checksums(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of each word, byte by byte over all words that still have one."""
    order = np.argsort(-np.minimum(length, _SHORT + 1), kind="stable")
    first, size = start[order], length[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(min(_SHORT, int(size[0]) if len(size) else 0)):
        n = int(np.searchsorted(-np.minimum(size, _SHORT + 1), -j, "left"))
        crc[:n] = _BYTE[(crc[:n] ^ data[first[:n] + j]) & 255] ^ (crc[:n] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.count_nonzero(size > _SHORT))):
        crc[i] = zlib.crc32(data[first[i] : first[i] + size[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, their bytes with A-Z lower-cased, their offsets in these) of a text column."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(column))
        part = whole[offsets[row] : offsets[end]].copy()
        part[(part >= 65) & (part <= 90)] |= 32
        yield row, end - row, part, offsets[row : end + 1] - offsets[row]
        row = end


def _ngrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every n-gram of some texts, in bounded parts."""
    inside = _WORD_BYTE[data]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    fresh = offsets[:-1][offsets[:-1] < len(data)]
    before[fresh] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    after[fresh[fresh > 0] - 1] = False
    length = np.flatnonzero(inside & ~after) + 1 - start
    text = np.searchsorted(offsets, start, "right") - 1
    space = np.full(1, zlib.crc32(b" "), np.uint32)
    for low in range(0, len(start), SLICE_WORDS):
        # an n-gram belongs to the part of its last word
        lead = min(low, NGRAM_WORDS - 1)
        part = slice(low - lead, low + SLICE_WORDS)
        owner, size = text[part], length[part]
        word = _word_checksums(data, start[part], size)
        yield owner[lead:], word[lead:] % BUCKETS
        spaced = shift(np.repeat(space, len(size)), size) ^ word
        phrase = word
        for n in range(1, NGRAM_WORDS):
            phrase = shift(phrase[:-1], size[n:] + 1) ^ spaced[n:]
            same = owner[n:] == owner[:-n]
            same[: max(0, lead - n)] = False
            yield owner[n:][same], phrase[same] % BUCKETS


# ---- counts, gains and scores ----------------------------------------------------------------


def bucket_counts(texts: DataFrame, text: str) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket: counted in the tasks, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in _slices(batch.column(0)):
                for _, bucket in _ngrams(data, offsets):
                    total += np.bincount(bucket, minlength=BUCKETS)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(hit, pa.int32()), "n": pa.array(total[hit])})

    column = texts.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    parts = column.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for row in parts.collect():  # one row a bucket at most
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of the smoothed shares of each bucket in target and source."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (s.sum() + BUCKETS)) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _noise_seed(job_id: Column, seed: int) -> Column:
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(job_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("long")


def weighed(table: DataFrame, gains: np.ndarray) -> DataFrame:
    """(..., cleaned_text, h) -> the other columns with n_words, n_features, weight, score."""
    kept = [f for f in table.schema.fields if f.name not in ("cleaned_text", "h")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{c} long" for c in ("n_words", "n_features", "weight", "score"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            words, weight = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for first, n, data, offsets in _slices(batch.column("cleaned_text")):
                for turn, (owner, bucket) in enumerate(_ngrams(data, offsets)):
                    part = slice(first, first + n)
                    if turn % NGRAM_WORDS == 0:
                        words[part] += np.bincount(owner, minlength=n)
                    # sums of whole numbers far below 2^53: exact
                    weight[part] += np.bincount(owner, gains[bucket], minlength=n).astype(np.int64)
            features = sum(np.maximum(words - k, 0) for k in range(NGRAM_WORDS))
            h = batch.column("h").to_numpy(zero_copy_only=False)
            noise = np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296)))
            found = [pa.array(x) for x in (words, features, weight, weight + noise.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), *found],
                names=[*(f.name for f in kept), "n_words", "n_features", "weight", "score"],
            )

    return table.mapInArrow(run, schema)


# ---- radix sort ------------------------------------------------------------------------------

DIGIT_BITS = 11
# Rows to a block: what one call sorts. A block is a run of positions, never a key.
BLOCK_BITS = 13


@dataclass(frozen=True)
class _Digits:
    """A non-negative whole number column as digits, least significant first."""

    value: Column
    bits: int

    def columns(self) -> list[Column]:
        mask = F.lit((1 << DIGIT_BITS) - 1).cast("long")
        return [F.shiftright(self.value, at).bitwiseAND(mask).cast("int") for at in range(0, self.bits, DIGIT_BITS)]


def _whole_number(job_id: Column, kind: str) -> Column:
    return job_id.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(job_id.cast("string"))


def _key_digits(low: int, top: int) -> list[Column]:
    """Digits of (score descending, id ascending, null ids last), least significant first.

    The id is split into two halves of 32 bits, so that no difference overflows.
    """
    half = F.lit(0xFFFFFFFF).cast("long")
    parts = [
        _Digits(F.coalesce(F.col("id").bitwiseAND(half), F.lit(0)), 32),
        _Digits(F.coalesce(F.shiftright("id", 32) - F.lit(low), F.lit(0)), 32),
        _Digits(F.col("id").isNull().cast("long"), 1),
        _Digits(F.lit(top) - F.col("score"), 63),
    ]
    return [c for part in parts for c in part.columns()]


def _scatter(now: DataFrame, digit: str) -> DataFrame:
    """One stable counting-sort pass: rows with their new ``pos``, their place by ``digit``.

    Counts by (block, digit) become offsets: all rows of smaller digits, then those of the same
    digit in earlier blocks; inside its block a row's turn is counted in order of position.
    """
    placed = now.withColumn("block", F.shiftright("pos", BLOCK_BITS))
    counts = cut(placed.groupBy("block", F.col(digit).alias("digit")).agg(F.count(F.lit(1)).alias("n")), "digits")
    # One row a digit, 2^DIGIT_BITS at most.
    totals = counts.groupBy("digit").agg(F.sum("n").alias("n"))
    smaller = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("digit", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("base"))
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(F.broadcast(bases), "digit").select(
        F.col("block").alias("of"), "digit", (F.col("base") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("offset")
    )

    columns = now.columns

    def scatter(rows: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[np.argsort(rows["pos"].to_numpy(), kind="stable")]
        digits = rows[digit].to_numpy()
        order = np.argsort(digits, kind="stable")
        counted = np.bincount(digits, minlength=1 << DIGIT_BITS)
        first = np.cumsum(counted) - counted
        offset = np.zeros(1 << DIGIT_BITS, np.int64)
        offset[heads["digit"].to_numpy()] = heads["offset"].to_numpy()
        sorted_digits = digits[order]
        pos = np.empty(len(rows), np.int64)
        pos[order] = offset[sorted_digits] + np.arange(len(rows)) - first[sorted_digits]
        return rows.assign(pos=pos)[columns]

    return placed.groupBy("block").cogroup(offsets.groupBy("of")).applyInPandas(scatter, now.schema)


def radix_places(rows: DataFrame) -> DataFrame:
    """rows(row, id, score) -> (row, pos): places from 0 by score descending, then id, nulls last.

    Digits that are the same in every row move nothing and are left out; the lowest stays, so
    that places are always counted. Equal keys get places next to each other.
    """
    low, top = rows.agg(F.min(F.shiftright("id", 32)), F.max("score")).first()
    digits = _key_digits(low or 0, top or 0)
    names = [f"d{i}" for i in range(len(digits))]
    keyed = cut(rows.select("row", F.col("row").alias("pos"), *(d.alias(n) for d, n in zip(digits, names, strict=True))), "keys")
    spans = keyed.agg(*(F.coalesce(F.max(n) - F.min(n), F.lit(0)).alias(n) for n in names)).first()
    used = [n for i, n in enumerate(names) if i == 0 or spans[n]]
    now = keyed.select("row", "pos", *used)
    for i, digit in enumerate(used):
        now = cut(_scatter(now, digit).select("row", "pos", *used[i + 1 :]), "pass")
    return now.select("row", "pos")


def resample(
    enriched_records: DataFrame,
    targets: DataFrame,
    *,
    job_id: str = "job_id",
    cleaned_text: str = "cleaned_text",
    text: str = "text",
    draw_percent: int = 5,
    least_words: int = 20,
    seed: int = 42,
) -> DataFrame:
    """Records drawn so that their n-grams look like those of ``targets``.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; features all runs
    of one to three words, hashed into ``BUCKETS`` buckets by crc32. Of the N records with at
    least ``least_words`` words, ``draw_percent`` of a hundred (rounded down) with the highest
    ``score`` are drawn: the weight in thousandths of a nat plus Gumbel noise that depends on
    ``seed`` and the job id only, so a draw can be repeated.

    Returns job_id, n_words, n_features, weight, score and ``rank`` (1, 2, ... for those drawn, else
    null). Counts, gains and scores cover whole texts of all records; the gains are one array of
    ``BUCKETS`` numbers, the only thing that passes the driver. Texts never shuffle.

    Null and empty texts have no words: weight 0, never drawn. Equal scores go by the smaller id
    (ids that are no whole numbers by their 64-bit hash), a null id last; repeated rows are drawn
    one by one. No rows in, no rows out; no targets: only the smoothing counts. Other columns are
    ignored.
    """
    table = records(enriched_records, job_id, cleaned_text)
    gains = bucket_gains(bucket_counts(table, "cleaned_text"), bucket_counts(targets, text))
    scored = weighed(table.withColumn("h", _noise_seed(F.col("job_id"), seed)), gains)
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
    kind = scored.schema["job_id"].dataType.simpleString()
    able = scored.where(F.col("n_words") >= least_words).select("row", _whole_number(F.col("job_id"), kind).alias("id"), "score")
    drawn = draw_percent * able.count() // 100
    ranks = radix_places(able).where(F.col("pos") < drawn).select("row", (F.col("pos") + 1).alias("rank"))
    return scored.join(ranks, "row", "left").select("job_id", "n_words", "n_features", "weight", "score", "rank")
