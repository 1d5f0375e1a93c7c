"""Packing of records into sequences: shortest pack first over the length histogram.

Texts become pieces of at most ``max_length`` ids. What is packed are lengths, not pieces: the
histogram has at most ``max_length`` entries whatever the corpus, and the packing of a histogram
is a list of patterns with counts. Pieces then find their place by their rank among the pieces
of their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgate.llm.common import ids_as, ids_as_text, records, slices
from inkgate.llm.tokens import encoder
from inkgate.session import cut


def pack_lengths(counts: dict[int, int], max_length: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pattern, number of sequences with it) for a histogram of lengths.

    Longest lengths go first, each onto the packs with the most room left (the shortest packs);
    if nothing has room, into new ones. A pattern that only some of its packs are needed for is
    split by count.
    """
    # room -> patterns with that room and their counts
    open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[length]
        placed = []
        while left:
            room = max((r for r, held in open_by_room.items() if held), default=-1)
            if room < length:
                # as many of this length as fit share each new pack
                each = max_length // length if not any(open_by_room.values()) or length * 2 <= max_length else 1
                whole, rest = divmod(left, each)
                if whole:
                    placed.append(((length,) * each, whole))
                if rest:
                    placed.append(((length,) * rest, 1))
                break
            pattern, count = open_by_room[room].pop()
            fit = room // length
            if left >= count:
                each = min(fit, left // count)
                placed.append((pattern + (length,) * each, count))
                left -= each * count
            else:
                placed.append((pattern + (length,), left))
                open_by_room[room].append((pattern, count - left))
                left = 0
        for pattern, count in placed:
            open_by_room.setdefault(max_length - sum(pattern), []).append((pattern, count))
    return [entry for held in open_by_room.values() for entry in held]


@dataclass(frozen=True)
class Places:
    """For each length, runs of ranks: first rank, first sequence, offset in the sequence."""

    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    sequences: int

    @classmethod
    def of(cls, patterns: list[tuple[tuple[int, ...], int]]) -> Places:
        found: dict[int, list[tuple[int, int, int]]] = {}
        next_rank: dict[int, int] = {}
        sequence = 0
        for pattern, count in patterns:
            offset = 0
            for length in pattern:
                rank = next_rank.get(length, 0)
                found.setdefault(length, []).append((rank, sequence, offset))
                next_rank[length] = rank + count
                offset += length
            sequence += count
        runs = {length: tuple(np.array(rows, np.int64).T) for length, rows in found.items()}
        return cls(runs, sequence)


def _pieces(path: str, end_id: int, max_length: int):
    """Task: (job_id, cleaned_text) -> pieces numbered by length within the task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, task = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(max_length + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for frame in frames:
            rows = zip(frame["job_id"], frame["cleaned_text"], strict=True)
            for part in slices(rows, lambda r: len(r[1]), 1_000_000):
                out = []
                for (key, _), ids in zip(part, encode([t for _, t in part]), strict=True):
                    ids += end
                    for at in range(0, len(ids), 4 * max_length):
                        piece = ids[at : at + 4 * max_length]
                        size = len(piece) // 4
                        out.append((key, at // 4, size, piece, len(ids) // 4, seen[size]))
                        seen[size] += 1
                table = pd.DataFrame(out, columns=["job_id", "start", "length", "ids", "tokens", "turn"])
                yield table.assign(task=task)
        encode.rest()

    return run


def pack(
    enriched_records: DataFrame,
    tokenizer: str,
    *,
    job_id: str = "job_id",
    cleaned_text: str = "cleaned_text",
    end_id: int = 1,
    max_length: int = 2048,
) -> DataFrame:
    """One row per piece: job_id, start, length, ids, tokens, sequence_id, offset.

    Every record is encoded with the tokenizer file and closed by ``end_id``; records longer
    than a sequence are cut into whole sequences and a rest. ``ids`` are the piece's ids as
    little-endian unsigned 32-bit integers, ``tokens`` the record's ids with the end id.
    Sequences are numbered from 0; their pieces lie at ``offset`` without gaps.

    Null and empty texts are a single end id. Repeated rows and job ids are records of their
    own. No rows in, no rows out. Other columns are ignored. Sent to tasks: the runs of the
    patterns, bounded by ``max_length`` and the number of its patterns, not by the corpus.
    """
    table = records(enriched_records, job_id, cleaned_text)
    kind = table.schema["job_id"].dataType.simpleString()
    schema = "job_id string, start long, length long, ids binary, tokens long, turn long, task long"
    pieces = cut(ids_as_text(table, "job_id").mapInPandas(_pieces(tokenizer, end_id, max_length), schema), "pieces")
    parts = cut(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places.of(pack_lengths(histogram, max_length))
    # Rank of a task's first piece of each length: one row per task and length, summed in order.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranked = parts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    first = ranked.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("length", "first"))).alias("first"))
    sent = table.sparkSession.sparkContext.broadcast(places.runs)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = sent.value
        for frame in frames:
            length, rank = frame["length"].to_numpy(), frame.pop("rank").to_numpy()
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for size in np.unique(length):
                rows = length == size
                ranks, sequences, offsets = runs[size]
                at = np.searchsorted(ranks, rank[rows], "right") - 1
                sequence[rows] = sequences[at] + rank[rows] - ranks[at]
                offset[rows] = offsets[at]
            yield frame.assign(sequence_id=sequence, offset=offset)

    ready = pieces.join(cut(first, "ranks"), "task").select(
        "job_id", "start", "length", "ids", "tokens", (F.col("turn") + F.element_at("first", F.col("length"))).alias("rank")
    )
    placed = ready.mapInPandas(
        place, "job_id string, start long, length long, ids binary, tokens long, sequence_id long, offset long"
    )
    return ids_as(placed, kind, "job_id")
