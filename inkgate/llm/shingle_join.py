"""N-gram Jaccard join of enriched records by filtering under several global token orders.

Two sets with Jaccard similarity t share a token among the first ``n - ceil(t n) + 1`` of each
set in *any* global order, and k tokens among the first ``n - ceil(t n) + k``. Three orders are
used, each on what the ones before let through:

1. ascending hash, k tokens in the longer prefix, which needs no counts: most records with no
   partner leave here, after a tenth to a fifth of their tokens was looked at;
2. rarest token first, by exact counts over all records left; tokens nobody shares are dropped;
3. descending hash, and ascending hash once more, for each pair of rows before it is verified.
   Members of large buckets meet in blocks, where counting all shared tokens at once is the
   cheaper test; no further order is used on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgate.llm.common import components, filter_bits, member_filter, records, with_flag
from inkgate.session import cut

_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
# Buckets of at most SMALL members make pairs of rows, larger ones meet in blocks of BLOCK.
SMALL, BLOCK = 24, 256
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z count as a-z."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ each[i : len(each) - width + 1 + i]) * _K1
        mixed ^= mixed >> np.uint64(31)
        mixed = mixed * _K2 + _K3
    mixed ^= mixed >> np.uint64(30)
    mixed *= _M1
    mixed ^= mixed >> np.uint64(27)
    mixed *= _M2
    mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed.view(np.int64))


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` must share with any partner."""
    return (percent * n + 99) // 100


def _longs(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(a) for a in arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _sets(size: int, percent: int, whole: bool):
    """Task: (job_id, cleaned_text) -> sets. ``whole``: all tokens, else the first prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingle_hashes(t.as_py(), size) for t in part.column("cleaned_text")]
                n = np.array([len(s) for s in sets], np.int64)
                need = [least_overlap(len(s), percent) for s in sets]
                short = [len(s) - o + (len(s) > 0) for s, o in zip(sets, need, strict=True)]
                columns = {
                    "job_id": part.column("job_id"),
                    "n_shingles": pa.array(n),
                    "signature": pa.array(
                        [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()
                    ),
                }
                if whole:
                    columns["tokens"] = _longs(sets)
                    columns["low"] = _longs([s[:p] for s, p in zip(sets, short, strict=True)])
                    columns["high"] = _longs([s[len(s) - p :] for s, p in zip(sets, short, strict=True)])
                else:
                    columns["prefix"] = _longs([s[: 2 * p - 1] for s, p in zip(sets, short, strict=True)])
                    # what a partner shares at least: its own k, and it may be the smaller set
                    columns["shared_least"] = pa.array(
                        [o - least_overlap(o, percent) + 1 for o in need], pa.int64()
                    )
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _first_order(sets: DataFrame) -> DataFrame:
    """Signatures that share enough of their longer prefix with other sets."""
    postings = sets.where("n_shingles > 0").select(
        F.explode("prefix").alias("token"), F.xxhash64("signature").alias("s"), "shared_least"
    )
    shared = cut(
        postings.groupBy("token")
        .agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
        .where("lo < hi")
        .select("token"),
        "shared",
    )
    # Copies of a set post the same tokens: one posting for each is enough.
    hits = postings.join(shared, "token").groupBy("s", "token").agg(F.min("shared_least").alias("least"))
    return cut(hits.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("least")).where("n >= least"), "left")


def _second_order(sets: DataFrame, percent: int) -> DataFrame:
    """Sets whose rarest-first prefix holds shared tokens: that prefix and the shared tokens."""
    postings = sets.select("job_id", F.explode("tokens").alias("token"))
    counts = cut(postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts")
    kept = postings.join(counts, "token").groupBy("job_id").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared")
    )
    size = F.size("shared")
    prefix = F.col("n_shingles") - F.floor((F.col("n_shingles") * percent + 99) / 100) + 1
    room = (prefix - (F.col("n_shingles") - size)).cast("int")
    rare = kept.join(sets.drop("tokens"), "job_id").where(room > 0)
    return cut(
        rare.select(
            "job_id",
            "n_shingles",
            "low",
            "high",
            F.transform("shared", lambda x: x["token"]).alias("tokens"),
            F.transform(F.slice("shared", F.lit(1), room), lambda x: x["token"]).alias("prefix"),
        ),
        "rare",
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share a token under the other orders too and reach the similarity."""
    side = sets.select("job_id", "n_shingles", "low", "high", "tokens")
    x = side.select(*(F.col(c).alias(f"{c}_a") for c in side.columns))
    y = side.select(*(F.col(c).alias(f"{c}_b") for c in side.columns))
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return (
        pairs.join(x, F.col("a") == F.col("job_id_a"))
        .join(y, F.col("b") == F.col("job_id_b"))
        .where(F.arrays_overlap("low_a", "low_b") & F.arrays_overlap("high_a", "high_b"))
        .where(100 * both >= percent * (F.col("n_shingles_a") + F.col("n_shingles_b") - both))
        .select("a", "b")
    )


def _pairs(rows: DataFrame, others: DataFrame, percent: int, once: bool = False) -> DataFrame:
    """Distinct pairs of one bucket whose components differ and whose sizes allow a link."""
    o = others.select("token", *(F.col(c).alias(f"{c}_o") for c in ("job_id", "n_shingles", "label")))
    low, high = F.least("n_shingles", "n_shingles_o"), F.greatest("n_shingles", "n_shingles_o")
    return (
        rows.join(o, "token")
        .where((F.col("label") != F.col("label_o")) & (100 * low >= percent * high))
        .where(F.col("job_id") < F.col("job_id_o") if once else F.lit(True))
        .select(F.least("job_id", "job_id_o").alias("a"), F.greatest("job_id", "job_id_o").alias("b"))
        .distinct()
    )


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after joining the components that ``links`` connect."""
    a = labels.select(F.col("job_id").alias("a"), F.col("label").alias("la"))
    b = labels.select(F.col("job_id").alias("b"), F.col("label").alias("lb"))
    ties = links.join(a, "a").join(b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    merged = components(ties, cut)
    return cut(
        labels.join(merged, F.col("label") == F.col("id"), "left").select(
            "job_id", F.coalesce("component", "label").alias("label")
        ),
        "labels",
    )


def _near(tokens: list[np.ndarray], size: np.ndarray, percent: int) -> np.ndarray:
    """Which two of the sets reach the similarity; ``size`` counts tokens that were dropped too."""
    ends = np.cumsum([len(t) for t in tokens])
    flat, column = np.unique(np.concatenate(tokens), return_inverse=True)
    row = np.repeat(np.arange(len(tokens)), np.diff(ends, prepend=0))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(tokens), len(tokens)), np.int64)
    for at in range(0, len(flat), 4096):
        lo, hi = np.searchsorted(column, (at, at + 4096))
        grid = np.zeros((len(tokens), 4096), np.float32)
        grid[row[lo:hi], column[lo:hi] - at] = 1
        both += (grid @ grid.T).astype(np.int64)  # at most 4096: exact
    return 100 * both >= percent * (size[:, None] + size[None, :] - both)


def _blocks(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of large buckets, compared block by block inside tasks.

    A bucket is dealt into blocks of about ``BLOCK`` members; every two blocks meet in a task
    of their own. A task returns at most one link per member: enough to join components.
    """
    kind = large.schema["job_id"].dataType.simpleString()

    def links(keys, part):
        label = part["label"].to_numpy()
        size = part["n_shingles"].to_numpy()
        parent = {x: x for x in label}

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        near = _near(list(part["tokens"]), size, percent)
        found = []
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            x, y = root(label[i]), root(label[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((part["job_id"].iat[i], part["job_id"].iat[j]))
        return pd.DataFrame(found, columns=["a", "b"])

    count = large.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = (
        large.join(count, "token")
        .withColumn("mine", F.pmod(F.xxhash64("job_id"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("token", "job_id", "label", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    )
    return (
        dealt.join(sets.select("job_id", "n_shingles", "tokens"), "job_id")
        .groupBy("token", "lo", "hi")
        .applyInPandas(links, f"a {kind}, b {kind}")
    )


def _linked(sets: DataFrame, percent: int, leader_rounds: int) -> DataFrame:
    """(job_id, label): components of the sets, without all pairs of a bucket of copies.

    First every bucket compares its members with one leader at a time; what links becomes one
    component and needs no comparison inside. Then all members of different components are
    compared: pair by pair in buckets of at most ``SMALL`` members, in blocks inside tasks in
    larger ones. Nothing is left out.
    """
    buckets = cut(sets.select("job_id", "n_shingles", F.explode("prefix").alias("token")), "buckets")
    labels = sets.select("job_id", F.col("job_id").alias("label"))
    for turn in range(leader_rounds + 1):
        rows = buckets.join(labels, "job_id")
        mixed = rows.groupBy("token").agg(
            F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members")
        )
        mixed = cut(mixed.where("lo <> hi").select("token", "members"), "mixed")
        rows = cut(rows.join(mixed, "token"), "rows")
        if turn < leader_rounds:
            order = F.struct(F.xxhash64("job_id", F.lit(turn)).alias("o"), "job_id", "n_shingles", "label")
            leaders = rows.groupBy("token").agg(F.min(order).alias("x")).select("token", "x.*")
            links = _verified(_pairs(rows, cut(leaders, "leaders"), percent), sets, percent)
        else:
            small, large = rows.where(F.col("members") <= SMALL), rows.where(F.col("members") > SMALL)
            links = _verified(_pairs(small, small, percent, once=True), sets, percent)
            links = links.unionByName(_blocks(large.drop("n_shingles", "members"), sets, percent))
        labels = _relabel(labels, cut(links, "verified"))
    return labels


def jaccard_components(
    enriched_records: DataFrame,
    *,
    job_id: str = "job_id",
    cleaned_text: str = "cleaned_text",
    percent: int = 90,
    shingle_words: int = 3,
    leader_rounds: int = 2,
) -> DataFrame:
    """One row per record: job_id, n_shingles, component_id.

    Records link when the Jaccard similarity of their sets of word shingles is at least
    ``percent`` / 100; ``component_id`` is the smallest job id reachable. Equal sets are one
    node from the start. Words are split at ASCII white space; a record of fewer words than a
    shingle is one shingle, one without words has no set and links with nothing. A null job id
    is passed through and never links. Job ids are unique; whole rows may repeat, but of several
    texts under one id only one is compared. No rows in, no rows out. Other columns are ignored.
    """
    table = records(enriched_records, job_id, cleaned_text)
    kind = table.schema["job_id"].dataType.simpleString()
    head = f"job_id {kind}, n_shingles long, signature binary"
    sets = cut(
        table.mapInArrow(_sets(shingle_words, percent, False), f"{head}, prefix array<long>, shared_least long"),
        "prefixes",
    )
    named = sets.where("n_shingles > 0 AND job_id IS NOT NULL").select("job_id", "n_shingles", "signature")
    left = _first_order(sets.where("job_id IS NOT NULL"))
    classes = named.groupBy("signature").agg(F.min("job_id").alias("class_id"), F.count(F.lit(1)).alias("rows"))
    classes = cut(classes, "classes")
    nodes = cut(
        classes.join(left, F.xxhash64("signature") == F.col("s"), "left_semi").select(
            F.col("class_id").alias("job_id"), "signature"
        ),
        "nodes",
    )
    bits = filter_bits(nodes.count())
    words = cut(member_filter(nodes, "job_id", bits), "filter")
    texts = with_flag(table, words, F.col("job_id"), bits, "maybe").where("maybe").drop("maybe")
    whole = texts.mapInArrow(
        _sets(shingle_words, percent, True), f"{head}, tokens array<long>, low array<long>, high array<long>"
    )
    # The signature too: a repeated job id may stand for several texts.
    whole = cut(whole.join(nodes, ["job_id", "signature"], "left_semi").dropDuplicates(["job_id"]), "whole")
    labels = _linked(_second_order(whole.drop("signature"), percent), percent, leader_rounds)
    groups = classes.join(labels, F.col("class_id") == F.col("job_id"), "left")
    groups = cut(
        groups.where("rows > 1 OR label IS NOT NULL").select(
            "signature", F.coalesce("label", "class_id").alias("component_id")
        ),
        "groups",
    )
    joined = sets.select("job_id", "n_shingles", "signature").join(groups, "signature", "left")
    return joined.select("job_id", "n_shingles", F.coalesce("component_id", "job_id").alias("component_id"))
