"""Benchmark decontamination by a distributed positional inverted index.

The index is a table of segments. A segment holds the word postings of consecutive records
(about ``SEGMENT_WORDS`` words): one row per term with its ascending positions, and one
directory row (null term) naming its records. Segments are bounded, independent of each other
and dealt over the cluster, so a common word is never one list. A search reads only the postings
of the test terms, and in each segment intersects offset-adjusted lists from the rarest term on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgate.llm.common import cut_tight, ids_as, ids_as_text, records, slices, starts_of
from inkgate.session import cut

SEGMENT_WORDS = 400_000
# Words of test items searched at once: bounds what is sent to the tasks. More items are
# searched in further passes over the index.
PASS_WORDS = 400_000

# Bytes of UTF-8: all but ASCII other than 0-9 and a-z, after A-Z became a-z.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def build_index(enriched_records: DataFrame, *, job_id: str = "job_id", cleaned_text: str = "cleaned_text") -> DataFrame:
    """Postings of every word of every record: segment, term, positions, job_ids, n_words.

    ``positions`` are the word positions in the segment as gaps to the one before (the first: to
    0), little-endian unsigned 32-bit. The row of a
    segment without a term lists its records in order. Write the table before it is searched:
    segments are numbered by task.
    """
    table = records(enriched_records, job_id, cleaned_text)
    kind = table.schema["job_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number = TaskContext.get().partitionId(), 0

        def read():
            for frame in frames:
                for key, text in zip(frame["job_id"], frame["cleaned_text"], strict=True):
                    yield key, words_of(text)

        for part in slices(read(), lambda r: len(r[1]) + 50, SEGMENT_WORDS):
            flat = [w for _, words in part for w in words]
            codes, terms = pd.factorize(np.array(flat, object)) if flat else (np.zeros(0, int), [])
            order = np.argsort(codes, kind="stable")
            ends = np.cumsum(np.bincount(codes, minlength=len(terms)))[: len(terms)]
            gaps = np.diff(order, prepend=0)
            gaps[ends[:-1]] = order[ends[:-1]]
            packed, bounds = gaps.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
            lists = [packed[a:b] for a, b in pairwise(bounds)]
            segment = (task << 32) + number
            number += 1
            yield pd.DataFrame(
                {
                    "segment": segment,
                    "term": [None, *(t.decode("utf-8", "surrogatepass") for t in terms)],
                    "positions": [None, *lists],
                    "job_ids": pd.Series([[key for key, _ in part], *[None] * len(terms)], dtype=object),
                    "n_words": pd.Series([[len(words) for _, words in part], *[None] * len(terms)], dtype=object),
                }
            )

    built = ids_as_text(table, "job_id").mapInPandas(
        run, "segment long, term string, positions binary, job_ids array<string>, n_words array<long>"
    )
    return ids_as(built, f"array<{kind}>", "job_ids")


def _windows(items: list[tuple], width: int) -> dict:
    """The distinct windows of some test items as term numbers, each with its items."""
    terms: dict[str, int] = {}
    windows: dict[tuple, list] = {}
    for key, words in items:
        ids = [terms.setdefault(w, len(terms)) for w in words]
        for at in range(max(1, len(ids) - width + 1) if ids else 0):
            owners = windows.setdefault(tuple(ids[at : at + width]), [])
            if not owners or owners[-1] != key:
                owners.append(key)
    return {"terms": terms, "windows": list(windows), "items": list(windows.values())}


def _matches(windows: list[tuple], lists: dict[int, np.ndarray], slop: int) -> Iterator[tuple[int, np.ndarray]]:
    """(window, start positions) in one segment; lists: positions by term number."""
    for number, window in enumerate(windows):
        if not all(t in lists for t in window):
            continue
        order = sorted(range(len(window)), key=lambda i: len(lists[window[i]]))
        starts = lists[window[order[0]]] - order[0]
        for i in order[1:]:
            other = lists[window[i]]
            at = np.searchsorted(other, starts + (i - slop))
            near = other[np.minimum(at, len(other) - 1)]
            starts = starts[(at < len(other)) & (near <= starts + (i + slop))]
            if not len(starts):
                break
        if len(starts):
            yield number, starts


def search_index(
    index: DataFrame, items: DataFrame, *, item_id: str = "item_id", text: str = "text", width: int = 10, slop: int = 0
) -> DataFrame:
    """Matches of test items in the records: job_id, n_words, n_hit, item_ids.

    A window is ``width`` consecutive words of an item (all of a shorter one). ``slop`` 0 finds
    exact phrases; above 0 every word may stand up to ``slop`` places from where the phrase has
    it, and the words of the phrase's span count as hit. Every record has a row; ``item_ids`` are
    distinct. Items are a query set, searched in passes of at most ``PASS_WORDS`` words.
    """
    wanted = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    passes = slices(
        ((r["item_id"], [w.decode("utf-8", "surrogatepass") for w in words_of(r["text"])]) for r in wanted.toLocalIterator()),
        lambda r: len(r[1]) + 1,
        PASS_WORDS,
    )
    item_kind = wanted.schema["item_id"].dataType.simpleString()
    found = None
    for part in passes:
        hits = _one_pass(index, _windows(part, width), item_kind, slop)
        found = hits if found is None else found.unionByName(hits)
    everyone = index.where("term IS NULL").select(
        "segment", F.posexplode(F.arrays_zip("job_ids", "n_words")).alias("place", "r")
    )
    everyone = everyone.select("segment", "place", "r.job_ids", "r.n_words").withColumnRenamed("job_ids", "job_id")
    if found is None:
        none = F.array().cast(f"array<{item_kind}>")
        return everyone.select("job_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("item_ids"))
    # Only records with a hit have rows here; passes meet by record.
    merged = found.groupBy("segment", "place").agg(
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("item_ids"),
        F.size(F.array_distinct(F.flatten(F.collect_list("words")))).cast("long").alias("n_hit"),
    )
    return everyone.join(cut(merged, "hits"), ["segment", "place"], "left").select(
        "job_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast(f"array<{item_kind}>")).alias("item_ids"),
    )


def _one_pass(index: DataFrame, tests: dict, item_kind: str, slop: int) -> DataFrame:
    """Hits (segment, place, words, items) of a bounded set of windows."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast(tests)
    terms = spark.createDataFrame(list(tests["terms"].items()), "term string, number int")

    def search(keys, rows):
        windows, owners = sent.value["windows"], sent.value["items"]
        lists = {
            n: np.cumsum(np.frombuffer(p, "<u4"), dtype=np.int64)
            for n, p in zip(rows["number"], rows["positions"], strict=True)
            if n >= 0
        }
        sizes = np.array(rows["n_words"][rows["number"].to_numpy() < 0].iat[0], np.int64)
        first = starts_of(sizes)
        hits: dict[int, tuple[list, set]] = {}
        for number, starts in _matches(windows, lists, slop):
            length = len(windows[number])
            place = np.searchsorted(first, starts, "right") - 1
            # an occurrence lies inside one record: empty records share their start with the next
            inside = (starts >= 0) & (starts + length <= first[place] + sizes[place])
            for p, at in zip(place[inside].tolist(), starts[inside].tolist(), strict=True):
                words, items = hits.setdefault(p, ([], set()))
                words.append((at - first[p], length))
                items.update(owners[number])
        out = {"segment": [], "place": [], "words": [], "items": []}
        for p, (spans, found) in hits.items():
            mark = np.zeros(sizes[p] + 1, np.int32)
            for at, length in spans:
                mark[at] += 1
                mark[at + length] -= 1
            out["segment"].append(keys[0])
            out["place"].append(p)
            out["words"].append(np.flatnonzero(np.cumsum(mark[:-1]) > 0))
            out["items"].append(list(found))
        return pd.DataFrame({k: pd.Series(v, dtype=object if k in ("words", "items") else "int64") for k, v in out.items()})

    # at most PASS_WORDS terms are sent to the postings: those stay where they are
    asked = index.where("term IS NOT NULL").join(F.broadcast(terms), "term").select("segment", "number", "positions", F.lit(None).cast("array<long>").alias("n_words"))
    directory = index.where("term IS NULL").select("segment", F.lit(-1).alias("number"), F.lit(None).cast("binary").alias("positions"), "n_words")
    return (
        asked.unionByName(directory)
        .groupBy("segment")
        .applyInPandas(search, f"segment long, place int, words array<long>, items array<{item_kind}>")
    )


def contamination(
    enriched_records: DataFrame,
    items: DataFrame,
    *,
    job_id: str = "job_id",
    cleaned_text: str = "cleaned_text",
    item_id: str = "item_id",
    text: str = "text",
    width: int = 10,
    slop: int = 0,
) -> DataFrame:
    """Every record with its benchmark hits: job_id, n_words, n_hit, item_ids.

    Null and empty texts have no words; an item without words is never found. Repeated rows and
    job ids each get a row of their own. No records, no rows; no items, no hits. Other columns
    of either table are ignored.
    """
    index = cut_tight(build_index(enriched_records, job_id=job_id, cleaned_text=cleaned_text), "postings")
    return search_index(index, items, item_id=item_id, text=text, width=width, slop=slop)
