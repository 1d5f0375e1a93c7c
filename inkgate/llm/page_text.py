"""Main text of ingested pages: markup first, then differencing with the nearest URL's page.

Pages of one host share what the site puts around its articles. Every page is paired with the
page whose URL path is nearest in the host's order; the lines of both are aligned by longest
common subsequence, and lines that both have are taken for the site's. What the markup itself
names decides first: lines inside an article element stay even if the neighbour has them (two
pages may carry the same passage), lines inside menus, adverts and the like go even if it has not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgate.llm.common import ids_as, ids_as_text, slices, starts_of
from inkgate.session import cut

PLAIN, MAIN = 1, 2

# Names by which pages call their parts.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "aside button canvas dialog footer form head iframe nav noscript object script select style svg template textarea title video audio".split()
)
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo recommended "
    "related replies respond share sharebar sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
SIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search".split())
MAIN_NAMES = re.compile(r"(?i)^(article|post|entry|story|main)([-_]?(body|content|text))$|^(articlebody|main-?content)$")


class _Lines(HTMLParser):
    """(zone, line) of a page in order, without what lies in side parts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[int, str]] = []
        self.text: list[str] = []
        self.main: list[list] = []  # open main elements: tag, nested same tags
        self.side: list | None = None

    def flush(self) -> None:
        line = " ".join("".join(self.text).split())
        self.text.clear()
        if line:
            self.lines.append((MAIN if self.main else PLAIN, line))

    def is_side(self, tag: str, given: dict) -> bool:
        if tag in DROPPED or (tag == "header" and not self.main):
            return True
        if "hidden" in given or given.get("aria-hidden") == "true" or given.get("role") in SIDE_ROLES:
            return True
        if re.search(r"display\s*:\s*none", given.get("style") or ""):
            return True
        names = re.split(r"[^a-z0-9]+", f"{given.get('class') or ''} {given.get('id') or ''}".lower())
        return tag not in ("html", "body", "article", "main") and not SIDE_WORDS.isdisjoint(names)

    def is_main(self, tag: str, given: dict) -> bool:
        names = f"{given.get('class') or ''} {given.get('id') or ''}".split()
        return (
            tag in ("article", "main")
            or given.get("role") in ("main", "article")
            or given.get("itemprop") == "articleBody"
            or any(MAIN_NAMES.match(n) for n in names)
        )

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if self.side:
            # an article, or after a paragraph any block, ends a part that was never closed
            closed = tag in ("article", "main") or (self.side[0] == "p" and tag in BLOCKS) or (tag == self.side[0] == "li")
            if not closed:
                self.side[1] += tag == self.side[0]
                return
            self.side = None
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        for held in self.main:
            held[1] += tag == held[0]
        if self.is_side(tag, given):
            self.flush()
            self.side = [tag, 1]
        elif self.is_main(tag, given):
            self.main.append([tag, 1])

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS or tag == "br":
            self.handle_starttag(tag, attrs) if tag in VOID else self.flush()

    def handle_endtag(self, tag):
        if self.side:
            self.side[1] -= tag == self.side[0]
            if self.side[1] <= 0 or tag in ("body", "html"):
                self.side = None
                self._close(tag)
            return
        if tag in BLOCKS:
            self.flush()
        self._close(tag)

    def _close(self, tag: str) -> None:
        for held in self.main:
            held[1] -= tag == held[0]
        self.main = [held for held in self.main if held[1] > 0]

    def handle_data(self, data):
        if not self.side:
            self.text.append(data)


def page_lines(html: str) -> list[tuple[int, str]]:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.lines


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which entries of ``a`` a longest common subsequence with ``b`` uses.

    Rows of the alignment are bit vectors in whole integers; long inputs are halved first, so
    memory stays linear in the longer one.
    """
    used = np.zeros(len(a), bool)
    low, high = 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    while high < min(len(a), len(b)) - low and a[len(a) - 1 - high] == b[len(b) - 1 - high]:
        high += 1
    used[:low] = True
    used[len(a) - high :] = True
    inner = _align(a[low : len(a) - high].tolist(), b[low : len(b) - high].tolist())
    used[[low + i for i in inner]] = True
    return used


def _rows(a: list, b: list) -> Iterator[int]:
    """After each entry of ``a``: bit j is 0 where the alignment with b[:j + 1] gets longer."""
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _align(a: list, b: list) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > 1 << 28 and len(a) > 1:
        half = len(a) // 2
        *_, left = _rows(a[:half], b)
        *_, right = _rows(a[half:][::-1], b[::-1])
        grow = np.array([1 - (left >> j & 1) for j in range(len(b))])
        back = np.array([1 - (right >> j & 1) for j in range(len(b))])[::-1]
        fit = np.concatenate([[0], np.cumsum(grow)]) + np.concatenate([np.cumsum(back[::-1])[::-1], [0]])
        at = int(np.argmax(fit))
        return _align(a[:half], b[:at]) + [half + i for i in _align(a[half:], b[at:])]
    rows = [(1 << len(b)) - 1, *_rows(a, b)]
    out, i, j = [], len(a), len(b) - 1
    while i and j >= 0:
        if rows[i] >> j & 1:  # b[j] does not lengthen the alignment
            j -= 1
        elif not rows[i - 1] >> j & 1:  # nor does a[i - 1]
            i -= 1
        else:
            i -= 1
            out.append(i)
            j -= 1
    return out[::-1]


def _host_path(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "", parts.path)
    except ValueError:
        return ("", url or "")


def _hashes(lines: list[tuple[int, str]]) -> np.ndarray:
    found = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for _, t in lines]
    return np.array(found, np.uint64).view(np.int64)


def _outline(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        where = [_host_path(u) for u in frame["filename"]]
        found = [page_lines(h) for h in frame["content"]]
        yield pd.DataFrame(
            {
                "job_id": frame["job_id"],
                "host": [h for h, _ in where],
                "path": [p for _, p in where],
                "has_main": [any(z == MAIN for z, _ in x) for x in found],
                "lines": pd.Series([_hashes(x) for x in found], dtype=object),
            }
        )


def _in_order(pages: DataFrame, kind: str) -> DataFrame:
    """(place, job_id, host, path): pages numbered by host and path, without a global window."""
    spark = pages.sparkSession

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at = TaskContext.get().partitionId(), 0
        for frame in frames:
            yield frame.assign(part=part, place=np.arange(at, at + len(frame)))
            at += len(frame)

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = pages.select("job_id", "host", "path").repartitionByRange(ranges, "host", "path", "job_id")
    ordered = ordered.sortWithinPartitions("host", "path", "job_id")
    told = ids_as_text(ordered, "job_id").mapInPandas(number, "job_id string, host string, path string, part int, place long")
    held = cut(ids_as(told, kind, "job_id"), "order")
    sizes = held.groupBy("part").count().orderBy("part").collect()  # one row per range
    first = starts_of(np.array([r["count"] for r in sizes], np.int64)).tolist()
    base = spark.createDataFrame(
        [(r["part"], f) for r, f in zip(sizes, first, strict=True)], "part int, base long"
    )
    return held.join(F.broadcast(base), "part").select((F.col("base") + F.col("place")).alias("place"), "job_id", "host", "path")


def _neighbours(order: DataFrame) -> DataFrame:
    """(job_id, other_id): of the pages before and after, the one that shares more of the path."""

    def beside(step: int, name: str) -> DataFrame:
        return order.select(
            (F.col("place") - step).alias("place_o"),
            F.col("host").alias("host_o"),
            F.struct(F.col("job_id").alias("id"), F.col("path").alias("path")).alias(name),
        )

    def shared(a, b):
        # length of the common prefix: the first place where the paths differ
        size = F.least(F.length(a), F.length(b))
        places = F.sequence(F.lit(1), size)
        differ = F.filter(places, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
        return F.when(b.isNull(), -1).when(size == 0, 0).when(F.size(differ) > 0, F.element_at(differ, 1) - 1).otherwise(size)

    both = order
    for step, name in ((-1, "before"), (1, "after")):
        at = (F.col("place") == F.col("place_o")) & (F.col("host") == F.col("host_o"))
        both = both.join(beside(step, name), at, "left").drop("place_o", "host_o")
    path = F.col("path")
    closer = shared(path, F.col("after.path")) > shared(path, F.col("before.path"))
    return both.select("job_id", F.when(closer, F.col("after.id")).otherwise(F.col("before.id")).alias("other_id")).where(
        "other_id IS NOT NULL"
    )


def main_text(
    files: DataFrame, *, job_id: str = "job_id", filename: str = "filename", content: str = "content"
) -> DataFrame:
    """One row per page: job_id, filename (its URL), text, n_shared (lines the neighbour has too).

    Lines are blocks with white space inside made one blank, joined by a line feed in page order;
    ``br`` is white space. Text is what lies in article elements; without any, what lies in no
    side part and is not shared with the nearest page of the host. Nothing else is left out.

    Null and empty contents give an empty text. Pages without a URL form a host of their own.
    Job ids are unique: rows that repeat one are given the same lines. No rows in, no rows out.
    Other columns are ignored. Pages are numbered in host order by ranges, so a large host is
    spread; only 64-bit hashes of lines meet, contents move once at most.
    """
    table = files.select(
        F.col(job_id).alias("job_id"),
        F.col(filename).cast("string").alias("filename"),
        F.coalesce(F.col(content).cast("string"), F.lit("")).alias("content"),
    )
    kind = table.schema["job_id"].dataType.simpleString()
    outline = ids_as_text(table, "job_id").mapInPandas(
        _outline, "job_id string, host string, path string, has_main boolean, lines array<long>"
    )
    outline = cut(ids_as(outline, kind, "job_id"), "outline")
    pairs = _neighbours(cut(_in_order(outline, kind), "places"))
    lines = outline.select("job_id", "has_main", "lines")
    other = outline.select(F.col("job_id").alias("other_id"), F.col("lines").alias("other_lines"))

    def shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            marks = [np.flatnonzero(common_lines(a, b)) for a, b in zip(frame["lines"], frame["other_lines"], strict=True)]
            yield pd.DataFrame({"job_id": frame["job_id"], "n_shared": [len(m) for m in marks], "shared": pd.Series(marks, dtype=object)})

    found = lines.join(pairs, "job_id").join(other, "other_id").select("job_id", "lines", "other_lines")
    found = ids_as_text(found, "job_id").mapInPandas(shared, "job_id string, n_shared long, shared array<int>")
    found = ids_as(found, kind, "job_id")
    found = cut(found.where("n_shared > 0").dropDuplicates(["job_id"]), "shared")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = zip(frame["job_id"], frame["filename"], frame["content"], frame["n_shared"], frame["shared"], strict=True)
            for some in slices(rows, lambda r: len(r[2]), 8_000_000):
                out = []
                for key, url, html, n, marks in some:
                    page = page_lines(html)
                    if any(zone == MAIN for zone, _ in page):
                        text = [t for zone, t in page if zone == MAIN]
                    else:
                        gone = set() if marks is None else set(marks)
                        text = [t for i, (_, t) in enumerate(page) if i not in gone]
                    out.append((key, url, "\n".join(text), int(n)))
                yield pd.DataFrame(out, columns=["job_id", "filename", "text", "n_shared"])

    ready = table.join(found, "job_id", "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0).cast("long")))
    ready = ids_as_text(ready.select("job_id", "filename", "content", "n_shared", "shared"), "job_id")
    return ids_as(ready.mapInPandas(write, "job_id string, filename string, text string, n_shared long"), kind, "job_id")
