"""WARC files of ingested pages: written with revisits and segments, read back and reassembled.

A page is a file of the gate: ``filename`` (its URL), ``content`` (bytes) and a ``job_id``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgate.llm.common import ids_as_text, slices
from inkgate.llm.files import read_bytes, write_bytes
from inkgate.session import cut

# Payloads of equal bytes are stored once from this size on.
REVISIT_BYTES = 1000
# Blocks above this size go into segments of it.
SEGMENT_BYTES = 16_384
# Fixed values of the format.
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_TYPE = "application/http; msgtype=response"


def _record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def frame_chunks(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    parts = [payload[at : at + size] for at in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unframe_chunks(body: bytes) -> bytes:
    """Payload of a chunked body; extensions of chunks and trailing fields are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def write_archives(
    files: DataFrame,
    path: str,
    *,
    job_id: str = "job_id",
    filename: str = "filename",
    content: str = "content",
    revisit_bytes: int = REVISIT_BYTES,
    segment_bytes: int = SEGMENT_BYTES,
) -> None:
    """Write a record for every file: its response, or a revisit of an equal payload's response.

    Of equal payloads of at least ``revisit_bytes`` the one with the largest job id is the
    response. Blocks above ``segment_bytes`` are framed in chunks and cut into a first segment
    and continuation records. Null contents are empty payloads, a null filename an empty URL.
    Job ids are unique; no rows give no archive. Other columns are ignored.

    Only digests meet in the search for equal payloads; contents move once, by job id.
    """
    rows = files.select(
        F.col(job_id).alias("job_id"),
        F.regexp_replace(F.coalesce(filename, F.lit("")), r"[\s\x00-\x1f]+", "%20").alias("filename"),
        F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("content"),
    )
    digests = cut(
        rows.where(F.length("content") >= revisit_bytes).select("job_id", F.sha1("content").alias("sha1")), "digests"
    )
    first = digests.groupBy("sha1").agg(F.max("job_id").alias("origin"), F.count(F.lit(1)).alias("n"))
    repeats = digests.join(cut(first.where("n > 1"), "repeats"), "sha1").where("job_id <> origin")
    marked = rows.join(repeats.select("job_id", "origin"), "job_id", "left")

    def archive(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            triples = zip(frame["job_id"], frame["filename"], frame["content"], frame["origin"], strict=True)
            for some in slices(triples, lambda r: len(r[2]), 4_000_000):
                out = []
                for key, url, payload, origin in some:
                    out.extend(_page_records(key, url, bytes(payload), origin, segment_bytes))
                yield pd.DataFrame({"content": out})

    named = ids_as_text(marked, "job_id", "origin")
    write_bytes(named.mapInPandas(archive, "content binary"), path, b"\n", gzip=True)


def _page_records(key, url: str, payload: bytes, origin, segment_bytes: int) -> list[bytes]:
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = _record_id(f"page:{key}")
    shared = [
        ("WARC-Record-ID", name),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", url or "about:blank"),
        ("WARC-Payload-Digest", digest),
        ("X-Job-Id", key),
    ]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    plain = head + b"Content-Length: %d\r\n\r\n" % len(payload)
    if origin is not None:
        fields = [
            ("WARC-Type", "revisit"),
            *shared,
            ("WARC-Profile", _PROFILE),
            ("WARC-Refers-To", _record_id(f"page:{origin}")),
            ("X-Refers-To-Job-Id", origin),
            ("Content-Type", _TYPE),
        ]
        return [_record(fields, plain)]
    block = plain + payload
    if len(block) <= segment_bytes:
        return [_record([("WARC-Type", "response"), *shared, ("Content-Type", _TYPE)], block)]
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + frame_chunks(payload, 4096)
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    out = [_record([("WARC-Type", "response"), *shared, ("WARC-Segment-Number", 1), ("Content-Type", _TYPE)], parts[0])]
    for number, part in enumerate(parts[1:], 2):
        total = len(block) if number == len(parts) else None
        fields = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", _record_id(f"page:{key}:{number}")),
            ("WARC-Date", _DATE),
            ("WARC-Target-URI", url or "about:blank"),
            ("WARC-Segment-Origin-ID", name),
            ("WARC-Segment-Number", number),
            ("WARC-Segment-Total-Length", total),
        ]
        out.append(_record(fields, part))
    return out


def parse_records(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """(fields by lower-case name, block) of every record of an archive."""
    content = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        at = end + 4
        size = int(fields["content-length"])
        yield fields, content[at : at + size]
        at += size + 4


_COLUMNS = "record_id string, job_id string, refers_to string, type string, uri string, digest string, number int, total long, block binary"


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ("record_id", "job_id", "refers_to", "type", "uri", "digest", "number", "total", "block")
    for frame in frames:
        for content in frame["content"]:
            for some in slices(parse_records(content), lambda r: len(r[1]), 4_000_000):
                rows = []
                for f, block in some:
                    number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                    rows.append(
                        (
                            f.get("warc-segment-origin-id") or f["warc-record-id"],
                            f.get("x-job-id"),
                            f.get("x-refers-to-job-id"),
                            f["warc-type"],
                            f.get("warc-target-uri"),
                            f.get("warc-payload-digest"),
                            int(number) if number else None,
                            int(total) if total else None,
                            block,
                        )
                    )
                table = pd.DataFrame(rows, columns=names)
                yield table.astype({"number": "Int32", "total": "Int64"})


def _payloads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Payload of each whole HTTP block, held against its digest."""
    for frame in frames:
        payloads, sizes, digests = [], [], []
        for kind, block, stated in zip(frame["type"], frame.pop("block"), frame.pop("digest"), strict=True):
            head, _, body = bytes(block).partition(b"\r\n\r\n")
            if kind == "revisit":
                payloads.append(None)
                sizes.append(int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1]))
                digests.append(base64.b32decode(stated.removeprefix("sha1:")).hex())
                continue
            body = unframe_chunks(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked", head) else body
            sha = hashlib.sha1(body).digest()
            if stated and stated.removeprefix("sha1:") != base64.b32encode(sha).decode():
                raise ValueError("a payload does not have the digest that its record states")
            payloads.append(body)
            sizes.append(len(body))
            digests.append(sha.hex())
        yield frame.assign(content=payloads, payload_bytes=sizes, payload_digest=digests)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of the archives: job_id, filename, content, record_type, refers_to,
    payload_bytes, payload_digest.

    Segments are grouped by the identifier of their origin, ordered by number and joined; a
    missing segment or another total length than stated fails. Whole records pass straight
    through. Revisits have no content, but size and digest of what they refer to. Archives are
    read file by file; a file must fit in a task's memory. Records without an id have a null one;
    no archives, no rows.
    """
    # scanned once for whole records and once for segments: dearer to keep than to read again
    records = read_bytes(spark, path).select("content").mapInPandas(_scan, _COLUMNS)
    whole = records.where("number IS NULL").drop("number", "total")
    segments = records.where("number IS NOT NULL")
    # one record's own segments: as much as its payload
    groups = segments.groupBy("record_id").agg(
        *(F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("job_id", "refers_to", "type", "uri", "digest")),
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"),
        F.max("total").alias("total"),
    )
    block = F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["block"]))
    sound = (
        (F.transform("parts", lambda x: x["number"]) == F.sequence(F.lit(1), F.size("parts")))
        & F.col("job_id").isNotNull()
        & (F.length("block") == F.col("total"))  # stated by the last segment
    )
    message = F.concat(F.lit("segments are missing or of another length: "), F.col("record_id"))
    joined = groups.withColumn("block", block).select(
        "record_id", "job_id", "refers_to", "type", "uri", "digest", F.when(sound, F.col("block")).otherwise(F.raise_error(message)).alias("block")
    )
    pages = whole.unionByName(joined).select("job_id", "refers_to", "type", "uri", "digest", "block")
    out = pages.mapInPandas(
        _payloads,
        "job_id string, refers_to string, type string, uri string, content binary, payload_bytes long, payload_digest string",
    )
    return out.withColumnsRenamed({"type": "record_type", "uri": "filename"})
