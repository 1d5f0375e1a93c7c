from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from inkgate import fixed_values as fv
from inkgate.config import ContentRules, ExtractionRules, FormatRules
from inkgate.functions import text as tx
from inkgate.functions.mime import detect_mime
from inkgate.operators import answers, extraction, gates


def test_reception_branches(spark):
    rules = FormatRules(max_file_size_mb=1)
    big = b"x" * (1024 * 1024 + 1)
    files = spark.createDataFrame(
        [("none", None), ("empty", b""), ("big", big), ("pdf", b"%PDF-1.4 body")],
        "job_id string, content binary",
    )
    rows = {r.job_id: r.reception for r in gates.receive(files, rules).collect()}
    assert not rows["none"].passed and rows["none"].rejection_reason == "No file provided"
    assert rows["none"].file_size_bytes == 0 and rows["none"].sha256 == ""
    assert rows["empty"].rejection_reason == "File is empty"
    assert rows["big"].rejection_reason == "File exceeds maximum allowed size of 1 MB"
    assert rows["big"].file_size_bytes == len(big) and rows["big"].sha256 == ""
    assert rows["pdf"].passed and rows["pdf"].detected_mime == "application/pdf"
    assert rows["pdf"].sha256 == hashlib.sha256(b"%PDF-1.4 body").hexdigest()


def test_signatures_do_not_shadow_each_other(spark):
    starts = [(m, bytes.fromhex(h)) for m, at, h in fv.SIGNATURES if at == 0]
    for mime, magic in starts:
        others = [o for m, o in starts if o != magic and m != mime]
        assert not any(magic.startswith(o) for o in others), mime
    tar = b"\0" * 257 + b"ustar"
    rows = [(m, magic + b"rest of file") for m, magic in starts]
    rows += [
        ("application/x-tar", tar),
        ("application/octet-stream", b"plain"),
        ("application/octet-stream", b""),
        ("application/zip", b"PK\x03\x04 some member"),
        (fv.ZIP_MEMBER_FOLDERS[0][0], b"PK\x03\x04 .. word/document.xml"),
        (fv.ZIP_MEMBER_FOLDERS[1][0], b"PK\x03\x04 .. xl/workbook.xml"),
    ]
    df = spark.createDataFrame(rows, "want string, content binary")
    wrong = df.where(detect_mime(F.col("content")) != F.col("want")).collect()
    assert wrong == []


@pytest.mark.parametrize(
    ("filename", "mime", "decision"),
    [
        ("sample.pdf", "application/pdf", "accept"),
        ("page.html", "text/html", "reject"),
        ("file.html", "application/octet-stream", "reject"),
        ("file.HTM", "application/octet-stream", "reject"),
        ("file.xyz", "application/x-unknown", "manual_review"),
        ("document.docx", "application/pdf", "slm_escalate"),
        ("photo.jpg", "image/jpeg", "accept"),
        ("photo.jpeg", "image/jpeg", "accept"),
        ("report.docx", "application/zip", "accept"),
        ("report.pdf", "application/zip", "manual_review"),
        ("anything.txt", "application/octet-stream", "accept"),
        ("noextension", "application/pdf", "slm_escalate"),
    ],
)
def test_format_rules(spark, filename, mime, decision):
    row = spark.range(1).select(
        gates.format_rule(F.lit(filename), F.lit(mime), FormatRules()).alias("d")
    )
    assert row.first().d == decision


def test_suffix_like_pathlib(spark):
    import pathlib

    names = [".pdf", "x.", "a.tar.gz", "dir.d/name", "A.PDF", "a..b", "/x/y.Z/", "plain", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.s for r in df.select("n", tx.file_suffix(F.col("n")).alias("s")).collect()}
    assert got == {n: pathlib.PurePosixPath(n).suffix.lower() for n in names}


def test_escalation_answers(spark):
    rows = [
        ("ok", '{"decision": "accept", "reasoning": "typo"}'),
        ("no", 'Sure {"decision": "reject", "confidence": 0.9, "reasoning": "disguise"}'),
        ("rev", '{"decision": "manual_review"}'),
        ("esc", '{"decision": "slm_escalate"}'),
        ("bad", "not json"),
        ("none", None),
    ]
    df = spark.createDataFrame(rows, "job_id string, response string").select(
        "job_id",
        "response",
        F.lit("document.docx").alias("filename"),
        F.struct(F.lit(True).alias("passed"), F.lit("application/pdf").alias("detected_mime"), F.lit("").alias("rejection_reason")).alias("reception"),
    )
    judged = gates.check_format(answers.parse_format(df, "response"), answer="format_answer")
    empty = F.lit(None).cast("struct<passed:boolean,needs_agent_review:boolean,rejection_reason:string>")
    routed = gates.route(
        judged.withColumn("content_validation", empty).withColumn("duplicate_control", empty)
    )
    got = {r.job_id: (r.format_validation.decision, r.format_validation.used_slm, r.status, r.rejection_reason) for r in routed.collect()}
    assert got["ok"][:2] == ("accept", True)
    assert got["no"] == ("reject", True, "rejected", "SLM: disguise")
    assert got["rev"][:3] == ("manual_review", True, "review")
    assert got["esc"][:3] == ("slm_escalate", True, "rejected")
    assert got["bad"][:3] == ("slm_escalate", False, "review")
    assert got["none"][:3] == ("slm_escalate", False, "review")


X, Y, Z = "x", "y", "z"


@pytest.mark.parametrize(
    ("first", "second", "want"),
    [
        (X * 50, Y * 60, (X * 50, "one", 50)),
        (X * 49, Y * 20, (Y * 20, "two", 20)),
        (None, None, ("", "", 0)),
        (X * 49, Y * 19, ("", "two", 19)),
        (Z * 21, None, (Z * 21, "one", 21)),
        (None, Y * 30, (Y * 30, "two", 30)),
        ("", "", ("", "two", 0)),
    ],
)
def test_extraction_choice_is_the_same_long_and_wide(spark, first, second, want):
    rows = [
        ("j", rank, name, text, None if text is not None else "failed")
        for rank, name, text in ((1, "one", first), (2, "two", second))
    ]
    attempts = spark.createDataFrame(
        rows, "job_id string, rank int, extractor string, text string, error string"
    )
    long = extraction.from_attempts(attempts, ExtractionRules()).first().extraction
    wide_in = spark.createDataFrame([("j", first, second)], "job_id string, a string, b string")
    wide = extraction.extract_in_row(
        wide_in, [("one", F.col("a")), ("two", F.col("b"))]
    ).first().extraction
    assert (long.text, long.extractor_used, long.char_count) == want
    assert long == wide


SPANISH = "El presente documento establece las normas de la ciudad para el año en curso."


def test_content_branches(spark):
    rules = ContentRules(
        min_chars=20, ocr_char_threshold=10, allowed_languages=("es",), slm_confidence_threshold=0.75
    )
    good = '{"is_legitimate": true, "confidence": 0.92, "reasoning": "r"}'
    rows = [
        ("empty_pdf", "", "application/pdf", "es", good),
        ("empty_docx", "", "application/docx", "es", good),
        ("short", "Short text.", "application/pdf", "es", good),
        ("french", SPANISH, "application/pdf", "fr", good),
        ("none", SPANISH, "application/pdf", None, good),
        ("pass", SPANISH, "application/pdf", "es", good),
        ("not_legit", SPANISH, "application/pdf", "es", good.replace("true", "false")),
        ("low", SPANISH, "application/pdf", "es", good.replace("0.92", "0.5")),
        ("edge", SPANISH, "application/pdf", "es", good.replace("0.92", "0.75")),
        ("broken", SPANISH, "application/pdf", "es", "not json"),
    ]
    df = spark.createDataFrame(
        rows, "job_id string, text string, mime string, language string, response string"
    ).select(
        "job_id",
        "language",
        "response",
        F.struct("text").alias("extraction"),
        F.struct(F.col("mime").alias("detected_mime")).alias("reception"),
    )
    judged = gates.check_content(
        answers.parse_legitimacy(df, "response"), rules, response="response"
    )
    got = {r.job_id: r.content_validation for r in judged.collect()}
    assert got["empty_pdf"].requires_ocr and got["empty_pdf"].needs_agent_review
    assert not got["empty_docx"].requires_ocr and not got["empty_docx"].needs_agent_review
    assert got["short"].rejection_reason == "Text too short: 11 chars (min 20)"
    assert got["french"].needs_agent_review and got["french"].detected_language == "fr"
    assert got["none"].rejection_reason == "Language not allowed: unknown"
    assert got["pass"].passed and got["pass"].confidence == 0.92
    assert got["edge"].passed
    assert got["not_legit"].needs_agent_review and not got["not_legit"].passed
    assert got["low"].rejection_reason.endswith("(confidence 0.50 below 0.75 threshold)")
    assert got["broken"].rejection_reason.startswith("SLM response could not be parsed")
    assert got["broken"].needs_agent_review and got["broken"].confidence == 0.0


def test_containers_are_told_apart(spark):
    kinds = {
        b"RIFF\x10\0\0\0WEBPVP8 ": "image/webp",
        b"RIFF\x10\0\0\0WAVEfmt ": "audio/x-wav",
        b"RIFF\x10\0\0\0none": "application/octet-stream",
        b"\0\0\0\x18ftypheic": "image/heic",
        b"\0\0\0\x18ftypmp42": "video/mp4",
        b"\0\0\0\x18ftypqt  ": "video/quicktime",
        b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1\0": "application/msword",
        b"\0asm\1\0\0\0": "application/wasm",
        b"PK\3\4" + bytes(26) + b"mimetypeapplication/epub+zip": "application/epub+zip",
        b"PK\3\4" + bytes(26) + b"mimetypeapplication/vnd.oasis.opendocument.textPK": "application/vnd.oasis.opendocument.text",
        b"\x1a\x45\xdf\xa3" + bytes(20) + b"\x42\x82\x84webm": "video/webm",
        b"\x1a\x45\xdf\xa3" + bytes(20) + b"\x42\x82\x88matroska": "video/x-matroska",
        b"\xff\xfb\x90": "audio/mpeg",
        b"\xff\xf1\x50": "audio/aac",
        b"!<arch>\ndebian-binary": "application/x-deb",
        b"!<arch>\nother": "application/x-unix-archive",
        b"II*\0\x10\0\0\0CR": "image/x-canon-cr2",
        b"II*\0\x08\0\0\0": "image/tiff",
        bytes(128) + b"DICM": "application/dicom",
        b"\x28\xb5\x2f\xfd": "application/zstd",
        b"FORM\0\0\0\4AIFF": "audio/x-aiff",
    }
    rows = [(bytearray(lead), mime) for lead, mime in kinds.items()]
    table = spark.createDataFrame(rows, "content binary, want string")
    got = table.select(detect_mime(F.col("content")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
