"""MIME type from leading bytes, as one expression without joins or Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkgate import fixed_values as fv


# Leading bytes looked at, as hex; no signature at the start of a file is longer.
_HEAD_BYTES = max(len(magic) // 2 for _, offset, magic in fv.SIGNATURES if offset == 0)


def _by_length() -> dict[int, dict[str, str]]:
    """Signatures at the start of a file, by their number of bytes. None is the beginning of
    another one, so at most one matches."""
    tables: dict[int, dict[str, str]] = {}
    for mime, offset, magic in fv.SIGNATURES:
        if offset == 0:
            tables.setdefault(len(magic) // 2, {})[magic] = mime
    for magic in fv.ZIP_SIGNATURES:
        tables.setdefault(len(magic) // 2, {})[magic] = fv.ZIP_MIME
    return tables


def _constant_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for entry in entries.items() for part in entry])


def detect_mime(content: Column) -> Column:
    """The matching signature's type; unrecognised bytes get the generic type.

    A few lookups in constant maps: small enough to be repeated in a plan when a filter on a
    verdict is pushed down to the scan.
    """
    head = F.hex(F.substring(content, 1, _HEAD_BYTES))
    lookups = [
        F.try_element_at(_constant_map(table), F.substring(head, 1, 2 * n_bytes))
        for n_bytes, table in sorted(_by_length().items(), reverse=True)
    ]
    elsewhere = [
        F.when(F.substring(content, offset + 1, len(magic) // 2) == F.unhex(F.lit(magic)), mime)
        for mime, offset, magic in fv.SIGNATURES
        if offset > 0
    ]
    kind = F.hex(F.substring(content, 9, 4))
    riff = F.when(
        F.startswith(head, F.lit("52494646")),
        F.try_element_at(_constant_map({magic: mime for mime, magic in fv.RIFF_KINDS}), kind),
    )
    ftyp = F.when(
        F.hex(F.substring(content, 5, 4)) == "66747970",
        F.coalesce(
            F.try_element_at(_constant_map({magic: mime for mime, magic in fv.FTYP_KINDS}), kind),
            F.lit(fv.FTYP_MIME),
        ),
    )
    mime = F.coalesce(*lookups, riff, ftyp, *elsewhere, F.lit(fv.UNKNOWN_MIME))
    ebml = F.substring(content, 1, fv.EBML_HEAD_BYTES)
    members = F.when((mime == fv.EBML_MIME) & F.contains(ebml, F.unhex(F.lit(fv.EBML_KINDS[0][1]))), fv.EBML_KINDS[0][0])
    raw, mark = fv.TIFF_KINDS[0]
    members = members.when((mime == fv.TIFF_MIME) & (F.substring(content, 9, 2) == F.unhex(F.lit(mark))), raw)
    members = members.when(mime != fv.ZIP_MIME, mime)
    for kind in fv.ZIP_STORED_KINDS:
        told = f"mimetype{kind}"
        members = members.when(F.substring(content, 31, len(told)) == F.encode(F.lit(told), "UTF-8"), kind)
    for kind, folder in fv.ZIP_MEMBER_FOLDERS:
        members = members.when(F.contains(content, F.encode(F.lit(folder), "UTF-8")), kind)
    return members.otherwise(fv.ZIP_MIME)
