"""Text expressions with Python's notion of white space and letters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgate import fixed_values as fv


def strip(text: Column) -> Column:
    """Trim every Unicode white-space character, not only blanks."""
    return F.btrim(text, F.lit(fv.WHITESPACE_CHARS))


def words(text: Column) -> Column:
    """White-space separated pieces of an already stripped text."""
    return F.split(text, fv.WHITESPACE_RUN_PATTERN)


def char_count(text: Column) -> Column:
    """Length in code points."""
    return F.length(text).cast("int")


def excerpt(text: Column, chars: int) -> Column:
    """The opening characters a request to a model may carry."""
    return F.substring(text, 1, chars)


def file_suffix(filename: Column) -> Column:
    """Lower-cased suffix with its dot; empty for dot files and trailing dots."""
    last_part = F.element_at(F.split(F.regexp_replace(filename, "/+$", ""), "/"), -1)
    return F.lower(F.regexp_extract(last_part, fv.SUFFIX_PATTERN, 1))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def strip_noise(line: Column) -> Column:
    """Drop characters outside letters, digits, white space and common punctuation."""
    cleaned = F.regexp_replace(line, fv.NOISE_PATTERN, "")
    return F.regexp_replace(cleaned, fv.MULTI_SPACE_PATTERN, " ")


def is_page_number(line: Column) -> Column:
    return line.rlike(fv.PAGE_NUMBER_PATTERN)


def is_border(line: Column) -> Column:
    return line.rlike(fv.TABLE_BORDER_PATTERN)


def short_word_ratio(line: Column) -> Column:
    pieces = words(line)
    short = F.filter(pieces, lambda w: F.length(w) <= fv.GIBBERISH_MAX_SHORT_TOKEN_LEN)
    return F.size(short) / F.size(pieces)


def is_gibberish(line: Column, *, ratio: float, min_tokens: int) -> Column:
    """Lines made almost only of one- and two-character fragments."""
    return (F.size(words(line)) >= min_tokens) & (short_word_ratio(line) >= ratio)


@F.pandas_udf(T.StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode NFC. Texts below U+0300 are already composed and never leave the JVM."""
    needs_work = F.when(text.rlike(r"[\x{300}-\x{10FFFF}]"), text)
    return F.coalesce(_compose(needs_work), text)
