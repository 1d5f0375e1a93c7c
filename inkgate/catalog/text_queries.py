"""Text cleaning, language, signals and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgate import fixed_values as fv
from inkgate.catalog import bindings as b
from inkgate.operators import cleaning, entities, language


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = b.documents(spark, folder).select("doc_id", "text")
    return cleaning.clean_text(docs).select("doc_id", "cleaned_text")


_SPLIT = f"'[{b.WS_CLASS}]+'"
LINES_CTE = f"""
raw_lines AS (
  SELECT doc_id, unnest(string_split(nfc_normalize(text), chr(10))) AS raw,
         generate_subscripts(string_split(nfc_normalize(text), chr(10)), 1) AS pos
  FROM documents),
lines AS (
  SELECT doc_id, pos, trim(raw, {b.WS_SQL}) AS line FROM raw_lines
  WHERE trim(raw, {b.WS_SQL}) <> ''),
worded AS (
  SELECT *, regexp_split_to_array(line, {_SPLIT}) AS words,
         count(*) OVER (PARTITION BY doc_id, line) AS occurrences FROM lines),
measured AS (
  SELECT *, len(list_filter(words, lambda w: length(w) <= {fv.GIBBERISH_MAX_SHORT_TOKEN_LEN}))
            / len(words) AS short_ratio FROM worded)"""
_GIBBERISH = (
    f"(len(words) >= {fv.GIBBERISH_MIN_TOKENS}"
    f" AND short_ratio >= {fv.GIBBERISH_SHORT_TOKEN_RATIO})"
)
_NOISE_SQL = fv.NOISE_PATTERN.replace("'", "''")
_PAGE_SQL = (
    rf"(?i)^(p[aá]gina[{b.WS_CLASS}]+)?\p{{Nd}}+([{b.WS_CLASS}]*/[{b.WS_CLASS}]*\p{{Nd}}+)?$"
)
CLEAN_CTES = f"""{LINES_CTE},
kept_lines AS (
  SELECT doc_id, pos,
    regexp_replace(regexp_replace(line, '{_NOISE_SQL}', '', 'g'), ' {{2,}}', ' ', 'g') AS line
  FROM measured
  WHERE occurrences < {fv.REPEATED_LINE_MIN_COUNT}
    AND NOT regexp_matches(line, '{_PAGE_SQL}')
    AND NOT regexp_matches(line, '^[{b.WS_CLASS}\\-]+$')
    AND NOT {_GIBBERISH}),
cleaned AS (
  SELECT d.doc_id, d.text, coalesce(k.cleaned_text, '') AS cleaned_text
  FROM documents d LEFT JOIN (
    SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS cleaned_text
    FROM kept_lines WHERE line <> '' GROUP BY doc_id) k USING (doc_id))"""
CLEAN_TEXT = f"WITH {CLEAN_CTES} SELECT doc_id, cleaned_text FROM cleaned"


def cleaning_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Characters in and out of cleaning by language."""
    docs = b.documents(spark, folder).select("doc_id", "lang", "text")
    cleaned = cleaning.clean_text(docs)
    return cleaned.groupBy("lang").agg(
        F.count("*").alias("docs"),
        F.sum(F.length("text")).alias("input_chars"),
        F.sum(F.length("cleaned_text")).alias("output_chars"),
    )


CLEANING_STATS = f"""
WITH {CLEAN_CTES}
SELECT lang, count(*) AS docs, CAST(sum(length(c.text)) AS BIGINT) AS input_chars,
       CAST(sum(length(cleaned_text)) AS BIGINT) AS output_chars
FROM cleaned c JOIN documents USING (doc_id) GROUP BY lang
"""


def repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.repeated_lines(b.documents(spark, folder))


REPEATED_LINES = f"""
WITH {LINES_CTE}
SELECT doc_id, line, count(*) AS occurrences FROM lines GROUP BY 1, 2
HAVING count(*) >= {fv.REPEATED_LINE_MIN_COUNT}
"""


def gibberish_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = cleaning.gibberish_lines(b.documents(spark, folder))
    return found.select("doc_id", "line_no", "line", F.round("short_ratio", 6).alias("short_ratio"))


GIBBERISH_LINES = f"""
WITH {LINES_CTE}
SELECT doc_id, CAST(pos - 1 AS INTEGER) AS line_no, line, round(short_ratio, 6) AS short_ratio
FROM measured WHERE {_GIBBERISH}
"""


def detect_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = b.documents(spark, folder).select("doc_id", "text", "lang")
    profiles = language.learn_profiles(docs)
    return language.detect_language(docs, profiles)


DETECT_LANGUAGE = f"""
WITH grams AS (
  SELECT doc_id, lang, unnest(regexp_extract_all(substring(lower(text), start), '(?s)...')) AS gram
  FROM documents, (SELECT unnest([1, 2, 3]) AS start) s),
counts AS (SELECT lang, gram, count(*) AS n FROM grams GROUP BY 1, 2),
totals AS (SELECT lang, sum(n) AS total FROM counts GROUP BY 1),
vocabulary AS (SELECT DISTINCT gram FROM counts),
profile AS (
  SELECT v.gram, t.lang,
    CAST(round(ln((coalesce(c.n, 0) + 1) / (t.total + (SELECT count(*) FROM vocabulary)))
         * {language.WEIGHT_SCALE}) AS BIGINT) AS w
  FROM vocabulary v CROSS JOIN totals t LEFT JOIN counts c ON c.gram = v.gram AND c.lang = t.lang),
doc_grams AS (SELECT doc_id, gram, count(*) AS n FROM grams GROUP BY 1, 2),
scores AS (
  SELECT doc_id, p.lang, sum(n * w) AS s FROM doc_grams JOIN profile p USING (gram) GROUP BY 1, 2),
best AS (
  SELECT doc_id, lang FROM scores QUALIFY
    row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) = 1)
SELECT d.doc_id, coalesce(best.lang, 'unknown') AS language
FROM documents d LEFT JOIN best USING (doc_id)
"""


def legitimacy_signals(spark: SparkSession, folder: str) -> DataFrame:
    docs = b.documents(spark, folder).select("doc_id", F.upper("text").alias("text"))
    counted = entities.signal_counts(docs)
    return counted.select(
        "doc_id",
        F.array_join(F.transform("signals", lambda n: n.cast("string")), ",").alias("signals"),
        F.col("n_signals").cast("bigint").alias("n_signals"),
    )


def _occurrences(marker: str) -> str:
    return f"len(regexp_extract_all(upper(text), '{marker}'))"


LEGITIMACY_SIGNALS = f"""
SELECT doc_id, concat_ws(',', {", ".join(_occurrences(m) for m in fv.ACT_MARKERS)}) AS signals,
       {" + ".join(_occurrences(m) for m in fv.ACT_MARKERS)} AS n_signals
FROM documents
"""


def rule_entities(spark: SparkSession, folder: str) -> DataFrame:
    docs = b.documents(spark, folder).select("doc_id", "text")
    found = docs.withColumn("e", entities.rule_entities(F.col("text")))
    return found.select(
        "doc_id", "e.doc_type_hint", "e.number", "e.year", "e.issuing_body", "e.article_count"
    )


RULE_ENTITIES = """
SELECT doc_id,
  nullif(replace(regexp_extract(lower(text), '(ordenanza|decreto|resoluci[oó]n)', 1), 'ó', 'o'), '')
    AS doc_type_hint,
  nullif(regexp_extract(lower(text), 'n[°º]\\s*([0-9][0-9./-]*)', 1), '') AS number,
  TRY_CAST(regexp_extract(' ' || replace(lower(text), chr(10), ' ') || ' ',
    '[^0-9]((?:19|20)[0-9]{2})[^0-9]', 1) AS INTEGER) AS year,
  CAST(NULL AS VARCHAR) AS issuing_body,
  CAST(len(regexp_extract_all(lower(text), 'art[ií]culo\\s+[0-9]+')) AS INTEGER) AS article_count
FROM documents
"""

QUERIES = {
    "clean_text": clean_text,
    "cleaning_stats": cleaning_stats,
    "repeated_lines": repeated_lines,
    "gibberish_lines": gibberish_lines,
    "detect_language": detect_language,
    "legitimacy_signals": legitimacy_signals,
    "entities": rule_entities,
}
ORACLES = {
    "clean_text": CLEAN_TEXT,
    "cleaning_stats": CLEANING_STATS,
    "repeated_lines": REPEATED_LINES,
    "gibberish_lines": GIBBERISH_LINES,
    "detect_language": DETECT_LANGUAGE,
    "legitimacy_signals": LEGITIMACY_SIGNALS,
    "entities": RULE_ENTITIES,
}
