"""Boilerplate and scanning-noise removal inside each document.

A document's lines never leave its row: line counts come from sorting the row's own lines,
where a line that occurs N times or more equals the line N-1 places on. That is
O(n log n) per document and needs no explode and no shuffle of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgate.config import EnrichmentRules
from inkgate.functions import text as tx


def _numbered_lines(text: Column) -> Column:
    """Non-blank stripped lines with their position, sorted by line."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda line, i: F.struct(tx.strip(line).alias("line"), i.alias("pos")),
    )
    return F.sort_array(F.filter(lines, lambda e: e["line"] != ""))


def _in_long_run(ordered: Column, index: Column, run: int) -> Column:
    """Whether the line at ``index`` of the sorted lines occurs at least ``run`` times."""
    found = F.lit(False)
    for back in range(run):
        first = F.get(ordered, index - back)["line"]
        last = F.get(ordered, index - back + (run - 1))["line"]
        found = found | F.coalesce(first == last, F.lit(False))
    return found


def clean_text(
    df: DataFrame,
    rules: EnrichmentRules | None = None,
    *,
    text: str = "text",
    output: str = "cleaned_text",
) -> DataFrame:
    """Add the cleaned text: repeated lines, page numbers, borders and gibberish dropped,
    noise symbols removed from what is left, line order kept."""
    rules = rules or EnrichmentRules()

    def dropped(line: Column) -> Column:
        verdict = tx.is_page_number(line) | tx.is_border(line)
        if rules.gibberish_detection_enabled:
            verdict = verdict | tx.is_gibberish(
                line,
                ratio=rules.gibberish_short_token_ratio,
                min_tokens=rules.gibberish_min_tokens,
            )
        return verdict

    df = df.withColumn("_lines", _numbered_lines(tx.nfc(F.col(text))))
    lines = F.col("_lines")
    kept = F.filter(
        lines,
        lambda e, i: ~_in_long_run(lines, i, rules.repeated_line_min_count)
        & ~dropped(e["line"]),
    )
    in_order = F.sort_array(
        F.transform(kept, lambda e: F.struct(e["pos"].alias("pos"), e["line"].alias("line")))
    )
    denoised = F.transform(in_order, lambda e: tx.strip_noise(e["line"]))
    joined = F.array_join(F.filter(denoised, lambda line: line != ""), "\n")
    return df.withColumn(output, joined).drop("_lines")


def repeated_lines(
    df: DataFrame,
    rules: EnrichmentRules | None = None,
    *,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(key, line, occurrences) of the lines cleaning would drop as headers or footers.

    The counting aggregate combines within each document's own partition first, so only
    distinct lines are shuffled.
    """
    rules = rules or EnrichmentRules()
    lines = df.select(key, F.explode(F.split(tx.nfc(F.col(text)), "\n")).alias("_raw"))
    return (
        lines.select(key, tx.strip(F.col("_raw")).alias("line"))
        .where(F.col("line") != "")
        .groupBy(key, "line")
        .agg(F.count("*").alias("occurrences"))
        .where(F.col("occurrences") >= rules.repeated_line_min_count)
    )


def gibberish_lines(
    df: DataFrame,
    rules: EnrichmentRules | None = None,
    *,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(key, line_no, line, short_ratio) of the lines that look like failed recognition."""
    rules = rules or EnrichmentRules()
    lines = df.select(
        key, F.posexplode(F.split(tx.nfc(F.col(text)), "\n")).alias("line_no", "_raw")
    )
    lines = lines.select(key, "line_no", tx.strip(F.col("_raw")).alias("line")).where(
        F.col("line") != ""
    )
    return lines.where(
        tx.is_gibberish(
            F.col("line"),
            ratio=rules.gibberish_short_token_ratio,
            min_tokens=rules.gibberish_min_tokens,
        )
    ).withColumn("short_ratio", tx.short_word_ratio(F.col("line")))
