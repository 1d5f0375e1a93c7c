"""The whole gate over a table of files.

One narrow stage reads the files and writes their texts and, apart from these, what later steps
need of them. Only lean columns keyed by job are joined; texts are read again by the language
hook and the duplicate check, for the documents that reach them, and by whoever asks for
``with_texts``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgate.config import GateRules
from inkgate.functions.mime import detect_mime
from inkgate.operators import answers, gates
from inkgate.operators.duplicates import Control, Store, VectorStore, duplicate_control
from inkgate.operators.extraction import Loader, extract_in_passes, extract_in_row, is_column
from inkgate.session import cut

Lookup = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class IngestRun:
    """``results``: one row per file with its step structs, status and reason, a written table;
    ``extraction`` has no text there. ``texts``(job_id, text): what extraction found, written too. ``control``:
    verdicts of the last check and what it adds to the store of later runs.
    """

    results: DataFrame
    texts: DataFrame
    control: Control

    def with_texts(self, results: DataFrame | None = None) -> DataFrame:
        """``results``, or some of their rows, with ``extraction.text``: the one join that moves
        texts, for sinks that store them."""
        results = self.results if results is None else results
        named = self.texts.select("job_id", F.col("text").alias("_text"))
        filled = F.when(F.col("extraction").isNotNull(), F.col("extraction").withField("text", F.col("_text")))
        return results.join(named, "job_id", "left").withColumn("extraction", filled).drop("_text")


def _extracted(
    staged: DataFrame, extractors: Sequence[tuple[str, Column | Loader]], rules: GateRules, hopeful: Column
) -> DataFrame:
    """``staged`` with ``extraction`` for the rows that are worth it."""
    if all(is_column(text) for _, text in extractors):
        return extract_in_row(staged, extractors, rules.extraction, reached=hopeful)
    found = extract_in_passes(staged.where(hopeful), extractors, rules.extraction)
    return staged.join(found, "job_id", "left")


def ingest(
    files: DataFrame,
    extractors: Sequence[tuple[str, Column | Loader]],
    responses: DataFrame,
    rules: GateRules | None = None,
    *,
    store: Store | VectorStore | None = None,
    mime: Callable[[Column], Column] = detect_mime,
    language: Lookup | None = None,
    embed: Lookup | None = None,
) -> IngestRun:
    """Judge files(job_id, arrival, filename, content, ...).

    ``extractors`` are (name, text) pairs by rank: a column over the file columns, or a loader of a
    function (content, filename) -> text, which sees only files that are still short of text.
    ``responses`` holds (job_id, task, response) answers of the models. Order of arrival decides
    between duplicates; ``store`` holds what earlier runs accepted.

    ``mime`` tells a body's type. ``language`` takes the extracted texts(id, text) and gives (id,
    language); without it files have a column ``language``. ``embed`` takes the texts(id, text)
    of documents that reach the duplicate check and gives (id, vec): they are then compared by
    these vectors, else by their words.
    """
    rules = rules or GateRules()
    df = gates.receive(files, rules.formats, mime=mime)
    staged = gates.check_format(df, rules.formats)
    # the text is worth extracting for what passes now or may pass once a model has answered
    hopeful = F.col("format_validation.passed") | (
        F.col("format_validation.decision") == "slm_escalate"
    )
    staged = _extracted(staged, extractors, rules, F.coalesce(hopeful, F.lit(False)))
    text = F.col("extraction.text")
    kept = [c for c in ("job_id", "arrival", "filename", "language") if c in files.columns]
    staged = cut(
        staged.select(
            *kept,
            "reception",
            F.when(F.col("extraction").isNotNull(), F.col("extraction").dropFields("text")).alias("extraction"),
            F.length(text).alias("text_chars"),
            text.alias("text"),
        ),
        "staged",
    )
    texts = staged.where("text IS NOT NULL").select("job_id", "text")
    lean = staged.drop("text")
    if language is not None:
        told = language(texts.select(F.col("job_id").alias("id"), "text"))
        told = told.select(F.col("id").alias("job_id"), F.col("language").alias("language"))
        lean = lean.drop("language").join(cut(told, "languages"), "job_id", "left")
    lean = answers.with_response(lean, responses, answers.FORMAT_TASK, "_format_response")
    lean = answers.parse_format(lean, "_format_response")
    lean = gates.check_format(lean, rules.formats, answer="format_answer")
    lean = answers.with_response(lean, responses, answers.CONTENT_TASK, "_response")
    lean = answers.parse_legitimacy(lean, "_response")
    reached = F.col("format_validation.passed") & F.col("extraction").isNotNull()
    lean = lean.withColumn("extraction", F.when(reached, F.col("extraction")))
    lean = gates.check_content(lean, rules.content, response="_response", chars="text_chars")
    lean = cut(
        lean.select(
            "job_id", "arrival", "filename", "reception", "extraction", "format_validation", "content_validation"
        ),
        "gates",
    )

    admitted = lean.where(F.col("content_validation.passed")).select(
        F.col("job_id").alias("id"), "arrival", F.col("reception.sha256").alias("sha256")
    )
    named = texts.select(F.col("job_id").alias("id"), "text")
    vectors = None
    if embed is not None:
        vectors = cut(embed(named.join(admitted.select("id"), "id", "left_semi")), "vectors")
    control = duplicate_control(
        admitted,
        named,
        vectors=vectors,
        threshold=rules.duplicates.cosine_similarity_threshold,
        store=store,
    )

    results = lean.join(
        control.verdicts.withColumnRenamed("id", "job_id"), "job_id", "left"
    )
    return IngestRun(cut(gates.route(results), "results"), texts, control)
