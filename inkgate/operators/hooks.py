"""Where outside code plugs in: extractors, models and embedders.

Each hook is given as a loader that Spark calls once per task; what it returns is then applied
batch by batch inside Arrow UDFs. Spark decides how many run at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTEMPT_SCHEMA = "job_id string, rank int, extractor string, text string, error string"
# Texts that a model is given at once.
MODEL_GROUP = 64
RESPONSE_SCHEMA = "job_id string, task string, attempt int, response string, error string"


def _guarded(call: Callable, *arguments: object) -> tuple[object, str | None]:
    """(result, None), or (None, message) when the hook fails on this row."""
    try:
        return call(*arguments), None
    except Exception as failure:  # noqa: BLE001 - a failing row must not fail the job
        return None, f"{type(failure).__name__}: {failure}"


def run_extractor(
    files: DataFrame, rank: int, name: str, load: Callable[[], Callable[[bytes, str], str]]
) -> DataFrame:
    """files(job_id, filename, content) -> attempt rows of one extractor, errors as values.

    Run a costly extractor only on files whose cheaper attempts were thin (``still_thin``).
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = load()
        for batch in batches:
            results = [
                _guarded(extractor, bytes(content), filename)
                for content, filename in zip(batch["content"], batch["filename"])
            ]
            yield pd.DataFrame(
                {
                    "job_id": batch["job_id"],
                    "rank": rank,
                    "extractor": name,
                    "text": [text for text, _ in results],
                    "error": [error for _, error in results],
                }
            )

    readable = files.where(F.col("content").isNotNull())
    return readable.select("job_id", "filename", "content").mapInPandas(extract, ATTEMPT_SCHEMA)


def still_thin(files: DataFrame, attempts: DataFrame, enough: int) -> DataFrame:
    """Files none of whose attempts gave enough text."""
    settled = attempts.where(F.col("error").isNull() & (F.length("text") >= enough))
    return files.join(settled.select("job_id").distinct(), "job_id", "left_anti")


def _one_each(call: Callable[[list], list], inputs: list) -> list[tuple[object, str | None]]:
    """(result, error) of every input: all at once, or one by one where that fails, so that one bad
    row does not take its neighbours with it. A list of another length is a failure too."""

    def checked(some: list) -> list:
        found = list(call(some))
        if len(found) != len(some):
            raise ValueError(f"{len(found)} results for {len(some)} inputs")
        return found

    found, error = _guarded(checked, inputs)
    if error is None:
        return [(x, None) for x in found]
    if len(inputs) == 1:
        return [(None, error)]
    return [_one_each(call, [x])[0] for x in inputs]


def _in_groups(call: Callable[[list], list], inputs: list, size: int) -> list[tuple[object, str | None]]:
    return [x for at in range(0, len(inputs), size) for x in _one_each(call, inputs[at : at + size])]


def answer_requests(
    requests: DataFrame,
    load: Callable[[], Callable[[list[str]], list[str]]],
    *,
    attempt: int = 0,
    group: int = MODEL_GROUP,
) -> DataFrame:
    """requests(job_id, task, prompt) -> response rows, prompts given to the model in groups of
    ``group``. A group that fails is asked again row by row; what fails then is an error row."""

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            found = _in_groups(model, list(batch["prompt"]), group)
            yield pd.DataFrame(
                {
                    "job_id": batch["job_id"],
                    "task": batch["task"],
                    "attempt": attempt,
                    "response": [response for response, _ in found],
                    "error": [error for _, error in found],
                }
            )

    return requests.select("job_id", "task", "prompt").mapInPandas(answer, RESPONSE_SCHEMA)


def embed(
    text: Column, load: Callable[[], Callable[[list[str]], list[list[float]]]], *, group: int = MODEL_GROUP
) -> Column:
    """Vector column of a text column, null where the model fails on the row."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series([v for v, _ in _in_groups(model, list(batch), group)], dtype=object)

    return vectors(text)


def embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[DataFrame], DataFrame]:
    """For ``ingest(embed=...)``: texts(id, text) -> (id, vec)."""
    return lambda texts: texts.select("id", embed(F.col("text"), load).alias("vec"))
