"""Texts in overlapping pieces of fixed size, and the nearest pieces of a question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgate.operators import vector_similarity as vs
from inkgate.session import cut


def overlapping_chunks(texts: DataFrame, *, size: int = 1000, overlap: int = 200, key: str = "job_id", text: str = "text") -> DataFrame:
    """(key, chunk, start, text): pieces of ``size`` characters, each beginning ``size - overlap``
    behind the last, so that ``overlap`` characters stand in both. The last one may be shorter.

    A text is cut once from its start to its end, however long. Null and empty texts have no chunk.
    Each chunk but the first without its first ``overlap`` characters, joined, is the text again.
    """
    if not 0 <= 2 * overlap <= size or size < 1:
        raise ValueError("the overlap is at most half of a chunk")
    step = size - overlap
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    cut_up = texts.select(F.col(key), parts.alias("_p"))
    count = F.size("_p")
    # a last part that the overlap of the one before covers makes no chunk of its own
    covered = (count > 1) & (F.length(F.element_at("_p", -1)) <= overlap)
    chunks = F.transform(
        F.sequence(F.lit(0), count - F.when(covered, 2).otherwise(1)),
        lambda i: F.struct(
            i.alias("chunk"),
            (i.cast("bigint") * step).alias("start"),
            F.concat(F.get("_p", i), F.coalesce(F.substring(F.get("_p", i + 1), 1, overlap), F.lit(""))).alias("text"),
        ),
    )
    return cut_up.where(count > 0).select(key, F.explode(chunks).alias("c")).select(key, "c.*")


def retrieve(questions: DataFrame, chunks: DataFrame, *, k: int = 5) -> DataFrame:
    """questions(id, vec) -> (id, rank, chunk_id, cosine, and the other columns of the chunk).

    The ``k`` nearest of chunks(id, vec, ...) by cosine, exactly; equal ones by the lower id, a
    question's own row never. Ids are whole numbers. Sources meet the ranked rows only.
    """
    stored = vs.unit_vectors(chunks)
    pivots = vs.choose_pivots(stored)
    placed = cut(vs.in_cells(stored, pivots), "chunks")
    asked = cut(vs.in_cells(vs.unit_vectors(questions), pivots), "questions")
    found = vs.nearest(asked, placed, vs.measure(placed, pivots), k=k)
    sources = chunks.drop("vec").withColumnRenamed("id", "chunk_id")
    ranked = found.select("id", "rank", F.col("neighbour_id").alias("chunk_id"), "cosine")
    return ranked.join(sources, "chunk_id", "left")
