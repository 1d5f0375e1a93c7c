"""Chat formatting by perspective rotation, in DataFrame functions only.

The gate has no dialogues of its own: this operator is general. It takes turns
(``conv_id, turn, role, text``) and renders each dialogue once for every participant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Turns to a stretch: bounds what one task must order, whatever a dialogue's length.
STRETCH = 256


def perspectives(
    turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per dialogue, participant and turn: the turn as that participant's training text.

    For each participant (``perspective``) all of the dialogue is rendered: their own turns as
    ``assistant``, everyone else's as ``user`` under their name. ``piece`` is the rendered turn,
    ``start`` its place in the rendered dialogue in characters; pieces in order of ``start`` join
    without gaps. ``loss_start`` and ``loss_end`` bound what is trained on: the participant's own
    words and their end mark, null for turns of others.

    Null roles are the participant ``unknown``, null texts empty; a null turn comes first, equal
    turns are ordered by role and text; repeated rows are rendered as often as they occur. A null
    conversation is one of its own. No rows in, no rows out. Other columns are ignored.

    Rows are not gathered: starts are running sums, taken over stretches of turns first, so a very
    long dialogue is spread over tasks. A dialogue makes as many rows as turns x participants.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("name"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    speakers = rows.select(F.col("conv_id").alias("c"), F.col("name").alias("perspective")).distinct()
    own = F.col("name") == F.col("perspective")
    head = F.when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), "name", F.lit("|>\n")))
    told = (
        rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("c")))
        .withColumn("piece", F.concat(head, "text", F.lit("<|end|>\n")))
        .withColumn("stretch", F.floor(F.coalesce("turn", F.lit(-1)) / STRETCH))
        .select(
            "conv_id",
            "perspective",
            "turn",
            F.when(own, "assistant").otherwise("user").alias("role"),
            "name",
            "piece",
            F.length("piece").cast("long").alias("n_chars"),
            F.length(head).cast("long").alias("n_head"),
            "stretch",
        )
    )
    keys = ["conv_id", "perspective", "stretch"]
    sums = told.groupBy(*keys).agg(F.sum("n_chars").alias("n"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*(F.col(k).alias(f"{k}_b") for k in keys), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_b")) for k in keys]
    before = Window.partitionBy(*keys).orderBy("turn", "name", "piece").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("n_chars").over(before), F.lit(0))
    trained = F.col("role") == "assistant"
    return (
        told.join(base, same)
        .withColumn("start", start)
        .select(
            "conv_id",
            "perspective",
            "turn",
            "role",
            "name",
            "piece",
            "start",
            "n_chars",
            F.when(trained, F.col("start") + F.col("n_head")).alias("loss_start"),
            F.when(trained, F.col("start") + F.col("n_chars")).alias("loss_end"),
        )
    )
