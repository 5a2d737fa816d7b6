"""Multi-party chats, rendered once from the perspective of each participant, in native expressions only.

Turns order by ``turn``, then role and text; null turns come first. Every role but the system's is a participant; a null role is
the participant ``unknown``, a null text an empty one, a null ``conv_id`` a conversation. Repeated rows are turns of their own;
a conversation without participants gives no row, and extra columns are ignored. A dialogue is one row a participant, however long.

Marks cannot be forged: in texts and names ``<|`` is written ``<\\|``, and in names also ``|>`` as ``\\|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM, UNKNOWN = "system", "unknown"


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def _head(role: Column, speaker: Column) -> Column:
    return (
        F.when(role == speaker, F.lit("<|assistant|>\n"))
        .when(role == SYSTEM, F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), F.replace(_plain(role), F.lit("|>"), F.lit("\\|>")), F.lit("|>\n")))
    )


def perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, n_turns, rendered, spans (start and end, in characters, of what the speaker says, end mark included)."""
    said = turns.select(
        "conv_id",
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(UNKNOWN)).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    whole = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    people = F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda r: r != SYSTEM))
    seen = whole.select("conv_id", "turns", F.explode(people).alias("speaker"))
    pieces = F.transform("turns", lambda t: F.struct(_head(t["role"], F.col("speaker")).alias("head"), F.concat(_plain(t["text"]), F.lit("<|end|>\n")).alias("body"), (t["role"] == F.col("speaker")).alias("own")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        begin = state["at"] + F.length(piece["head"])
        end = begin + F.length(piece["body"])
        span = F.struct(begin.alias("start"), (end - 1).alias("end"))
        return F.struct(end.alias("at"), F.when(piece["own"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    made = seen.withColumn("pieces", pieces)
    return made.select(
        "conv_id",
        "speaker",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.aggregate("pieces", start, step, lambda s: s["spans"]).alias("spans"),
    )
