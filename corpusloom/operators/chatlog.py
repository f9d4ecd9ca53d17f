"""Chat logs as a conversation table ``conv_id, turn, role, text``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.skew import next_row


def transcript(messages: DataFrame) -> DataFrame:
    """Messages in reading order. The sort is by ranges of ``(conv_id, turn)``, so a
    very long conversation is spread over tasks like everything else."""
    return messages.select(
        "conv_id", "turn", "role", F.col("text").alias("content")
    ).orderBy("conv_id", "turn")


def pairs(messages: DataFrame) -> DataFrame:
    """Each user message with the assistant message that directly follows it."""
    return (
        next_row(messages, "conv_id", "turn", ["turn", "role", "text"])
        .filter((F.col("role") == "user") & (F.col("next_role") == "assistant"))
        .select(
            "conv_id",
            F.col("turn").alias("prompt_turn"),
            F.col("next_turn").alias("reply_turn"),
            F.col("text").alias("prompt"),
            F.col("next_text").alias("reply"),
        )
    )


def append(messages: DataFrame, new: DataFrame) -> DataFrame:
    """Add ``new(conv_id, seq, role, text)`` after the last turn of each conversation,
    in the order of ``seq``; a conversation not seen before starts at turn 0.

    ``seq`` counts from 0 without gaps within its conversation, so no numbering pass
    is needed.
    """
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("last"))
    added = new.join(last, "conv_id", "left").select(
        "conv_id",
        (F.coalesce("last", F.lit(-1)) + 1 + F.col("seq")).cast("long").alias("turn"),
        "role",
        "text",
    )
    return messages.select("conv_id", "turn", "role", "text").unionByName(added)
