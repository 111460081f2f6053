"""Blind pairwise votes: tallies and per-session progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assay.functions import fixed_values as V
from assay.functions.text import progress_text
from assay.operators.ordinals import assign_ordinal


def append_preferences(df: DataFrame, path: str) -> None:
    """Append votes ``audio_hash``, ``best`` (and whatever else identifies them)."""
    df.write.mode("append").parquet(path)


def preference_tally(df: DataFrame, best: str = "best") -> DataFrame:
    """Votes and share per model. Shares come from the few tallied rows, not from a second pass."""
    votes = df.groupBy(best).agg(F.count(F.lit(1)).alias("votes"))
    everything = F.sum("votes").over(W.partitionBy(F.lit(0)))  # over one row per model
    return votes.select(best, "votes", (F.col("votes") / everything).alias("share"))


def preference_counter(
    df: DataFrame, goal: int = V.VOTE_GOAL, session: str = "session", order: tuple[str, ...] = ("ts", "event_id"),
    ranges: int | None = None,
) -> DataFrame:
    """Add the vote's number within its session, whether the goal is reached, and the progress text."""
    counted = assign_ordinal(df, order, by=[session], name="_i", ranges=ranges)
    n = F.col("_i") + 1
    return counted.withColumns(
        {"n_votes": n, "completed": n >= goal, "progress": progress_text(n, goal)}
    ).drop("_i")
