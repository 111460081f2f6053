"""The guided session as milestones: page load, then recording, then responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Event kind that moves a session from step i to i + 1 (fixed order).
STEP_EVENTS = ["page_load", "recording_complete", "responses_complete"]
# A session of more events is cut into slices of about so many.
SLICE_ROWS = 1_000_000


def session_steps(events: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Final step (0..3) and milestone positions per session.

    ``events`` has ``session``, ``kind`` and a sortable ``pos``; their order of arrival does not matter. A step is only
    taken from the one before it, so milestone i is the first event of kind i after milestone i - 1. The first
    milestone is a minimum per session, which merges from partial minima. Each later one joins the events with the
    milestone before; a session of more than ``slice_rows`` events is salted there by its count, its milestone handed
    to every slice, and the minima of the slices merged. The list of such sessions has at most a row for every
    ``slice_rows`` events, so it is broadcast.
    """
    opening = F.min(F.when(F.col("kind") == STEP_EVENTS[0], F.col("pos")))
    marks = events.groupBy("session").agg(opening.alias("at1"), F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("slices"))
    hot = F.broadcast(marks.where("slices > 1").select("session", "slices"))
    for i in range(1, len(STEP_EVENTS)):
        before = f"at{i}"
        reached = marks.where(F.col(before).isNotNull()).select("session", before, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        found = events.where(F.col("kind") == STEP_EVENTS[i]).select("session", "pos").join(hot, "session", "left")
        slice_of = F.coalesce(F.pmod(F.xxhash64("pos"), F.col("slices")), F.lit(0)).cast("int")
        found = found.select("session", "pos", slice_of.alias("slice"))
        later = reached.join(found, ["session", "slice"]).where(F.col("pos") > F.col(before))
        first = later.groupBy("session", "slice").agg(F.min("pos").alias("pos")).groupBy("session").agg(F.min("pos").alias(f"at{i + 1}"))
        marks = marks.join(first, "session", "left")
    step = sum((F.col(f"at{i + 1}").isNotNull().cast("int") for i in range(len(STEP_EVENTS))), F.lit(0))
    return marks.select("session", step.alias("step"), *[f"at{i + 1}" for i in range(len(STEP_EVENTS))])


def open_candidates(events: DataFrame, steps: DataFrame) -> DataFrame:
    """The events that can still be a milestone once more events come, in whatever order.

    Milestones only ever move to earlier positions. So of each kind these stay: the milestone itself, and what lies at
    or before the milestone of the step before it (all, while that one is missing). ``kind`` null marks a session.
    """
    kept = F.col("kind").isNull() | ((F.col("kind") == STEP_EVENTS[0]) & (F.col("pos") == F.col("at1")))
    for i in range(1, len(STEP_EVENTS)):
        before, own = F.col(f"at{i}"), F.col(f"at{i + 1}")
        may = before.isNull() | (F.col("pos") <= before) | F.coalesce(F.col("pos") == own, F.lit(False))
        kept = kept | ((F.col("kind") == STEP_EVENTS[i]) & may)
    return events.join(steps, "session").where(kept).select("session", "kind", "pos").distinct()
