"""Structured Streaming jobs over vote, session and result feeds.

State lives in Spark's state store (RocksDB, checkpointed by its changes): a micro-batch reads and writes only the keys that
it touches, and hands out the new values of these keys alone. They go to a ``BatchTable``, which a retried batch can't
enter twice and which keeps its files few; the current value of a key is its newest row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assay.functions import fixed_values as V
from assay.functions.text import progress_text
from assay.sources.results_log import RUN_COLUMNS, format_line, read_results_log
from assay.streaming.batch_table import BatchTable, newest
from assay.streaming.session_state import STEP_SCHEMA, SessionSteps, thinned

AVAILABLE = {"availableNow": True}


def run_batches(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict = AVAILABLE, wait: bool = True, mode: str = "append"
) -> StreamingQuery:
    """Start the query; with the default trigger it ends when all that is available is done, and is waited for."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    query = writer.trigger(**trigger).foreachBatch(each).start()
    if wait:
        query.awaitTermination()
    return query


def keep_newest(changed: DataFrame, keys: list[str], root: str, checkpoint: str, **how) -> DataFrame:
    """Write the rows that each batch changed, and return the newest of each key once the query has ended."""
    spark = changed.sparkSession
    table = BatchTable(spark, root, merge=lambda rows: newest(rows, keys))
    run_batches(changed, lambda rows, batch: table.append(rows.withColumn("batch", F.lit(batch).cast("long")), batch), checkpoint, mode="update", **how)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changed.schema)
    return newest(table.read(f"{schema}, batch bigint"), keys).drop("batch")


def stream_tally(stream: DataFrame, root: str, checkpoint: str, best: str = "best", **how) -> DataFrame:
    """Running votes per model."""
    return keep_newest(stream.groupBy(best).agg(F.count(F.lit(1)).alias("votes")), [best], root, checkpoint, **how)


def stream_counter(stream: DataFrame, root: str, checkpoint: str, goal: int = V.VOTE_GOAL, session: str = "session", **how) -> DataFrame:
    """Votes per session with completion."""
    latest = keep_newest(stream.groupBy(session).agg(F.count(F.lit(1)).alias("n_votes")), [session], root, checkpoint, **how)
    return latest.withColumns({"completed": F.col("n_votes") >= goal, "progress": progress_text("n_votes", goal)})


def stream_session_steps(stream: DataFrame, root: str, checkpoint: str, **how) -> DataFrame:
    """Step of every session after all events so far (``session``, ``kind``, ``pos``), in whatever order they came."""
    events = stream.select("session", "kind", F.col("pos").cast("long").alias("pos"))
    events = events.mapInPandas(thinned, events.schema)
    kind = stream.schema["session"].dataType.simpleString()
    steps = events.groupBy("session").transformWithStateInPandas(SessionSteps(), f"session {kind}, {STEP_SCHEMA}", "update", "none")
    return keep_newest(steps, ["session"], root, checkpoint, **how)


def stream_results(stream: DataFrame, root: str, checkpoint: str, **how) -> None:
    """Append result lines as they come, a folder per run in each entry of the table below ``root``."""
    table = BatchTable(stream.sparkSession, root, keys=RUN_COLUMNS, kind="text")
    lines = stream.select(format_line("id", "pred", "score").alias("value"), *RUN_COLUMNS)
    run_batches(lines, table.append, checkpoint, **how)


def read_flushed(spark: SparkSession, root: str, mode: str = "strict") -> DataFrame:
    """The results that ``stream_results`` has committed so far, each once."""
    folders = BatchTable(spark, root).folders()
    return read_results_log(spark, folders, mode=mode, base_path=f"{root.rstrip('/')}/data")
