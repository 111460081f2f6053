"""Streaming jobs over the event table, fed in several files; their results equal the batch jobs'."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import fixed_values as V
from assay.operators.sessions import session_steps
from assay.plans import fixtures as fx
from assay.plans.registry import query
from assay.session import scratch_path
from assay.streaming import runs as R

FEED_FILES = 6


def feed(spark, sf_dir, label):
    """The events as a stream of files in no order: each file holds events of all times, two come per micro-batch."""
    root = scratch_path(spark, label)
    events = fx.table(spark, sf_dir, "events")
    events.repartition(FEED_FILES, F.xxhash64("event_id")).write.parquet(root)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(root)


@query("stream_preference_tally", fx.with_(fx.VOTES_SQL, "SELECT best, count(*) AS votes FROM votes GROUP BY best"))
def stream_preference_tally(spark, sf_dir):
    votes = fx.votes_of(feed(spark, sf_dir, "feed"))
    return R.stream_tally(votes, scratch_path(spark, "tally"), scratch_path(spark, "progress"))


@query(
    "stream_session_counter",
    fx.with_(
        fx.VOTES_SQL,
        """SELECT session, count(*) AS n_votes, count(*) >= 10 AS completed,
                  CASE WHEN count(*) >= 10 THEN '# Completed! Completion Code: PLACEHOLDER'
                       ELSE '# ' || count(*)::VARCHAR || '/10 Preferences Submitted' END AS progress FROM votes GROUP BY session""",
    ),
)
def stream_session_counter(spark, sf_dir):
    votes = fx.votes_of(feed(spark, sf_dir, "feed"))
    return R.stream_counter(votes, scratch_path(spark, "counter"), scratch_path(spark, "progress"), V.VOTE_GOAL)


STEPS_SQL = [
    *fx.SESSION_EVENTS_SQL,
    "s0 AS (SELECT session, min(pos) FILTER (kind = 'page_load') AS at1 FROM session_events GROUP BY session)",
    "s1 AS (SELECT s0.session, at1, (SELECT min(pos) FROM session_events e WHERE e.session = s0.session AND kind = 'recording_complete' AND pos > at1) AS at2 FROM s0)",
    "s2 AS (SELECT s1.session, at1, at2, (SELECT min(pos) FROM session_events e WHERE e.session = s1.session AND kind = 'responses_complete' AND pos > at2) AS at3 FROM s1)",
    "steps AS (SELECT session, (at1 IS NOT NULL)::INT + (at2 IS NOT NULL)::INT + (at3 IS NOT NULL)::INT AS step, at1, at2, at3 FROM s2)",
]


@query("session_step_machine", fx.with_(STEPS_SQL, "SELECT session, step, at1, at2, at3 FROM steps"))
def session_step_machine(spark, sf_dir):
    return session_steps(fx.session_events_of(fx.table(spark, sf_dir, "events")))


@query("stream_session_steps", fx.with_(STEPS_SQL, "SELECT session, step FROM steps"))
def stream_session_steps(spark, sf_dir):
    events = fx.session_events_of(feed(spark, sf_dir, "feed"))
    return R.stream_session_steps(events, scratch_path(spark, "steps"), scratch_path(spark, "progress")).select("session", "step")


@query(
    "stream_results_flush",
    fx.with_(
        fx.VOTES_SQL,
        """SELECT 'votes' AS dataset, 'e2e' AS m_type, 'model_' || best AS model, 'd' || (session % 3)::VARCHAR AS dial, event_id::VARCHAR AS id, audio_hash AS pred,
                  CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 2)::DOUBLE END AS score FROM votes""",
    ),
)
def stream_results_flush(spark, sf_dir):
    votes = fx.votes_of(feed(spark, sf_dir, "feed"))
    results = votes.select(
        F.lit("votes").alias("dataset"),
        F.lit("e2e").alias("m_type"),
        F.concat(F.lit("model_"), "best").alias("model"),
        F.concat(F.lit("d"), (F.col("session") % 3).cast("string")).alias("dial"),
        F.col("event_id").alias("id"),
        F.col("audio_hash").alias("pred"),
        F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 2).alias("score"),
    )
    root = scratch_path(spark, "flushed")
    R.stream_results(results, root, scratch_path(spark, "progress"))
    return R.read_flushed(spark, root)
