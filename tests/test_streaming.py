"""Streaming jobs: equal to their batch twins in any order, over restarts, with few files and no row twice."""

import random

import pytest
from pyspark.sql import functions as F

from assay.operators.sessions import session_steps
from assay.session import local_rows, scratch_path
from assay.streaming import runs as R
from assay.streaming.batch_table import BatchTable, Entry, newest

KINDS = ("page_load", "recording_complete", "responses_complete", "clear")


def batches_of(spark, root):
    return [e for e in BatchTable(spark, root).entries() if e.level == 0]


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def session_events(seed, n, sessions):
    rng = random.Random(seed)
    return [(rng.randrange(sessions), rng.choice(KINDS), pos) for pos in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_steps_over_shuffled_batches_and_restarts_equal_batch(spark, seed):
    source, out, progress = (scratch_path(spark, x) for x in ("in", "out", "progress"))
    rows = session_events(seed, 240, 9)
    frame = lambda part: local_rows(spark, part, "session int, kind string, pos long").coalesce(1)
    schema = frame(rows).schema
    for upto in (3, 5, 6):  # the query ends and starts again from its checkpoint
        for i in range(6)[upto - (3 if upto == 3 else 2 if upto == 5 else 1) : upto]:
            frame(rows[i * 40 : (i + 1) * 40]).write.mode("append").parquet(source)
        got = R.stream_session_steps(stream_of(spark, source, schema), out, progress)
        want = session_steps(frame(rows[: upto * 40])).select("session", "step", "at1", "at2", "at3")
        assert {tuple(r) for r in got.select(want.columns).collect()} == {tuple(r) for r in want.collect()}
    # A batch hands out a row for each session that it touched and no other.
    for e in batches_of(spark, out):
        saved = spark.read.parquet(f"{out}/data/part={e.folder}")
        assert saved.count() <= 9 and saved.select("batch").distinct().count() == 1


def test_steps_of_null_and_unknown_kinds(spark):
    source, out, progress = (scratch_path(spark, x) for x in ("in", "out", "progress"))
    rows = local_rows(spark, [(1, None, 5), (1, "page_load", None), (None, "page_load", 3), (2, "clear", 4), (None, "recording_complete", 9)], "session int, kind string, pos long")
    rows.coalesce(1).write.parquet(source)
    got = R.stream_session_steps(stream_of(spark, source, rows.schema), out, progress)
    assert {(r.session, r.step) for r in got.collect()} == {(1, 0), (2, 0), (None, 2)}


def test_a_batch_writes_only_the_keys_it_touches(spark):
    source, out, progress = (scratch_path(spark, x) for x in ("in", "out", "progress"))
    spark.range(100_000).select(F.col("id").alias("session")).coalesce(1).write.parquet(source)
    stream = stream_of(spark, source, "session long")
    assert R.stream_counter(stream, out, progress).count() == 100_000
    spark.range(10).select((F.col("id") * 7).alias("session")).coalesce(1).write.mode("append").parquet(source)
    got = R.stream_counter(stream, out, progress)
    last = batches_of(spark, out)[-1]
    assert spark.read.parquet(f"{out}/data/part={last.folder}").count() == 10
    assert {(r.n_votes, r["count"]) for r in got.groupBy("n_votes").count().collect()} == {(2, 10), (1, 99_990)}


def test_tally_resumes(spark):
    source, out, progress = (scratch_path(spark, x) for x in ("in", "out", "progress"))
    votes = spark.range(30).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("best"))
    stream = stream_of(spark, source, votes.schema) if votes.coalesce(1).write.parquet(source) is None else None
    for n in (1, 2, 2):
        if n == 2 and len(batches_of(spark, out)) == 1:
            votes.coalesce(1).write.mode("append").parquet(source)
        got = R.stream_tally(stream, out, progress)
        assert {(r.best, r.votes) for r in got.collect()} == {("a", 10 * n), ("b", 20 * n)}


def test_fifty_batches_leave_few_files_and_no_row_twice(spark):
    root = scratch_path(spark, "table")
    table = BatchTable(spark, root, keys=["k"], fan_in=4)
    rows = lambda i: local_rows(spark, [(i, i % 2)], "v int, k int")
    for i in range(50):
        table.append(rows(i), i)
        if i % 7 == 0:
            table.append(rows(i), i)  # a retry
        live = table.live()
        assert sum(e.last - e.first + 1 for e in live) == i + 1 and len(live) <= 3 * 3 + 1
    assert sorted(r.v for r in table.read("v int, k int").collect()) == list(range(50))
    # What is covered but not deleted yet is bounded too.
    assert len(table.entries()) <= 15


def test_a_reader_during_a_merge_sees_each_row_once(spark, monkeypatch):
    root = scratch_path(spark, "table")
    table, seen = BatchTable(spark, root, fan_in=3), []
    rows = lambda i: local_rows(spark, [(i,)], "v int")
    commit = BatchTable._commit

    def watched(self, df, first, last, level):
        if level:
            old = table.read("v int")  # planned before the merge, read after it
            commit(self, df, first, last, level)
            seen.append((first, last, sorted(r.v for r in old.collect()), sorted(r.v for r in table.read("v int").collect())))
        else:
            commit(self, df, first, last, level)

    monkeypatch.setattr(BatchTable, "_commit", watched)
    for i in range(9):
        table.append(rows(i), i)
    assert [(a, b) for a, b, *_ in seen] == [(0, 2), (3, 5), (6, 8), (0, 8)]
    assert all(old == new == list(range(last + 1)) for _, last, old, new in seen)


def test_a_folder_without_entry_is_not_read(spark):
    root = scratch_path(spark, "table")
    table = BatchTable(spark, root)
    assert table.read("v int").count() == 0 and table.live() == []
    table.append(local_rows(spark, [(1,)], "v int"), 0)
    local_rows(spark, [(2,)], "v int").write.parquet(f"{root}/data/part=tdead")  # a writer that died before its commit
    assert [r.v for r in table.read("v int").collect()] == [1]
    assert Entry(3, 5, 1, "tab").name == "3-5-1-tab"


def test_newest(spark):
    rows = local_rows(spark, [(1, "a", 0), (1, "b", 2), (2, "c", 1), (None, "d", 0)], "k int, v string, batch int")
    assert {tuple(r) for r in newest(rows, ["k"]).collect()} == {(1, "b", 2), (2, "c", 1), (None, "d", 0)}


def test_a_session_asks_the_store_once_and_writes_what_changed():
    import pandas as pd

    from assay.streaming.session_state import SessionSteps

    calls = []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def exists(self):
            calls.append("exists")
            return self.held is not None

        def update(self, value):
            calls.append("update")
            self.held = value

    class Nothing:
        def exists(self):
            return False

    class Handle:
        def getValueState(self, *_):
            return Value()

        def getListState(self, *_):
            return Nothing()

    steps = SessionSteps()
    steps.init(Handle())
    for pos in (4, 9):
        (row,) = steps.handleInputRows((7,), iter([pd.DataFrame({"session": [7, 7], "kind": ["page_load", "other"], "pos": [pos, None]})]), None)
        assert row.values.tolist() == [[7, 1, 4, None, None]]
    assert calls == ["get", "update", "get"]
