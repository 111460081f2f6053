"""Files in and out, result logs, and streaming jobs."""

import json

import pytest
from pyspark.sql import functions as F

from assay.functions import fixed_values as V
from assay.operators.preferences import append_preferences, preference_tally
from assay.operators.sessions import session_steps
from assay.session import local_rows, scratch_path
from assay.sources.keyed_json import read_keyed_json, write_keyed_json
from assay.sources.results_log import (
    format_line,
    parse_lines,
    read_results_log,
    write_results_log,
)
from assay.sources.tables import file_manifest, publish, read_delimited, read_split, write_json
from assay.streaming import runs as R


def test_keyed_json_whole_file_and_lines(spark, tmp_path):
    store = {"_default": {str(i): {"audio_hash": f"{i:08x}", "best": "ab"[i % 2]} for i in range(1, 6)}}
    (tmp_path / "store.json").write_text(json.dumps(store, indent=4))
    votes = read_keyed_json(spark, str(tmp_path / "store.json"), "struct<audio_hash:string,best:string>", "_default", True)
    assert votes.count() == 5
    tally = {r["best"]: (r["votes"], r["share"]) for r in preference_tally(votes.select("value.best")).collect()}
    assert tally == {"b": (3, 0.6), "a": (2, 0.4)}
    (tmp_path / "scalars.json").write_text('{"1_80": "because", "80": "other"}')
    rows = read_keyed_json(spark, str(tmp_path / "scalars.json"), "string").orderBy("key").collect()
    assert [tuple(r) for r in rows] == [("1_80", "because"), ("80", "other")]
    path = str(tmp_path / "out")
    write_keyed_json(votes.select("key", "value.*"), "key", path)
    back = read_keyed_json(spark, path, "struct<audio_hash:string,best:string>")
    assert back.exceptAll(votes).count() == 0 and back.count() == 5


def test_keyed_json_loses_nothing_silently(spark, tmp_path):
    pretty = json.dumps({"a": {"n": 1}, "b": {"n": 2}}, indent=2)
    (tmp_path / "pretty.json").write_text(pretty)
    kind = "struct<n:int>"
    with pytest.raises(Exception, match="not a JSON object"):
        read_keyed_json(spark, str(tmp_path / "pretty.json"), kind).collect()
    assert read_keyed_json(spark, str(tmp_path / "pretty.json"), kind, whole_file=True).count() == 2
    lines = ['{"a":1,"b":"x","c":null}', "", '{"d":4', "[5]", '{"e":6} {"f":7}', '{"g":8}']
    (tmp_path / "lines.json").write_text("\n".join(lines))
    with pytest.raises(Exception, match="not a"):
        read_keyed_json(spark, str(tmp_path / "lines.json"), "int").collect()
    rows = read_keyed_json(spark, str(tmp_path / "lines.json"), "int", mode="quarantine").collect()
    assert {(r["key"], r["value"]) for r in rows if r["problem"] is None} == {("a", 1), ("c", None), ("g", 8)}
    bad = sorted((r["key"] or "", r["raw"]) for r in rows if r["problem"])
    assert bad == [("", "[5]"), ("", '{"d":4'), ("", '{"e":6} {"f":7}'), ("b", "x")]
    with pytest.raises(ValueError):
        read_keyed_json(spark, str(tmp_path / "lines.json"), "int", mode="other")


def test_delimited_missing_values(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("hash_name\tage\tnote\nx\t31\tNA\ny\tNaN\t\nz\tn/a\tfine\n")
    rows = read_delimited(spark, str(tmp_path / "t.tsv"), "hash_name string, age int, note string", "\t").orderBy("hash_name").collect()
    assert [tuple(r) for r in rows] == [("x", 31, None), ("y", None, None), ("z", None, "fine")]
    (tmp_path / "t.csv").write_text('Filename,Speaker B - NOTES \na.cha,"one, two"\n')
    row = read_delimited(spark, str(tmp_path / "t.csv"), "Filename string, `Speaker B - NOTES ` string").first()
    assert tuple(row) == ("a.cha", "one, two")


def test_manifest_reads_no_content(spark, tmp_path):
    for name in ("a.mp3", "b.mp3", "c.txt"):
        (tmp_path / name).write_bytes(b"12345")
    listing = file_manifest(spark, str(tmp_path / "*.mp3"))
    assert {tuple(r) for r in listing.select("name", "length").collect()} == {("a.mp3", 5), ("b.mp3", 5)}
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


def test_split_scan_prunes_partitions(spark):
    path = scratch_path(spark, "t")
    df = spark.range(40).select("id", F.when(F.col("id") < 10, "dev").otherwise("train").alias("split"))
    publish(df, path)
    dev = read_split(spark, path, "dev")
    assert dev.count() == 10
    assert "PartitionFilters: [isnotnull(split" in dev._jdf.queryExecution().executedPlan().toString()


def test_json_keeps_nulls(spark):
    path = scratch_path(spark, "j")
    write_json(local_rows(spark, [("a", None)], "key string, n int"), path)
    assert spark.read.text(path).first()[0] == '{"key":"a","n":null}'


LINES = [
    '0[SEP_DIAL]"""Yes"""[SEP_DIAL]1',
    '1[SEP_DIAL]"""ERROR IN PROCESSING"""[SEP_DIAL]NA',
    '-1086588478053773954[SEP_DIAL]"""two[NEW_LINE]lines"""[SEP_DIAL]0.7251607680326749',
]


def test_log_lines(spark):
    rows = parse_lines(local_rows(spark, [(v,) for v in LINES], "value string")).collect()
    assert [tuple(r) for r in rows] == [
        ("0", "Yes", 1.0), ("1", V.ERROR_TEXT, None), ("-1086588478053773954", "two[NEW_LINE]lines", 0.7251607680326749)
    ]
    bad = local_rows(spark, [(v,) for v in [*LINES, "no fields", "a[SEP_DIAL]b[SEP_DIAL]c", 'x[SEP_DIAL]"""a[SEP_DIAL]b"""[SEP_DIAL]1']], "value string")
    with pytest.raises(Exception, match="malformed result line"):
        parse_lines(bad).collect()
    kept = parse_lines(bad, mode="quarantine")
    assert kept.where("malformed").count() == 3 and kept.where("not malformed").count() == 3
    with pytest.raises(ValueError):
        parse_lines(bad, mode="other")


def test_log_folders(spark, tmp_path):
    for folder in ("Mustard_sarcasm_Results/e2e_model_a", "COVOST_translation_run_Results/pipe_b", "custom_tmp_Results/e2e_c"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "kenya_outs.txt").write_text("\n".join(LINES) + "\n")
    read = read_results_log(spark, str(tmp_path / "*" / "*" / "*.txt"), layout="flat")
    assert {tuple(r) for r in read.groupBy("dataset", "m_type", "model", "dial").count().collect()} == {
        ("Mustard_sarcasm", "e2e", "model_a", "kenya", 3), ("COVOST_translation", "pipe", "b", "kenya", 3), ("custom", "e2e", "c", "kenya", 3)
    }


def test_log_keeps_odd_predictions_and_run_types_apart(spark):
    root = scratch_path(spark, "log")
    rows = [("d", m, "a", "x", i, p, s) for m in ("e2e", "pipe") for i, p, s in ((0, "one\rtwo", 1.0), (1, None, 0.0), (2, "a\r\nb", None))]
    write_results_log(local_rows(spark, rows, "dataset string, m_type string, model string, dial string, id int, pred string, score double"), root)
    back = {(r["m_type"], r["id"]): (r["pred"], r["score"]) for r in read_results_log(spark, root).collect()}
    assert len(back) == 6
    for m in ("e2e", "pipe"):
        assert back[m, "0"] == ("one\rtwo", 1.0) and back[m, "1"] == (V.ERROR_TEXT, 0.0) and back[m, "2"] == ("a\r[NEW_LINE]b", None)
    with pytest.raises(Exception, match="needs an id"):
        spark.range(1).select(format_line(F.lit(None).cast("string"), F.lit("x"), F.lit(1))).collect()


def test_log_round_trip_prunes_runs(spark):
    root = scratch_path(spark, "log")
    df = spark.range(30).select(
        F.lit("d").alias("dataset"), F.lit("e2e").alias("m_type"), F.concat(F.lit("m"), F.col("id") % 3).alias("model"), F.lit("01").alias("dial"),
        "id", F.when(F.col("id") == 4, "a\nb").otherwise("Yes").alias("pred"), F.when(F.col("id") % 5 != 0, F.col("id") / 10).alias("score"),
    )
    write_results_log(df, root)
    back = read_results_log(spark, root)
    assert back.count() == 30 and back.where("score is null").count() == 6
    assert back.where("id = '4'").first()["pred"] == "a[NEW_LINE]b" and back.first()["dial"] == "01"
    one = back.where(F.col("model") == "m1")
    assert one.count() == 10 and "PartitionFilters: [isnotnull(model" in one._jdf.queryExecution().executedPlan().toString()


# ---- streaming -------------------------------------------------------------------------------------------------


def feed(spark, df, label, files=4):
    """Write ``df`` to ``files`` files of all positions and stream them one by one, the last positions' file first."""
    root = scratch_path(spark, label)
    n = df.count()
    for i in reversed(range(files)):
        mostly = F.when(F.xxhash64("pos") % 4 == 0, F.pmod(F.xxhash64("pos"), F.lit(files))).otherwise(F.floor(F.col("pos") * files / n))
        df.where(mostly == i).coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(root)


def votes(spark, n=200):
    return spark.range(n).select(
        F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("best"),
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 7).cast("int").alias("session"),
    )


def test_stream_tally_equals_batch(spark):
    df = votes(spark)
    got = R.stream_tally(feed(spark, df, "v"), scratch_path(spark, "o"), scratch_path(spark, "c"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in df.groupBy("best").count().collect()}


def test_stream_counter_resumes(spark):
    df = votes(spark)
    out, progress = scratch_path(spark, "o"), scratch_path(spark, "c")
    stream = feed(spark, df, "v")
    first = {r["session"]: r["n_votes"] for r in R.stream_counter(stream, out, progress).collect()}
    # Nothing new: the same query run again adds nothing.
    again = R.stream_counter(stream, out, progress).collect()
    assert first == {r["session"]: r["n_votes"] for r in again} == {r["session"]: r["count"] for r in df.groupBy("session").count().collect()}
    assert all(r["completed"] == (r["n_votes"] >= 10) for r in again)


def test_stream_steps_equal_batch(spark):
    kinds = F.array(*[F.lit(k) for k in ("page_load", "recording_complete", "responses_complete", "clear")])
    df = spark.range(300).select(
        F.col("id").alias("pos"), (F.xxhash64("id") % 11).cast("int").alias("session"),
        F.get(kinds, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)).cast("int")).alias("kind"),
    )
    got = R.stream_session_steps(feed(spark, df, "s", 7), scratch_path(spark, "o"), scratch_path(spark, "c"))
    want = session_steps(df).select("session", "step")
    assert {tuple(r) for r in got.select("session", "step").collect()} == {tuple(r) for r in want.collect()}


def test_stream_results_are_written_once(spark):
    df = votes(spark, 90)
    stream = feed(spark, df, "r").select(
        F.lit("d").alias("dataset"), F.lit("e2e").alias("m_type"), F.col("best").alias("model"), F.lit("x").alias("dial"), F.col("pos").alias("id"),
        F.lit("Yes").alias("pred"), F.lit(1).alias("score"),
    )
    root, progress = scratch_path(spark, "o"), scratch_path(spark, "c")
    R.stream_results(stream, root, progress)
    R.stream_results(stream, root, progress)
    back = R.read_flushed(spark, root)
    assert back.count() == 90 and back.select("id").distinct().count() == 90


def test_preferences_append(spark):
    path = scratch_path(spark, "p")
    for model in "ab":
        append_preferences(local_rows(spark, [("00000000", model)], "audio_hash string, best string"), path)
    assert spark.read.parquet(path).count() == 2


def test_format_line(spark):
    row = spark.range(1).select(format_line(F.lit(3), F.lit("a\nb"), F.lit(None).cast("double")).alias("l")).first()
    assert row["l"] == '3[SEP_DIAL]"""a[NEW_LINE]b"""[SEP_DIAL]NA'
