"""Files read in byte ranges: line numbers, records with line breaks, members of indented objects, ordered logs."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from assay.session import local_rows, scratch_path
from assay.sources.keyed_json import read_indented_json, read_keyed_json
from assay.sources.lines import numbered_lines, quoted_records
from assay.sources.results_log import read_results_log, write_results_log
from assay.sources.tables import read_delimited


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few hundred bytes, so that small files have many."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def test_lines_are_numbered_over_ranges(spark, tmp_path, small_ranges):
    (tmp_path / "a.txt").write_text("\n".join(f"{i} é" for i in range(500)) + "\n")
    (tmp_path / "b.txt").write_text("0\n\n2")
    (tmp_path / "c.txt").write_text("")
    rows = numbered_lines(spark, str(tmp_path)).collect()
    assert len(rows) == 503 and len({(r.file, r.range) for r in rows}) > 8
    assert all(not r.value or r.value.split()[0] == str(r.line) for r in rows)


def runs_of(rng, n):
    return [("d", "e2e", f"m{i % 2}", ["x", ""][i % 3 == 0], i, rng.choice(["Yes", "No\nno", None])) for i in range(n)]


def test_an_ordered_log_gives_back_its_order(spark, small_ranges):
    root = scratch_path(spark, "log")
    rows = runs_of(random.Random(1), 400)
    frame = local_rows(spark, rows, "dataset string, m_type string, model string, dial string, id int, pred string").withColumn("score", F.lit(1.0))
    frame = frame.withColumn("rank", -F.col("id")).withColumn("dataset", F.lit("d")).repartition(5)
    write_results_log(frame, root, order="rank")
    back = read_results_log(spark, root, places=True).collect()
    want = {}
    for _, _, model, dial, i, _ in sorted(rows, key=lambda r: -r[4]):
        want.setdefault((model, dial or None), []).append(str(i))
    got = {}
    for r in sorted(back, key=lambda r: r.place):
        assert r.place == len(got.setdefault((r.model, r.dial), []))
        got[r.model, r.dial].append(r.id)
    assert got == want
    files = spark.read.text(root).select(F.input_file_name()).distinct().count()
    assert files > len(want)


def test_flat_logs_have_places_too(spark, tmp_path):
    folder = tmp_path / "Mustard_sarcasm_tmp_Results" / "e2e_m"
    folder.mkdir(parents=True)
    (folder / "default_outs.txt").write_text('0[SEP_DIAL]"""Yes"""[SEP_DIAL]1\n2[SEP_DIAL]"""No"""[SEP_DIAL]0\n1[SEP_DIAL]"""No"""[SEP_DIAL]NA\n')
    rows = read_results_log(spark, str(tmp_path), layout="flat", places=True).orderBy("place").collect()
    assert [(r.dataset, r.dial, r.place, r.id) for r in rows] == [("Mustard_sarcasm", "default", i, k) for i, k in enumerate("021")]


# ---- delimited files -------------------------------------------------------------------------------------------


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("age,name,extra\n7,amy,x\n8,bob,y\n")
    rows = read_delimited(spark, str(tmp_path / "t.csv"), "name string, age int").orderBy("age").collect()
    assert [tuple(r) for r in rows] == [("amy", 7), ("bob", 8)]
    with pytest.raises(ValueError, match="not in the header"):
        read_delimited(spark, str(tmp_path / "t.csv"), "name string, height int")
    (tmp_path / "u.csv").write_text("name,age,extra\namy,7,x\n")
    with pytest.raises(ValueError, match="different headers"):
        read_delimited(spark, str(tmp_path), "name string")
    (tmp_path / "twice.csv").write_text("name,name\na,b\n")
    with pytest.raises(ValueError, match="once"):
        read_delimited(spark, str(tmp_path / "twice.csv"), "name string")


@pytest.mark.parametrize(
    "line, problem",
    [("7,amy,x", "not 2 fields but 3"), ("7", "not 2 fields but 1"), ('7,"amy', "open quote"), ("seven,amy", "age is not int: seven")],
)
def test_bad_lines_are_problems(spark, tmp_path, line, problem):
    (tmp_path / "t.csv").write_text(f"age,name\n6,ann\n{line}\n")
    rows = read_delimited(spark, str(tmp_path / "t.csv"), "name string, age int", mode="quarantine").collect()
    assert sorted((r.name or "", r.age, r.problem, r.raw) for r in rows) == sorted([("ann", 6, None, None), ("", None, problem, line)], key=str) or {
        (r.name, r.age, r.problem, r.raw) for r in rows
    } == {("ann", 6, None, None), (None, None, problem, line)}
    with pytest.raises(Exception, match=problem.split(":")[0]):
        read_delimited(spark, str(tmp_path / "t.csv"), "name string, age int").collect()


def test_fields_with_line_breaks_over_many_tasks(spark, tmp_path, small_ranges):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(['"', "\n", ",", "a", "é ", "bb\n\n"]) for _ in range(rng.randrange(90)))) for i in range(150)]
    text = io.StringIO()
    writer = csv.writer(text, lineterminator="\n")
    writer.writerow(["note", "id"])
    writer.writerows((note, i) for i, note in rows)
    (tmp_path / "t.csv").write_text(text.getvalue())
    frame = read_delimited(spark, str(tmp_path / "t.csv"), "id int, note string", na_values=[], multi_line=True)
    assert {(r.id, r.note or "") for r in frame.collect()} == set(rows)
    assert numbered_lines(spark, str(tmp_path / "t.csv")).select("range").distinct().count() > 10
    # A quote that nothing closes costs the lines after it, and each of them is told.
    (tmp_path / "open.csv").write_text('note,id\n"a\nb",1\n"c,2\nd,3\n')
    got = read_delimited(spark, str(tmp_path / "open.csv"), "id int, note string", multi_line=True, mode="quarantine").collect()
    assert {(r.id, r.note, r.problem, r.raw) for r in got} == {(1, "a\nb", None, None), (None, None, "open quote", '"c,2'), (None, None, "open quote", "d,3")}
    with pytest.raises(Exception, match="open quote"):
        read_delimited(spark, str(tmp_path / "open.csv"), "id int, note string", multi_line=True).collect()


# ---- indented JSON ---------------------------------------------------------------------------------------------


def records(rng, n):
    texts = ['a "quoted" { brace', "line\nbreak", "back\\slash\\", "[,", "é}", ""]
    return {f"k{i}{rng.choice(['', '{', '\"', ','])}": {"t": rng.choice(texts), "l": [rng.randrange(9)] * rng.randrange(3), "n": {"deep": {}}} for i in range(n)}


@pytest.mark.parametrize("indent", [0, 1, 4, None])
def test_indented_objects_are_read_by_many_tasks(spark, tmp_path, small_ranges, indent):
    kind = "struct<t:string,l:array<int>,n:struct<deep:string>>"
    store = records(random.Random(3), 120)
    (tmp_path / "one.json").write_text(json.dumps(store, indent=indent, ensure_ascii=False))
    rows = read_indented_json(spark, str(tmp_path), kind)
    whole = read_keyed_json(spark, str(tmp_path), kind, whole_file=True)
    want = sorted(map(str, whole.collect()))
    assert sorted(map(str, rows.collect())) == want and len(want) == 120
    if indent is not None:
        assert numbered_lines(spark, str(tmp_path)).select("range").distinct().count() > 10


def test_odd_objects(spark, tmp_path):
    cases = {
        "lines": ('{"a": 1}\n\n{"b": 2}\n', {("a", 1), ("b", 2)}),
        "apart": ('{\n"a":\n\n1\n,\n"b"\n: 2}', {("a", 1), ("b", 2)}),
        "two": ('{\n"a": 1\n}\n{\n"b": 2,\n"c": 3\n}', {("a", 1), ("b", 2), ("c", 3)}),
        "none": ("{\n}\n", set()),
        "empty": ("", set()),
    }
    for name, (text, want) in cases.items():
        (tmp_path / name).write_text(text)
        assert {tuple(r) for r in read_indented_json(spark, str(tmp_path / name), "int").collect()} == want, name
    broken = {"cut": '{\n"a": 1,\n', "missing": '{\n"a": 1\n"b": 2\n}', "list": '[\n1,\n2\n]', "bare": '"a": 1\n', "early": '}\n{"a": 1}'}
    for name, text in broken.items():
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="not a JSON object"):
            read_indented_json(spark, str(tmp_path / name), "int").collect()
        kept = read_indented_json(spark, str(tmp_path / name), "int", mode="quarantine").collect()
        assert any(r.problem for r in kept), name


def test_lines_are_not_shuffled_for_their_place(spark, tmp_path):
    with open(f"{tmp_path}/a.txt", "w") as f:
        f.write("".join(f'{k},"x\n{k}"\n' for k in range(50)))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = numbered_lines(spark, str(tmp_path))
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert sorted((r.line, r.value) for r in lines.collect())[:3] == [(0, '0,"x'), (1, '0"'), (2, '1,"x')]
        got = sorted((r.line, r.value, r.open) for r in quoted_records(lines).collect())
        assert got == [(2 * k, f'{k},"x\n{k}"', False) for k in range(50)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
