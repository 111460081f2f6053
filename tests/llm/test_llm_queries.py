"""Every query of the subpackage against its SQL, and the cases every operator must stand."""

import math
import zlib

import compare
import pyarrow as pa
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from assay.llm import catalog, quality
from assay.llm.decontamination import clean_documents, contamination
from assay.llm.dialogues import rotated
from assay.llm.embeddings import near_vectors
from assay.llm.jaccard import one_of_each, similarity_classes
from assay.llm.licenses import license_notices
from assay.llm.packing import packed, word_lengths
from assay.llm.passages import repeated_passages, without_repeats
from assay.llm.quality import accepted_documents, quality_scores
from assay.llm.sharding import shuffled_shards

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, _row long, spans string, token int, class string"
LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", None, "a", 1, 1, "x", 1, "k"),
    (2, None, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, 1, "x", 1, "k"),
    (3, "", "en", "a", 0, 1, "x", 1, "k"),
    (4, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 1, 1, "x", 1, "k"),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 1, 1, "x", 1, "k"),
    (5, LONG, "en", "a", 1, 1, "x", 1, "k"),
    (6, "one", "en", "a", 1, 1, "x", 1, "k"),
    (6, "one", "en", "a", 1, 1, "x", 1, "k"),
    (7, "... --- 　 \x00 ...", "en", "a", 1, 1, "x", 1, "k"),
]


@pytest.fixture(scope="module")
def database():
    con = compare.database(SF_DIR)
    con.execute("SET TimeZone='UTC'")
    return con


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, DOCUMENTS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, sf_dir, database, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert compare.check(database, df, catalog.ORACLES.get(name)) is None
    assert len({c.lower() for c in df.columns}) == len(df.columns)


@pytest.mark.parametrize("name", ["op2_perspective_rotation", "op10_hypergeometric_shards", "op11_weighted_sampling"])
def test_native_queries_run_no_python(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExistingRDD"))


def test_no_operator_multiplies_rows_by_themselves(spark, sf_dir):
    for name in catalog.QUERIES:
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, _row int, hub string")


def test_contamination_of_odd_rows(spark, odd, none):
    benchmark = items(spark, [(9, "beta gamma delta epsilon zeta eta theta iota kappa lambda", 1, "h"), (10, "ONE!", 1, "h"), (11, None, 1, "h"), (12, "", 1, "h"), (None, "one", 1, "h"), (9, "one", 1, "h")])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in contamination(odd, benchmark).collect())
    twelve = [(False, 1, 12, 10, 1), (False, 4, 12, 10, 1), (True, 0, 12, 10, 1)]
    assert got == sorted([*twelve, (False, 2, 0, 0, 0), (False, 3, 0, 0, 0), (False, 3, 0, 0, 0), (False, 5, 30_000, 0, 0), (False, 6, 1, 1, 2), (False, 6, 1, 1, 2), (False, 7, 1, 0, 0)])
    assert contamination(none, benchmark).count() == 0
    assert contamination(odd, items(spark, [])).where("contaminated").count() == 0
    kept = clean_documents(odd, benchmark)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {2, 3, 5, 7}


def test_similarity_of_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in similarity_classes(odd).collect()}
    assert got == {(1, 8, 1), (2, 0, 2), (3, 0, 3), (4, 8, 1), (None, 8, 1), (5, 29_996, 5), (6, 1, 6), (7, 1, 7)}
    assert similarity_classes(none).count() == 0
    kept = one_of_each(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 3, 5, 6, 6, 7]


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "un deux trois quatre cinq six")
    rows = [(1, a), (2, a), (2, b), (2, ""), (3, c), (3, c), (4, c), (4, c), (5, a), (5, b)]
    kept = one_of_each(spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, row string, c1 int"))
    assert kept.columns == ["doc_id", "text", "row", "c1"]
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, a), (2, b), (2, ""), (3, c), (3, c)])


def test_passages_of_odd_rows(spark, odd, none):
    assert repeated_passages(none).count() == 0 and without_repeats(none).count() == 0
    assert repeated_passages(odd).count() == 0
    both = odd.union(odd.where("doc_id = 5").withColumn("doc_id", F.lit(50).cast("long")))
    rows = repeated_passages(both).collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.other_id, r.n_equal) for r in rows] == [(50, 0, 30_000, 5, 30_000)]
    kept = without_repeats(both)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, None, "x"), (3, 0, 1, "x"), (None, 1, 1, "x"), (5, None, 1, "x"), (5, 7, 1, "x"), (6, 1, 1, "x"), (6, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    got = quality_scores(odd, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality_scores(none, labels).count() == 0
    assert {r.score for r in quality_scores(odd, labels.where("false")).collect()} == {0.5}
    scores = {(r.doc_id, round(r.score, 6)) for r in got}
    kept = accepted_documents(odd, labels)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.score >= 0.5) and scores
    assert accepted_documents(odd, labels.where("false")).count() == len(ROWS)
    assert accepted_documents(none, labels).count() == 0


def test_shards_of_odd_rows(spark, odd, none):
    got = shuffled_shards(odd.withColumn("slot", F.lit("x")), 4).collect()
    assert len(got) == len(ROWS)
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (2, 3)
    assert shuffled_shards(none, 4).count() == 0


def test_packing_of_odd_rows(spark, odd, none):
    got = packed(word_lengths(odd)).collect()
    words = 3 * 12 + 30_000 + 2 * 1 + 5
    assert sum(r.length for r in got) == words + len(ROWS)
    assert packed(word_lengths(none)).count() == 0
    assert all(r.length <= r.bucket <= 2048 for r in got)


def test_notices_of_odd_rows(spark, odd, none):
    assert license_notices(odd).count() == 0 and license_notices(none).count() == 0


def test_vectors_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [0.0, 0.0], 1), (5, None, 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e-30, 0.0], 1)]
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<float>, label int, digest string, class int")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_vectors(table).collect()), key=str)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted([(0, 4, 1, False), (1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (12, 4, 1, False), *alone], key=str)
    assert near_vectors(table.where("false")).count() == 0


def test_dialogues_of_odd_rows(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "amy", "hi"), (1, 2, "bob", None), (1, 2, "amy", "x"), (1, 2, "amy", "x"), (1, None, None, ""), (None, 0, "amy", "n"), (2, 0, "system", "only")]
    table = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn int, role string, text string, part int, perspective string").coalesce(1)
    got = rotated(table).orderBy("conv_id", "perspective", "seq").collect()
    assert len(got) == 6 * 3 + 1
    for who in ("amy", "bob", "unknown"):
        turns = [r for r in got if r.conv_id == 1 and r.perspective == who]
        text = "".join(r.segment for r in turns)
        assert [r.seq for r in turns] == list(range(6)) and turns[0].turn is None
        assert all(text[r.start : r.end] == r.segment for r in turns)
        for r in turns:
            own = r.name == who
            assert r.chat_role == ("assistant" if own else "system" if r.name == "system" else "user")
            assert text[r.loss_start : r.loss_end].endswith("<|end|>\n") == own
            assert own or r.loss_start == r.loss_end
    assert [r.segment for r in got if r.conv_id is None] == ["<|assistant|>\nn<|end|>\n"]
    assert rotated(table.where("false")).count() == 0


def test_shards_keep_their_contract(spark, sf_dir):
    rows = catalog.QUERIES["op10_hypergeometric_shards"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == want and len(rows) == len(docs)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)} and {r.shard for r in rows} <= set(range(40))
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    counts = [len(slots.get(s, [])) for s in range(40)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_scores_are_those_of_a_plain_forward_pass(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    got = {r.doc_id: r for r in catalog.QUERIES["op4_attention_pooling"](spark, sf_dir).collect()}
    p = {k: v.tolist() for k, v in model.p.items()}
    dot = lambda x, w, j: sum(a * row[j] for a, row in zip(x, w))
    for r in docs.orderBy("doc_id").limit(12).collect():
        x, _ = quality.encode(pa.array([r.text]))
        passages = []
        for row in model.scaled(x).tolist():
            h = [math.tanh(dot(row, p["embed"], j) + b) for j, b in enumerate(p["embed_bias"])]
            gates = range(len(p["attend"]))
            e = sum(math.tanh(dot(h, p["view"], j)) / (1 + math.exp(-dot(h, p["gate"], j))) * p["attend"][j][0] for j in gates)
            passages.append((h, e))
        top = max(e for _, e in passages)
        total = sum(math.exp(e - top) for _, e in passages)
        z = [sum(math.exp(e - top) / total * h[j] for h, e in passages) for j in range(len(p["score"]))]
        score = 1 / (1 + math.exp(-dot(z, p["score"], 0) - p["score_bias"][0]))
        row = got[r.doc_id]
        assert abs(row.score - score) < 1e-6 and row.predicted == int(score >= 0.5)
        assert row.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
