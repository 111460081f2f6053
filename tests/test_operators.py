"""Jobs over tables on small hand-made inputs, skewed groups included."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.functions import fixed_values as V
from assay.operators import joins as J
from assay.operators import metrics as M
from assay.operators import prepare as P
from assay.operators import vectors as O
from assay.operators.evaluation import first_words, metric_run
from assay.operators.ordinals import assign_ordinal, positional_shards
from assay.operators.predict import (
    BatchPredictor,
    BatchScorer,
    CentroidPredictor,
    ColumnPredictor,
    argmax_label,
    argmax_rows,
    best_of_blocks,
    draw_from_blocks,
    predict,
    sample_label,
    softmax_blocks,
    softmax_scores,
)
from assay.operators.preferences import preference_counter
from assay.operators.sessions import STEP_EVENTS, open_candidates, session_steps
from assay.plans.tasks import load_task
from assay.session import local_rows


def failure(action):
    with pytest.raises(Exception) as caught:
        action()
    return str(caught.value)


# ---- ordinals --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("ranges", [1, 7, 50])
def test_ordinal_with_a_hot_group(spark, ranges):
    random.seed(1)
    # One group holds more than half of all rows and spans many key ranges.
    rows = [("hot" if random.random() < 0.6 else random.choice("abcxyz"), random.randint(0, 40), i) for i in range(900)]
    random.shuffle(rows)
    df = local_rows(spark, rows, "g string, v int, id int").repartition(5)
    got = {r["id"]: r["ordinal"] for r in assign_ordinal(df, ["v", "id"], by=["g"], ranges=ranges).collect()}
    want, seen = {}, {}
    for g, v, i in sorted(rows):
        want[i] = seen.get(g, 0)
        seen[g] = want[i] + 1
    assert got == want


@pytest.mark.parametrize("ranges", [1, 9])
def test_ordinal_over_a_table(spark, ranges):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("k"), F.timestamp_millis(F.col("id")).alias("t"))
    got = assign_ordinal(df, ["k"], ranges=ranges).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == list(range(500))
    assert [r["k"] for r in got] == sorted(r["k"] for r in got)
    by_time = assign_ordinal(df, ["t"], ranges=ranges).orderBy("t").collect()
    assert [r["ordinal"] for r in by_time] == list(range(500))


def test_ordinal_with_nulls_and_empty(spark):
    df = local_rows(spark, [(i % 5 or None, i) for i in range(60)], "g int, id int")
    got = assign_ordinal(df, ["id"], by=["g"], ranges=9).where("g is null").orderBy("id").collect()
    assert [r["ordinal"] for r in got] == list(range(12))
    assert assign_ordinal(df.where("id < 0"), ["id"]).count() == 0


def test_equal_keys_spread_and_can_be_refused(spark):
    df = spark.range(400).select(F.lit("same").alias("k"), "id").repartition(5)
    got = assign_ordinal(df, ["k"], ranges=8)
    assert sorted(r["ordinal"] for r in got.collect()) == list(range(400))
    assert "equal keys" in failure(lambda: assign_ordinal(df, ["k"], check_unique=True).collect())
    assert assign_ordinal(df, ["id"], check_unique=True).count() == 400


def test_no_ordinal_passes_through_one_task(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    plain = assign_ordinal(df, ["id"])
    # The only single-task window is over one row per range.
    assert plain._jdf.queryExecution().executedPlan().toString().count("SinglePartition") <= 1
    rows = assign_ordinal(df, ["id"], by=["g"]).collect()
    assert {(r["g"], r["ordinal"]) for r in rows} == {(i % 3, i // 3) for i in range(99)} | {(0, 33)}


def test_shards_are_equal_and_drop_the_remainder(spark):
    shards = positional_shards(spark.range(45).repartition(4), ["id"], 14, ranges=7)
    rows = shards.orderBy("id").collect()
    assert len(rows) == 42 and [r["shard"] for r in rows] == [i // 3 for i in range(42)]
    assert positional_shards(spark.range(5), ["id"], 14).count() == 0


def test_sample_n(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    some = P.sample_n(df, "k", 8)
    assert some.count() == 8 and some.select("k").distinct().count() == 8
    assert {r["k"] for r in some.collect()} == {r["k"] for r in P.sample_n(df.repartition(7), "k", 8).collect()}
    more = P.sample_n(df, "k", 50).collect()
    assert sorted(r["draw"] for r in more) == list(range(50)) and {r["k"] for r in more} <= set(range(20))


def test_hash_split_share_and_stability(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    split = P.hash_split(df, "k")
    share = split.where("split = 'test'").count() / 20_000
    assert abs(share - 0.2) < 0.01
    assert split.exceptAll(P.hash_split(df.repartition(13), "k")).count() == 0


def test_preference_counter_at_ten(spark):
    votes = spark.range(21).select((F.col("id") % 2).alias("session"), F.col("id").alias("ts"), F.col("id").alias("event_id"))
    rows = preference_counter(votes, ranges=9).where("session = 1").orderBy("ts").collect()
    assert [r["n_votes"] for r in rows] == list(range(1, 11))
    assert rows[8]["progress"] == "# 9/10 Preferences Submitted" and rows[9]["progress"] == "# Completed! Completion Code: PLACEHOLDER"


# ---- joins -----------------------------------------------------------------------------------------------------


def log(spark, rows):
    return local_rows(spark, [(o, s, "Yes") for o, s in rows], "ordinal bigint, stored bigint, pred string")


def test_align(spark):
    examples = spark.range(3).select(F.col("id").alias("ordinal"))
    assert J.align(log(spark, [(i, i) for i in range(5)]), examples).count() == 3
    assert "does not match example 2" in failure(lambda: J.align(log(spark, [(0, 0), (1, 1)]), examples).collect())
    assert "does not match example 1" in failure(lambda: J.align(log(spark, [(0, 0), (1, 7), (2, 2)]), examples).collect())
    loose = J.align(log(spark, [(0, 0), (1, 7)]), examples, strict=False).orderBy("ordinal").collect()
    assert [r["aligned"] for r in loose] == [True, False, False]


def test_folds_need_every_member(spark):
    folds = local_rows(spark, [("train", [1, 2]), ("dev", [3])], "fold string, members array<int>")
    labels = local_rows(spark, [(1, 1), (2, 0), (3, 1)], "file_id int, label int")
    texts = local_rows(spark, [(1, "a"), (2, "b")], "file_id int, text string")
    assert "no label or text for 3" in failure(lambda: J.assemble_folds(folds, labels, texts).collect())
    assert J.assemble_folds(folds, labels, texts, strict=False).count() == 2


def test_score_label_maps_unknown_to_error(spark):
    df = local_rows(spark, [(1, "Yes", 1), (2, "No", 1), (3, "maybe", 1), (4, None, 0)], "id int, pred string, truth int")
    rows = J.score_label(df, "pred", "truth", J.label_map_frame(spark, {"Yes": 1, "No": 0}, "int")).orderBy("id").collect()
    assert [(r["pred"], r["score"]) for r in rows] == [("Yes", 1), ("No", 0), (V.ERROR_TEXT, 0), (V.ERROR_TEXT, 0)]


def test_existence_keeps_every_row_once(spark):
    docs = local_rows(spark, [("a",), ("b",), (None,)], "clip string")
    listing = local_rows(spark, [("a", "x/a"), ("a", "y/a")], "name string, path string")
    joined = J.attach_existing(docs, "clip", listing)
    assert sorted(map(tuple, joined.collect()), key=str) == sorted([("a", "x/a"), ("b", None), (None, None)], key=str)
    assert tuple(J.match_rate(joined).first()) == (1, 3)


def test_pending_and_policy(spark):
    outputs = local_rows(spark, [(1, "ok"), (2, V.ERROR_TEXT), (2, "ok"), (3, V.ERROR_TEXT), (4, None)], "id int, pred string")
    todo = J.pending(local_rows(spark, [(i,) for i in range(1, 6)], "id int"), outputs)
    assert sorted(r["id"] for r in todo.collect()) == [3, 4, 5]
    with pytest.raises(ValueError):
        J.with_error_policy(outputs, "other")


def test_decode_labels_is_strict(spark):
    df = local_rows(spark, [(0,), (4,)], "label int")
    assert "no name for label 4" in failure(lambda: P.decode_labels(df, "label", V.EMOTIONS_4).collect())
    assert P.decode_labels(df, "label", {4: "four"}, strict=False).where("label_name = 'four'").count() == 1
    names = P.decode_labels(df, "label", V.EMOTIONS_4, strict=False).orderBy("label").collect()
    assert [r["label_name"] for r in names] == ["angry", None]


def test_tables_of_fixed_values():
    assert len(V.INTENTS) == 101 and len(set(V.INTENTS)) == 101
    assert len(V.LAUGHTER_KEYS) == 80 and len({str(k) for k in V.LAUGHTER_KEYS}) == 80
    assert len(V.EVAL_SETS) == 12 and len(V.DIALECTS) == 11 and len(V.LANGUAGES) == 16


def test_tasks(spark):
    df = local_rows(spark, [("a", 1, "train"), ("b", None, "train"), ("c", 0, "test")], "audio string, sarcasm int, split string")
    task = load_task(lambda name: df, "Mustard_sarcasm")
    assert (task.x, task.y, task.df.count()) == ("audio", "sarcasm", 1)
    with pytest.raises(KeyError):
        load_task(lambda name: df, "nothing")
    with pytest.raises(ValueError):
        load_task(lambda name: df, "FLEURS_speaker_identity")


# ---- metrics ---------------------------------------------------------------------------------------------------


def test_three_means(spark):
    df = local_rows(spark, [("a", 1.0), ("a", None), ("b", None)], "g string, score double")
    assert {r["g"]: r["mean_score"] for r in M.mean_skip_na(df, ["g"]).collect()} == {"a": 1.0, "b": None}
    assert {r["g"]: r["mean_score"] for r in M.mean_na_as_zero(df, ["g"]).collect()} == {"a": 0.5, "b": 0.0}
    assert M.mean_na_as_zero(df.where("g = 'z'")).count() == 0


def test_f1_edges(spark):
    def binary(rows):
        return M.f1_binary(local_rows(spark, rows, "truth int, pred int"), 1).first()

    assert binary([(1, 1), (1, 0), (0, 1), (0, 0), (1, None), (0, None)]).asDict() == {"tp": 1, "fp": 1, "fn": 2, "n_error": 2, "f1": 0.4}
    assert binary([(0, 0), (0, None)])["f1"] == 0.0

    def weighted(rows):
        return M.f1_weighted(local_rows(spark, rows, "truth string, pred string")).first()

    # a: 2/3 with support 2, b: 0.5 with support 2 (one error becomes neutral), neutral: no support.
    row = weighted([("a", "a"), ("a", "b"), ("b", "b"), ("b", V.ERROR_TEXT)])
    assert row["f1_weighted"] == pytest.approx((2 * 2 / 3 + 2 * 0.5) / 4) and row["n_classes"] == 3
    assert weighted([("a", "a"), ("a", "a")])["f1_weighted"] == 1.0
    assert weighted([("a", None), ("neutral", V.ERROR_TEXT)])["f1_weighted"] == 0.5


def test_label_check(spark):
    df = local_rows(spark, [("t", "Yes"), ("t", "No"), ("u", "very good"), ("u", "very bad")], "task string, label string")
    rows = {r["task"]: (r["n_multi_word"], r["is_unique"]) for r in P.check_labels(df).collect()}
    assert rows == {"t": (0, True), "u": (2, False)}
    assert "labels are not unique in u" in failure(lambda: P.check_labels(df, strict=True).collect())


# ---- prediction ------------------------------------------------------------------------------------------------


def clusters(spark, n=60):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        center = np.zeros(8)
        center[i % 3] = 5.0
        rows.append((i, [float(v) for v in center + 0.1 * rng.standard_normal(8)], f"c{i % 3}"))
    return local_rows(spark, rows, "vec_id int, embedding array<double>, label string")


def test_centroids_separate_clusters(spark):
    data = clusters(spark)
    model = CentroidPredictor.fit(data, "label")
    called = predict(data, model)
    assert called.where("pred = label and error is null").count() == 60
    top = model.scores(data).select("label", argmax_label(F.col("scores")).alias("best"))
    assert top.where("best = label").count() == 60
    blank = local_rows(spark, [(1, None, "c0")], "vec_id int, embedding array<double>, label string")
    row = predict(blank, model).first()
    assert row["pred"] == V.ERROR_TEXT and row["error"] == "no vector"
    assert model.scores(blank).first()["scores"] is None


def test_failing_rows_keep_their_ids(spark):
    def load():
        return lambda rows: [1 // row["n"] for row in rows]

    table = local_rows(spark, [(0, "kept"), (1, "kept")], "n int, other string")
    rows = predict(table, BatchPredictor(load, ["n"])).orderBy("n").collect()
    assert [r["other"] for r in rows] == ["kept", "kept"]
    assert rows[0]["pred"] == V.ERROR_TEXT and rows[0]["error"].startswith("ZeroDivisionError")
    assert rows[1]["pred"] == "1" and rows[1]["error"] is None
    rule = ColumnPredictor(F.when(F.col("n") > 0, "Yes"))
    assert [r["pred"] for r in predict(spark.range(2).select(F.col("id").alias("n")), rule).orderBy("n").collect()] == [V.ERROR_TEXT, "Yes"]


def test_argmax_ties_take_the_first(spark):
    pairs = F.array(*[F.struct(F.lit(l).alias("label"), F.lit(s).alias("score")) for l, s in (("b", 1.0), ("a", 2.0), ("c", 2.0))])
    df = spark.range(1).select("id", pairs.alias("scores"))
    row = df.select(argmax_label(F.col("scores")), argmax_label(F.col("scores"), ["b", "c"]), argmax_label(F.col("scores"), ["z"])).first()
    assert tuple(row) == ("a", "c", None)
    long = df.select("id", F.posexplode("scores").alias("ord", "e")).select("id", "ord", "e.*")
    assert argmax_rows(long, "id").first()["pred"] == "a"


def test_a_failing_call_costs_only_its_row(spark):
    calls = spark.sparkContext.accumulator(0)

    def load():
        def model(rows):
            calls.add(1)
            return [10 // row["n"] for row in rows]

        return model

    table = spark.range(64, numPartitions=1).select(F.col("id").alias("n"))
    rows = sorted(predict(table, BatchPredictor(load, ["n"], size=16)).collect(), key=lambda r: r["n"])
    assert [r["pred"] for r in rows] == [V.ERROR_TEXT, *[str(10 // n) for n in range(1, 64)]]
    assert calls.value == 4 + 16  # four calls, and the first one's rows again


def test_scorer_is_called_in_lists(spark):
    def load():
        def scorer(triples):
            if any(p == "bad" for _, p, _ in triples):
                raise ValueError
            return [float(len(ref)) for ref, _, _ in triples]

        return scorer

    rows = [(1, ["a", "abc"], "x", "q"), (2, [], "x", "q"), (3, None, "x", "q"), (4, ["abcd"], "bad", "q"), (5, ["ab"], "x", "q")]
    table = local_rows(spark, rows, "id int, answers array<string>, pred string, question string")
    assert [r["score"] for r in BatchScorer(load).apply(table).orderBy("id").collect()] == [3.0, None, None, None, 2.0]


# Stored results of the sarcasm task: tp, fp, fn, tn and the accuracy and F1 they give.
STORED = [
    (243, 225, 102, 120, 0.5261, 0.5978), (345, 344, 0, 1, 0.5014, 0.6673), (200, 153, 145, 192, 0.5681, 0.5731), (312, 267, 33, 78, 0.5652, 0.6753),
    (334, 299, 11, 46, 0.5507, 0.6830), (222, 235, 123, 110, 0.4812, 0.5536), (329, 309, 16, 36, 0.5290, 0.6694), (309, 320, 36, 25, 0.4841, 0.6345),
    (342, 344, 3, 1, 0.4971, 0.6634), (262, 224, 83, 121, 0.5551, 0.6306), (345, 344, 0, 1, 0.5014, 0.6673), (308, 266, 37, 79, 0.5609, 0.6703),
]


def test_metric_run_gives_the_stored_results(spark):
    cells = []
    for run, (tp, fp, fn, tn, _, _) in enumerate(STORED):
        cells += [(run, "true", "Yes", tp), (run, "false", "Yes", fp), (run, "true", " No ", fn), (run, "false", "No", tn)]
    pairs = local_rows(spark, cells, "run int, truth string, pred string, n int").where("n > 0").select("run", "truth", "pred", F.explode(F.sequence(F.lit(1), F.col("n"))))
    got = metric_run(pairs, V.LABEL_MAPS["Mustard_sarcasm"], ["run"]).orderBy("run").collect()
    assert [(r["metric"], round(r["accuracy"], 4), round(r["f1"], 4), r["n"]) for r in got] == [("binary", a, f, 690) for *_, a, f in STORED]


def test_metric_run_chooses_its_figure_and_is_strict(spark):
    rows = [("anger", "Anger"), ("joy", "Joy"), ("neutral", f"{V.ERROR_TEXT} (timeout)"), ("joy", "Anger")]
    pairs = local_rows(spark, rows, "truth string, pred string")
    row = metric_run(pairs, V.LABEL_MAPS["MELD_emotion_recognition"]).first()
    assert row["metric"] == "weighted" and row["accuracy"] == 0.75 and row["f1"] == pytest.approx((2 / 3 + 2 * 2 / 3 + 1) / 4)
    other = local_rows(spark, [("anger", "Rage"), ("joy", "Joy")], "truth string, pred string")
    assert "not a label: Rage" in failure(lambda: metric_run(other, V.LABEL_MAPS["MELD_emotion_recognition"]).collect())
    assert metric_run(other, V.LABEL_MAPS["MELD_emotion_recognition"], strict=False).first()["accuracy"] == 0.5
    # Labels are known by their first word, in the order of the map; the first is positive.
    short = first_words({"Yes indeed": "1", "No way": "0"})
    assert list(short.items()) == [("Yes", "1"), ("No", "0")]
    with pytest.raises(ValueError, match="not unique"):
        first_words({"No way": "0", "No": "1"})
    for metric in (lambda: M.confusion(null_pred(spark), strict=True), lambda: M.f1_weighted(null_pred(spark), strict=True), lambda: M.f1_binary(null_pred(spark), "a", strict=True)):
        assert "not in the label map" in failure(lambda: metric().collect())


def null_pred(spark):
    return local_rows(spark, [("a", "a"), ("b", None)], "truth string, pred string")


def test_session_steps_slice_a_hot_session(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.7 else rng.randrange(1, 9), rng.choice([*STEP_EVENTS, "clear"]), i) for i in range(1500)]
    rows += [(20, "clear", 2000), (21, "recording_complete", 1), (21, "page_load", 2)]
    rng.shuffle(rows)
    want = {}
    for session in {r[0] for r in rows}:
        at = []
        for pos, kind in sorted((p, k) for s, k, p in rows if s == session):
            if len(at) < 3 and kind == STEP_EVENTS[len(at)]:
                at.append(pos)
        want[session] = (len(at), *at, *[None] * (3 - len(at)))
    events = local_rows(spark, rows, "session int, kind string, pos int").repartition(5)
    for slice_rows in (40, 10**6):
        got = session_steps(events, slice_rows)
        assert {r["session"]: tuple(r)[1:] for r in got.collect()} == want


# ---- vectors ---------------------------------------------------------------------------------------------------


def brute_kmeans(x, means, iters, cosine=False):
    for _ in range(iters):
        d = -(x @ means.T) if cosine else ((x[:, None, :] - means[None]) ** 2).sum(-1)
        code = d.argmin(1)
        for c in range(len(means)):
            if (code == c).any():
                m = x[code == c].mean(0)
                means[c] = m / np.linalg.norm(m) if cosine else m
    return means, np.bincount(code, minlength=len(means))


@pytest.mark.parametrize("cosine", [False, True])
def test_kmeans_against_numpy(spark, cosine):
    data = clusters(spark, 90)
    x = np.array([r["embedding"] for r in data.orderBy("vec_id").collect()])
    start = np.array([r["vector"] for r in O.initial_means(data, "vec_id", "embedding", 5).orderBy("code").collect()])
    want, bins = brute_kmeans(x, start.copy(), 4, cosine)
    got = O.kmeans(data.repartition(7), 5, iters=4, cosine=cosine).orderBy("code").collect()
    assert np.allclose([r["vector"] for r in got], want) and [r["n"] for r in got] == list(bins)
    assert sum(r["n"] for r in got) == 90


def test_empty_cluster_keeps_its_mean(spark):
    # All points equal: the lowest code wins every tie, the others stay empty.
    data = local_rows(spark, [(i, [1.0, 0.0]) for i in range(6)], "vec_id int, embedding array<double>")
    rows = O.kmeans(data, 3, iters=2).orderBy("code").collect()
    assert [r["n"] for r in rows] == [6, 0, 0] and all(r["vector"] == [1.0, 0.0] for r in rows)


def test_codebook_in_blocks_and_ties(spark):
    data = clusters(spark)
    book = O.initial_means(data, "vec_id", "embedding", 9)
    whole = O.assign_codes(data, book).select("vec_id", "code", F.round("dist", 9))
    blocks = O.assign_codes(data, book, block_bytes=2 * 8 * 8).select("vec_id", "code", F.round("dist", 9))
    assert whole.exceptAll(blocks).count() == 0
    twins = local_rows(spark, [(0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "code int, vector array<double>")
    point = local_rows(spark, [(1, [2.0, 0.0]), (2, None)], "id int, embedding array<double>")
    for block in (16, 1 << 20):
        rows = O.assign_codes(point, twins, block_bytes=block, with_codeword=True).orderBy("id").collect()
        assert rows[0]["code"] == 1 and rows[0]["codeword"] == [1.0, 0.0] and rows[1]["code"] is None
    usage = O.code_usage(O.assign_codes(point.where("id = 1"), twins), 4).orderBy("code").collect()
    assert [r["uses"] for r in usage] == [0, 1, 0, 0]


def test_odd_vectors_are_refused_or_left_out(spark):
    nan = float("nan")
    book = local_rows(spark, [(0, [0.0, 1.0]), (1, [1.0, 0.0])], "code int, vector array<double>")
    odd = local_rows(spark, [(1, [2.0, 0.0]), (2, [nan, 1.0]), (3, [None, 1.0]), (4, None)], "id int, embedding array<double>")
    rows = O.assign_codes(odd, book).orderBy("id").collect()
    assert [r["code"] for r in rows] == [1, None, None, None] and rows[1]["dist"] is None
    means = O.code_means(odd, book, "embedding", True).collect()
    assert [(r["code"], r["n"]) for r in means] == [(1, 1)]
    for bad in ([[1.0, 0.0], [1.0, 0.0, 0.0]], [[1.0, 0.0, 0.0]]):
        ragged = local_rows(spark, list(enumerate(bad)), "id int, embedding array<double>")
        assert "entries" in failure(lambda: O.assign_codes(ragged, book).collect())


def test_distances_are_cut_to_size(monkeypatch):
    rng = np.random.default_rng(0)
    z, book = rng.normal(size=(50, 4)), rng.normal(size=(7, 4))
    whole = O.closest(z, book, False)
    monkeypatch.setattr(O, "DISTANCE_BYTES", 8 * 7 * 3)
    cut = O.closest(z, book, False)
    assert (whole[0] == cut[0]).all() and np.allclose(whole[1], cut[1])


def test_label_blocks_are_the_array_form(spark):
    data = clusters(spark).withColumn("label", F.col("vec_id") % 7)
    model = CentroidPredictor.fit(data, "label")
    whole = model.scores(data)
    for size in (8 * 8, 3 * 8 * 8, 1 << 20):  # one label, three, all of them in a block
        blocks = model.score_blocks(data, "vec_id", size)
        best = {r.vec_id: r.code for r in best_of_blocks(blocks, "vec_id").collect()}
        assert best == {r.vec_id: r.b for r in whole.select("vec_id", argmax_label(F.col("scores")).alias("b")).collect()}
        probs = softmax_scores(F.col("scores"), 0.3)
        want = {(r.vec_id, r.label): r.prob for r in whole.select("vec_id", F.inline(probs)).collect()}
        rows = softmax_blocks(blocks, "vec_id", 0.3).collect()
        got = {(r.vec_id, r["first"] + i): p for r in rows for i, p in enumerate(r.probs)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        drawn = {r.vec_id: r.code for r in draw_from_blocks(blocks, "vec_id", 0.3, 5).collect()}
        assert drawn == {r.vec_id: r.d for r in whole.select("vec_id", sample_label(probs, "vec_id", 5).alias("d")).collect()}
        assert len(set(drawn.values())) > 3
    blank = data.withColumn("embedding", F.lit(None).cast("array<double>"))
    assert model.score_blocks(blank, "vec_id").count() == 0


def test_codebook_update_against_numpy(spark):
    data = clusters(spark)
    book = O.initial_means(data, "vec_id", "embedding", 4)
    old = np.array([r["vector"] for r in book.orderBy("code").collect()])
    x = np.array([r["embedding"] for r in data.collect()])
    z = x / np.linalg.norm(x, axis=1, keepdims=True)
    code = ((z[:, None] - old[None]) ** 2).sum(-1).argmin(1)
    want = old.copy()
    for c in range(4):
        new = old[c]
        if (code == c).any():
            new = z[code == c].mean(0)
            new = new / np.linalg.norm(new)
        mixed = old[c] * 0.9 + new * 0.1
        want[c] = mixed / np.linalg.norm(mixed)
    got = O.update_codebook(book, data, decay=0.9).orderBy("code").collect()
    assert np.allclose([r["vector"] for r in got], want)


def test_ema_against_loop(spark):
    rows = [("hot" if i % 3 else "b", i, float(i % 7)) for i in range(200)]
    df = local_rows(spark, rows, "k string, i int, v double").repartition(4)
    got = {r["k"]: r["ema"] for r in O.ema(df, "k", ["i"], "v", 0.9, ranges=13).collect()}
    want = {}
    for k, _, v in rows:
        want[k] = want.get(k, 0.0) * 0.9 + v * (1 - 0.9)
    assert got == pytest.approx(want)


def test_masked_pool(spark):
    df = local_rows(spark, [(1, 0, 2.0, False), (1, 0, 9.0, True), (2, 0, 1.0, True)], "id int, cls int, value double, padded boolean")
    rows = {r["id"]: r["pooled"] for r in O.masked_mean_pool(df, ["id", "cls"]).collect()}
    assert rows[1] == pytest.approx(1 / (1 + np.exp(-2.0))) and rows[2] is None


# ---- sessions --------------------------------------------------------------------------------------------------


def test_session_steps_against_loop(spark):
    random.seed(9)
    kinds = ["page_load", "recording_complete", "responses_complete", "clear"]
    rows = [(random.randint(0, 30) if random.random() < 0.7 else 0, i, random.choice(kinds)) for i in range(400)]
    df = local_rows(spark, rows, "session int, pos int, kind string").repartition(6)
    want = {}
    for s, _, kind in rows:
        step = want.get(s, 0)
        want[s] = step + 1 if step < 3 and kind == kinds[step] else step
    assert {r["session"]: r["step"] for r in session_steps(df).collect()} == want
    # Cut anywhere, later or earlier events first: what may become a milestone is all that the rest needs.
    for cut in (1, 37, 200):
        for first, second in ((F.col("pos") < cut, F.col("pos") >= cut), (F.col("pos") >= cut, F.col("pos") < cut)):
            part = df.where(first)
            kept = open_candidates(part.select("session", "kind", "pos"), session_steps(part))
            whole = kept.union(df.where(second).select("session", "kind", "pos"))
            assert {r["session"]: r["step"] for r in session_steps(whole).collect() if r["step"]} == {k: v for k, v in want.items() if v}
