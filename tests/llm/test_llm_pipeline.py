"""Every stage of the pipeline against a brute-force version of it on its own input."""

import corpus_pipeline
import pytest
from test_llm_operators import brute_classes, split

from assay.llm.quality import quality_scores


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Rows of ``documents`` and of every stage, by name, each written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages_keep_the_columns(stages):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "packing"]
    assert all(sorted(stages[n].columns) == sorted(stages["documents"].columns) for n in names[:-1])
    counts = [stages[n].count() for n in ("documents", *names[:-1])]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[2] > counts[-1] > 0


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_quality_keeps_what_scores_well(spark, sf_dir, stages):
    scores = quality_scores(stages["documents"], spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert set(texts(stages["quality_classifier"])) == {r.doc_id for r in scores if r.score >= 0.5}
    assert 0 < sum(r.score < 0.5 for r in scores) < 0.4 * len(scores)


def test_one_document_of_each_class_stays(stages):
    before = texts(stages["quality_classifier"])
    assert texts(stages["ngram_jaccard_join"]) == {i: before[i] for i in {root for _, _, root in brute_classes(list(before.items()))}}


def test_repeated_passages_are_cut(stages):
    before, after = texts(stages["ngram_jaccard_join"]), texts(stages["substring_dedup"])
    seen_runs, seen_grams, changed = set(), set(), 0
    for i in sorted(before):
        words = split(before[i], False)
        runs = {tuple(words[j : j + 40]) for j in range(len(words) - 39)}
        grams = {tuple(words[j : j + 8]) for j in range(len(words) - 7)}
        if after.get(i) == before[i]:
            # What stays whole holds no passage of forty words that an earlier document held.
            assert not runs & seen_runs
        else:
            changed += 1
            assert grams & seen_grams
        seen_runs |= runs
        seen_grams |= grams
    for i in after:
        kept = iter(split(before[i], False))
        assert all(word in kept for word in split(after[i], False))  # only cut, never moved
    assert changed


def test_documents_with_benchmark_windows_go(spark, sf_dir, stages):
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = split(r.text, False)
        windows |= {tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9))}
    before = texts(stages["substring_dedup"])
    clean = {i: t for i, t in before.items() if not any(tuple(split(t, False)[j : j + 10]) in windows for j in range(len(split(t, False))))}
    assert texts(stages["benchmark_decontamination"]) == clean


def test_every_token_is_packed(stages):
    want = {i: len(split(t)) + 1 for i, t in texts(stages["benchmark_decontamination"]).items()}
    got = {}
    for r in stages["packing"].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.length <= r.bucket
    assert got == want


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.exceptAll(stages["packing"]).count() == 0 and rows.count() == stages["packing"].count()


def test_run_stands_odd_rows(spark, sf_dir, tmp_path):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, long), (2, None), (2, ""), (3, long), (None, long), (4, "one"), (4, "one"), (4, "two words"), (5, " \n . ")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, spans int, c1 long, _copy int"
    for name, kept in (("odd", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame([(*r, None, "s", len(r[1] or ""), "x", 1, 2, 3) for r in kept], kind).write.parquet(str(folder / "documents.parquet"))
        for table in ("labels", "benchmark"):
            source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            (source if kept else source.where("false")).write.parquet(str(folder / f"{table}.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for stage, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, docs, str(folder))
            assert sorted(out.columns) == sorted(docs.columns), stage
            assert out.count() <= docs.count(), stage
        packed = corpus_pipeline.run(spark, str(folder))
        assert packed.count() >= 0 and (kept or packed.count() == 0)
