"""Consistent weighted sampling against the formulas and against exact similarities."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from assay.llm.signatures import SAMPLES, edited_fingerprints, likeness, op11_weighted_sampling, sampled_minima


def h64(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def weights(text):
    out = Counter()
    for word in re.findall("[^\x20\x09-\x0d]+", text):
        out[h64(word.encode())] += len(word)
    return out


def brute_samples(terms):
    """The sampled (term, step) of every sample, by the formulas of the method."""
    out = []
    for j in range(SAMPLES):
        best = (math.inf,)
        for term, weight in terms.items():
            first = h64(j.to_bytes(4, "little"), h64(term.to_bytes(8, "little")))
            second = h64(first.to_bytes(8, "little"))
            third = h64(second.to_bytes(8, "little"))
            u = [((x >> s & 0xFFFFFFFF) + 0.5) / 2**32 for x, s in ((first, 0), (first, 32), (second, 0), (second, 32), (third, 0))]
            r, c = -math.log(u[0]) - math.log(u[1]), -math.log(u[2]) - math.log(u[3])
            step = math.floor(math.log(weight) / r + u[4])
            y = math.exp(r * (step - u[4]))
            best = min(best, (c / (y * math.exp(r)), term, step))
        out.append(best[1:])
    return out


def alike(a, b):
    if not a or not b:
        return float(not a and not b)
    return sum(x == y for x, y in zip(brute_samples(a), brute_samples(b))) / SAMPLES


def edit(text, after):
    cut = len(text) // 4
    return text[: len(text) - cut] + after[:cut]


def similarity(a, b):
    low = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
    return low / (sum(a.values()) + sum(b.values()) - low)


def test_query_is_brute_force(spark, sf_dir):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in op11_weighted_sampling(spark, sf_dir).collect()}
    assert sorted(got) == [i for i, _ in docs]
    by_text, errors = {}, []
    for k, (doc_id, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        row, edited = got[doc_id], edit(text, after)
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, row.fingerprint) == row.fingerprint
        a, b, c = weights(text), weights(edited), weights(after)
        if len(text) < 1500 or k in (0, len(docs) - 1):
            assert row.near_edited == pytest.approx(alike(a, b)) and row.near_next == pytest.approx(alike(a, c)), doc_id
        if a and b:
            errors.append(row.near_edited - similarity(a, b))
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.35


def test_collisions_are_as_likely_as_sets_are_similar(spark):
    rng, samples = random.Random(3), 1600
    for share in (0.2, 0.6, 0.95):
        a = {t: rng.choice([0.3, 1.0, 2.5, 40.0]) for t in range(60)}
        b = {t: w * rng.choice([1, 1, 2]) for t, w in a.items() if rng.random() < share} | {100: 3.0}
        rows = [(s, t, w) for s, terms in ((1, a), (2, b)) for t, w in terms.items()]
        minima = sampled_minima(spark.createDataFrame(rows, "set int, term long, weight double"), ["set"], samples)
        found = {}
        for r in minima.collect():
            found.setdefault(r.set, {})[r.block] = [r[f"m{k}"] for k in range(8)]
        same = sum(x == y for block in found[1] for x, y in zip(found[1][block], found[2][block])) / samples
        want = similarity(Counter(a), Counter(b))
        assert abs(same - want) < 4 * math.sqrt(want * (1 - want) / samples) + 0.005


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, long), (None, "né à\tb 　 \U0001f600" * 3), (1, None), (2, ""), (3, " \n\t  "), (4, "one"), (4, "one"), (4, "two words here"), (9, "Ⅷ" * 9)]
    table = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "doc_id long, text string, part int, row string, guest boolean")
    for partitions in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = edited_fingerprints(table).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((i or 0, len(t or "")) for i, t in rows)
        four = sorted((t for i, t in rows if i == 4), key=lambda t: (h64(t.encode()) ^ 1 << 63))
        order = [rows[1][1], "", "", rows[4][1], *four, long, rows[8][1]]
        want = sorted((len(t), hashlib.sha256(edit(t, order[(k + 1) % len(order)]).encode()).hexdigest()) for k, t in enumerate(order))
        assert sorted((r.n_chars, r.edited_sha256) for r in got) == want
        assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {""}
        assert all(0 <= v <= 1 for r in got for v in (r.near_edited, r.near_next))
        assert [r.near_next for r in got if r.doc_id == 1] == [1.0] and [r.near_next for r in got if r.doc_id is None] == [0.0]
        assert all(len(r.fingerprint) == 4 * SAMPLES for r in got if r.doc_id in (4, 5, 9))
    assert edited_fingerprints(table.where("false")).count() == 0
    alone = edited_fingerprints(table.where("doc_id = 9")).first()
    assert alone.near_next == 1.0 and alone.near_edited == 1.0


def test_likeness_of_nothing(spark):
    row = spark.range(1).select(likeness(F.lit(""), F.lit("")), likeness(F.lit(""), F.lit("0" * 4 * SAMPLES)), likeness(F.lit("0" * 4 * SAMPLES), F.lit("0" * 4 * SAMPLES))).first()
    assert tuple(row) == (1.0, 0.0, 1.0)


def test_texts_are_exchanged_once(spark, sf_dir):
    df = op11_weighted_sampling(spark, sf_dir)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    exchanges = [line for line in final.splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(exchanges) == 2 and sum("ReusedExchange" in line for line in exchanges) == 1
