"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from test_llm_operators import prose

from assay.llm import periods
from assay.llm.periods import Extensions, op13_difference_cover_runs, periodic_runs, runs
from assay.llm.words import mix


def words_in(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute_runs(words):
    """Every maximal stretch of a period, by looking at all places of all periods."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in out.items())


def repeating(rng):
    """Texts of repeats within repeats, broken ones, ones at the ends, and prose of few words."""
    out = [[], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 500, list("ab") * 12, list("ab") * 40 + ["b"] * 30]
    for _ in range(60):
        words = prose(rng, rng.randrange(60), 5)
        for _ in range(rng.randrange(1, 5)):
            unit = prose(rng, rng.choice([1, 2, 3, 5, 8, 13, 40, 90]), rng.choice([2, 3, 50]))
            if rng.random() < 0.4:
                unit = unit * 4 + prose(rng, 1)
            part = unit * rng.randrange(1, 7)
            words += part[: rng.randrange(len(part) + 1)] if rng.random() < 0.5 else part
            words += prose(rng, rng.randrange(40), rng.choice([2, 50]))
        out.append(words)
    out += [prose(rng, n, k) for n, k in ((300, 2), (2000, 2), (3000, 3), (700, 1), (5000, 30))]
    return out


def hashed(texts):
    ids = {}
    flat = np.array([ids.setdefault(w, len(ids)) for t in texts for w in t], np.uint64)
    return mix(flat + np.uint64(1)), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def test_any_two_places_reach_the_cover():
    assert (periods.SHIFTS >= 0).all() and (periods.SHIFTS < periods.COVER).all()
    assert len({(a - b) % periods.COVER for a in periods.RESIDUES for b in periods.RESIDUES}) == periods.COVER


def test_extensions_are_those_of_comparing_words():
    rng = random.Random(4)
    for text in repeating(rng):
        words, _ = hashed([text])
        words = np.append(words, np.uint64(7))
        lce = Extensions(words, len(words))
        pairs = [(rng.randrange(len(words)), rng.randrange(len(words))) for _ in range(80)]
        pairs = [(i, j) for i, j in pairs if i != j]
        if not pairs:
            continue
        want = []
        for i, j in pairs:
            k = 0
            while max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            want.append(k)
        assert lce.common(*np.array(pairs).T).tolist() == want


def test_runs_are_those_of_brute_force(monkeypatch):
    texts = repeating(random.Random(5))
    for grid in (periods.GRID, 64):
        monkeypatch.setattr(periods, "GRID", grid)
        got = [[] for _ in texts]
        for t, *run in zip(*(c.tolist() for c in runs(*hashed(texts)))):
            got[t].append(tuple(run))
        assert got == [brute_runs(t) for t in texts]


def brute_row(doc_id, text):
    words = words_in(text)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        a = h // 10 % len(words)
        p = 1 + (len(words) - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha(lines), sha(kept))


def test_query_is_brute_force(spark, sf_dir):
    rows = {r.doc_id: tuple(r) for r in op13_difference_cover_runs(spark, sf_dir).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        assert rows[doc_id] == brute_row(doc_id, text)
    assert sum(r[1] > 0 for r in rows.values()) > 10


def test_odd_rows(spark):
    again = "Ünit Eins\t zwei 　 " * 20
    rows = [(1, again), (1, again), (None, again), (2, None), (3, ""), (4, " \n "), (5, "one " * 60_000), (6, " ".join(f"w{i}" for i in range(50_000))), (20, again), (7, "a A " * 12)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, runs string, n_words int")
    got = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.strongest and tuple(r.strongest)) for r in periodic_runs(table).collect()}
    four = (0, 80, 4)
    assert got == {(1, 80, (four,), four), (None, 80, (four,), four), (20, 80, (four,), four), (2, 0, (), None), (3, 0, (), None), (4, 0, (), None), (5, 60_000, ((0, 60_000, 1),), (0, 60_000, 1)), (6, 50_000, (), None), (7, 24, ((0, 24, 2),), (0, 24, 2))}
    assert periodic_runs(table).count() == len(rows)
    one = {r.collapsed_sha256 for r in periodic_runs(table).where("doc_id = 1").collect()}
    assert one == {hashlib.sha256("Ünit Eins zwei 　".encode()).hexdigest()}
    assert periodic_runs(table.where("false")).count() == 0
