"""Operators against brute force, exact round trips and held-out accuracy."""

import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assay.llm import embeddings, jaccard, packing, passages, quality, sharding, token_files
from assay.llm.graph import components
from assay.llm.licenses import TEMPLATES, license_notices
from assay.llm.token_files import Encoder, code, decode, read_token_files, write_token_files
from assay.llm.words import alphanumeric, unspaced, words_of


def plain(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def split(text, spaced=True):
    return re.findall("[^\x20\x09-\x0d]+" if spaced else "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", plain(text))


def prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, words, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aZé9 \t\n\x0b.-_　ß\x1f") for _ in range(rng.randrange(40))) for _ in range(400)] + [None, "", "x" * 3000, "A" * 5]
    for table, spaced in ((unspaced(), True), (alphanumeric(), False)):
        words = words_of(pa.array(texts), table)
        hashes = {}
        for row, text in enumerate(texts):
            low, high = words.offsets[row], words.offsets[row + 1]
            assert [words.text(i, i + 1) for i in range(low, high)] == split(text, spaced)
            for word, value in zip(split(text, spaced), words.hash[low:high].tolist()):
                assert hashes.setdefault(word, value) == value
        assert len(set(hashes.values())) == len(hashes)
        # A slice of a longer array is read from its own place.
        part = words_of(pa.array(texts)[100:200], table)
        assert (part.hash == words.hash[words.offsets[100] : words.offsets[200]]).all()


def brute_classes(rows):
    sets = {}
    for i, text in rows:
        w = split(text)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(i, len(sets[i]), find(i)) for i in sets}


def near_copies(rng):
    """Chains of light edits, a group of copies that are similar to one text but hardly to each other, and shared passages."""
    texts = [" ".join(prose(rng, n)) for n in (3, 5, 9, 60, 300, 1500)]
    for share in (0.005, 0.02, 0.03, 0.05):
        base = prose(rng, 200)
        for _ in range(25):
            texts.append(" ".join(edited(rng, base, share)))
    step = prose(rng, 150)
    for _ in range(30):
        step = edited(rng, step, 0.02)
        texts.append(" ".join(step))
    passage = prose(rng, 60)
    texts += [" ".join(prose(rng, 20) + passage + prose(rng, 20)) for _ in range(40)]
    texts += [" ".join(passage + prose(rng, rng.randrange(12))) for _ in range(20)]
    texts += texts[:10] + [None, "", "  "]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("frequent_from", [4, 10**9])
def test_similarity_classes_are_those_of_all_pairs(spark, monkeypatch, frequent_from):
    # Small limits, so that salts, several tries of a hub and several blocks of a shingle are all met.
    for name, value in (("FREQUENT_FROM", frequent_from), ("SALTS", 3), ("TRIE_ROWS", 4), ("BLOCK_ROWS", 8)):
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies(random.Random(5))
    got = jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert {tuple(r) for r in got.collect()} == brute_classes(rows)


def test_trie_finds_what_all_comparisons_find():
    rng = np.random.default_rng(3)
    for _ in range(200):
        hub = np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64))
        others = [np.unique(np.where(rng.random(len(hub)) < rng.random() / 2, rng.integers(0, 90, len(hub)), hub).astype(np.uint64)) for _ in range(12)]
        want = [i for i, o in enumerate(others) if 100 * len(np.intersect1d(hub, o)) >= 75 * len(np.union1d(hub, o))]
        assert sorted(jaccard.similar_in_trie(hub, others)) == want


def test_components_reach_along_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 400)] + [(400, 399), (3, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(200, 401)}, 7: 7}


def test_chains_score_as_all_predecessors_do():
    rng = np.random.default_rng(2)
    for _ in range(100):
        n = int(rng.integers(2, 25))
        start, hub = rng.integers(0, 200, n), rng.integers(0, 200, n)
        order = np.lexsort((hub, start))
        start, hub, size = start[order], hub[order], rng.integers(8, 20, n)
        best = []
        for i in range(n):
            gains = [best[j] - passages.GAP_COST * (start[i] - start[j] - size[j] + hub[i] - hub[j] - size[j]) for j in range(i) if start[j] + size[j] <= start[i] and hub[j] + size[j] <= hub[i]]
            best.append(size[i] + max([0.0, *gains]))
        found = passages.chains(start, hub, size)
        assert sorted(i for c in found for i in c) == list(range(n))
        for chain in found:
            assert all(start[a] + size[a] <= start[b] and hub[a] + size[a] <= hub[b] for a, b in zip(chain, chain[1:]))

        def score(chain):
            gaps = sum(start[b] - start[a] - size[a] + hub[b] - hub[a] - size[a] for a, b in zip(chain, chain[1:]))
            return sum(size[i] for i in chain) - passages.GAP_COST * gaps

        # The first chain is the best of all, unless a gap was too long and parted it.
        if all(max(start[b] - start[a] - size[a], hub[b] - hub[a] - size[a]) <= passages.MAX_GAP for c in found for a, b in zip(c, c[1:])) and max(best) <= 2 * passages.MAX_GAP:
            assert math.isclose(max(map(score, found)), max(best)) or max(map(score, found)) < max(best)


def test_planted_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(4)
    exact, fuzzy, long = prose(rng, 55, 10**6), prose(rng, 120, 10**6), prose(rng, 2500, 10**6)
    rows, planted = [], {}
    for i in range(200):
        words = prose(rng, rng.randrange(50, 400), 10**6)
        kind = i % 5
        passage = {1: exact, 2: edited(rng, fuzzy, 0.03), 3: edited(rng, long, 0.01)}.get(kind)
        if passage:
            at = rng.randrange(len(words))
            words[at:at] = passage
            planted[i] = (at, at + len(passage), kind)
        if kind == 4:
            words[10:10] = exact[:20]  # too short to be a passage
        rows.append((i, " ".join(words)))
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    first = {k: min(i for i in planted if planted[i][2] == k) for k in (1, 2, 3)}
    covered = {}
    for r in found:
        low, high, _ = planted[r.doc_id]
        assert r.other_id < r.doc_id and r.similarity >= 0.75 and r.start_word >= low - 8 and r.end_word <= high + 8
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert set(covered) == set(planted) - set(first.values())
    assert all(len(covered[i]) >= 0.9 * (planted[i][1] - planted[i][0]) for i in covered)
    kept = {r.doc_id: r.text for r in passages.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        if i not in covered:
            assert kept[i] == text
        elif planted[i][2] == 1:
            words = split(text)
            assert split(kept[i]) == [w for n, w in enumerate(words) if n not in covered[i]]


def brute_passages(rows, size=40, equal=30):
    """Words of each document that lie in ``size`` words, equal at both ends, of which ``equal`` stand in the same places of an earlier one."""
    hit = {i: set() for i, _ in rows}
    for (_, a), (j, b) in itertools.combinations([(i, np.array(t.split())) for i, t in sorted(rows)], 2):
        for shift in range(-len(b) + size, len(a) - size + 1):
            low, high = max(0, -shift), min(len(b), len(a) - shift)
            same = b[low:high] == a[low + shift : high + shift]
            sums = np.concatenate([[0], np.cumsum(same)])
            for at in np.flatnonzero((sums[size:] - sums[:-size] >= equal) & same[: len(same) - size + 1] & same[size - 1 :]):
                hit[j].update(range(low + at, low + at + size))
    return hit


def words_in_passages(spark, rows):
    covered = {i: set() for i, _ in rows}
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        assert r.other_id < r.doc_id and r.similarity >= 0.75 and r.end_word - r.start_word >= 40
        a, b = dict(rows)[r.doc_id].split()[r.start_word : r.end_word], dict(rows)[r.other_id].split()[r.other_start : r.other_end]
        if len(a) == len(b):
            assert sum(x == y for x, y in zip(a, b)) >= 0.75 * len(a)
        covered[r.doc_id].update(range(r.start_word, r.end_word))
    return covered


def reworded(rng, words, likeness):
    """Words put in, left out and changed at random places, so that about this share of the longer side stays equal."""
    out, edits = list(words), round(len(words) * (1 - likeness))
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        out[at : at + (kind != 0)] = [] if kind == 2 else [f"e{rng.randrange(10**6)}"]
    return out


def test_passages_with_words_put_in_and_left_out_are_found(spark):
    rng = random.Random(15)
    rows, planted = [], {}
    for case in range(160):
        kind = ("in 8", "in 12", "in 16", 0.95, 0.9, 0.85, 0.8, 0.76)[case % 8]
        passage = prose(rng, 60, 10**6)
        if isinstance(kind, str):
            step = int(kind.split()[1])
            again = [w for i, word in enumerate(passage) for w in ([word, f"e{rng.randrange(10**6)}"] if i % step == step - 1 else [word])]
        else:
            again = reworded(rng, passage, kind)
        for doc, part in ((2 * case, passage), (2 * case + 1, again)):
            before = prose(rng, 50, 10**6)
            rows.append((doc, " ".join(before + part + prose(rng, 50, 10**6))))
            planted[doc] = (50, 50 + len(part), kind)
    found = {}
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        low, high, _ = planted[r.doc_id]
        assert r.other_id == r.doc_id - 1 and r.similarity >= 0.75
        found[r.doc_id] = max(found.get(r.doc_id, 0), (min(high, r.end_word) - max(low, r.start_word)) / (high - low))
    recall = {}
    for doc, (_, _, kind) in planted.items():
        if doc % 2:
            recall.setdefault(kind, []).append(found.get(doc, 0) >= 0.6)
    shares = {kind: sum(hits) / len(hits) for kind, hits in recall.items()}
    print(shares)
    assert min(v for k, v in shares.items() if k != 0.76) >= 0.9 and shares[0.76] >= 0.6, shares


def test_pairs_of_near_copies_grow_with_their_number(spark):
    rng = random.Random(16)
    base = prose(rng, 300, 10**6)
    sizes = {}
    for n in (60, 240):
        rows = [(i, " ".join(edited(rng, base, 0.05))) for i in range(n)]
        found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert {r.doc_id for r in found} == set(range(1, n))
        sizes[n] = len({(r.doc_id, r.other_id) for r in found}) / n
    assert sizes[240] <= 1.5 * sizes[60] and sizes[240] < 12


def test_matches_do_not_depend_on_the_batches():
    rng = random.Random(17)
    rows = sorted({(rng.randrange(6), rng.randrange(12), rng.randrange(40)) for _ in range(300)})
    rows = [(s, d, p if rng.random() < 0.7 else ~p) for s, d, p in rows]
    want = set()
    for seed in range(6):
        mine = [(d, p if p >= 0 else ~p, p >= 0) for s, d, p in rows if s == seed]
        for k, (d, p, seeks) in enumerate(mine):
            earlier = [(e, q) for e, q, _ in mine[:k] if e < d]
            if seeks and earlier:
                want |= {(d, *hub, p) for hub in {earlier[0]} | ({earlier[-1]} if earlier[-1][0] != earlier[0][0] else set())}
    for size in (1, 2, 7, 1000):
        batches = []
        for low in range(0, len(rows), size):
            s, d, p = zip(*rows[low : low + size])
            batches.append(pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(d, pa.int64()), pa.array(p, pa.int32())], names=["seed", "doc_id", "pos"]))
        got = {(d, h, q, p) for b in passages._short_matches(iter(batches)) for d, h, p, q in zip(*(b[c].to_pylist() for c in ("doc_id", "hub", "pos", "hub_pos")))}
        assert got == want, size


def test_places_of_a_seed_are_matched_in_turn_whatever_the_batches():
    rng = random.Random(27)
    rows = sorted({(rng.randrange(5), rng.randrange(9), rng.randrange(40)) for _ in range(400)})
    want = set()
    for (s, d), mine in itertools.groupby(rows, key=lambda r: r[:2]):
        docs = sorted({e for t, e, _ in rows if t == s and e < d})
        for k, (_, _, p) in enumerate(mine):
            for at, e in enumerate(dict.fromkeys([*docs[:1], *docs[-1:]])):
                held = [q for t, f, q in rows if (t, f) == (s, e)]
                want |= {(d, e, p, held[-at]), (d, e, p, held[k % len(held)])}
    for size in (1, 3, 50, 1000):
        batches = []
        for low in range(0, len(rows), size):
            s, d, p = zip(*rows[low : low + size])
            batches.append(pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(d, pa.int64()), pa.array(p, pa.int32())], names=["seed", "doc_id", "pos"]))
        got = [r for b in passages._short_matches(iter(batches), in_turn=True) for r in zip(*(b[c].to_pylist() for c in ("doc_id", "hub", "pos", "hub_pos")))]
        assert set(got) == want, size


def test_runs_of_a_few_words_need_no_pairs_of_all_places(spark, monkeypatch):
    rng, sought = random.Random(28), []
    rows = [(i, " ".join([*prose(rng, 30), *(["is", "one"] * 40), *prose(rng, 30)])) for i in range(12)]
    pairs = passages._rest_pairs
    monkeypatch.setattr(passages, "_rest_pairs", lambda docs, kept, *rest: sought.append(kept.where("seeks > 0").count()) or pairs(docs, kept, *rest))
    covered = words_in_passages(spark, rows)
    assert all(covered[i] >= set(range(30, 110)) for i in range(1, 12)) and not covered[0]
    # The first document's alone, of 80 each.
    assert sought[0] <= 100


def test_rare_runs_are_kept_in_every_window():
    rng = random.Random(18)
    key = np.array([rng.randrange(200) for _ in range(500)], np.uint32)
    got = passages.rare_enough(key, 38, 7)
    want = [any(sum(key[j] < key[i] for j in range(max(0, s), min(500, s + 38))) >= 7 for s in range(i - 37, i + 1)) for i in range(500)]
    assert got.tolist() == want and 0 < got.sum() < 500


def test_edited_passages_are_those_of_brute_force(spark):
    rng = random.Random(12)
    rows, whole = [], {}

    def plant(words, changed):
        n = len(rows)
        copy = [f"x{n}x{k}" if k in changed else w for k, w in enumerate(words)]
        for part, i in ((words, n), (copy, n + 1)):
            at = rng.randrange(30)
            whole[i] = range(at, at + len(words))
            rows.append((i, " ".join(prose(rng, at, 10**7) + part + prose(rng, rng.randrange(30), 10**7))))
        del whole[n]

    for every in (4, 5, 6, 7, 8, 10, 20):  # evenly
        for size in (40, 60, 150):
            plant(prose(rng, size, 10**7), set(range(every - 2, size - 1, every)))
    plant(prose(rng, 50, 10**7), {17, 34})
    for share in (0.05, 0.1, 0.15, 0.2, 0.25):  # at random, not at the ends
        for size in (40, 41, 50, 80):
            plant(prose(rng, size, 10**7), set(rng.sample(range(1, size - 1), int(share * size))))
    want, got = brute_passages(rows), words_in_passages(spark, rows)
    assert all(len(want[i]) >= 40 for i in whole if len(whole[i]) == 40)
    for i, _ in rows:
        # All of a passage of 40 words; the ends of longer ones only as far as they gain.
        assert len(want[i] & got[i]) >= (1 if len(want[i]) == 40 else 0.9) * len(want[i]), i
        assert got[i] <= set(whole.get(i, ()))


def test_a_passage_with_parts_in_other_documents_is_found(spark):
    rng = random.Random(13)
    rows = []
    for n in range(0, 40, 4):
        p = prose(rng, 60, 10**7)
        for k, part in enumerate((p[:37], p[23:], p, p)):
            rows.append((n + k, " ".join(prose(rng, 20, 10**7) + part + prose(rng, 20, 10**7))))
    # A long passage of stock sentences that stand alone in many documents.
    stock = [prose(rng, 25, 10**7) for _ in range(8)]
    rows += [(100 + k, " ".join(prose(rng, 30, 10**7) + stock[k % 8] + prose(rng, 30, 10**7))) for k in range(80)]
    rows += [(k, " ".join(prose(rng, 20, 10**7) + sum(stock, []) + prose(rng, 20, 10**7))) for k in (300, 301)]
    got = words_in_passages(spark, rows)
    for i, _ in rows:
        whole = range(20, 80) if i < 40 and i % 4 == 3 else range(20, 220) if i == 301 else ()
        assert set(whole) == got[i], i


def test_passages_of_holders_in_the_middle_are_found(spark):
    """Neither the first holders of any seed nor those right before hold the passage: they have single sentences of it."""
    rng = random.Random(21)
    stock = [prose(rng, 12, 10**7) for _ in range(6)]
    whole = sum(stock, [])
    changed = [f"x{k}" if k % 7 == 5 else w for k, w in enumerate(whole)]
    longer = [w for k, word in enumerate(whole) for w in ([word, f"y{k}"] if k % 10 == 9 else [word])]
    rows = []

    def add(doc, part):
        rows.append((doc, " ".join(prose(rng, 20, 10**7) + part + prose(rng, 20, 10**7))))

    for k in range(60):
        add(k, stock[k % 6])
        add(200 + k, stock[k % 6])
        add(400 + k, stock[k % 6])
    add(100, whole)
    for doc, part in ((500, whole), (501, changed), (502, longer)):
        add(doc, part)
        for k in range(6):
            add(doc + 100 + k, stock[k])
    # What 500 holds is an exact copy, so those after it have only 100 to go by.
    got = words_in_passages(spark, [r for r in rows if r[0] != 500] + [r for r in rows if r[0] == 500])
    assert {i for i, _ in rows if got[i]} == {500, 501, 502}
    assert got[500] == set(range(20, 92))
    for doc, n in ((501, len(changed)), (502, len(longer))):
        assert len(got[doc] & set(range(20, 20 + n))) >= 0.8 * n and got[doc] <= set(range(18, 22 + n)), doc


def test_shared_seeds_and_their_rarest_are_those_of_the_plain_rule(monkeypatch):
    rng = random.Random(22)
    monkeypatch.setattr(passages, "MANY", 8)
    rows = sorted((rng.randrange(40) if rng.random() < 0.7 else 3, rng.randrange(12)) for _ in range(600))
    columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
    table = pa.RecordBatch.from_arrays([*columns, pa.array(range(600), pa.int32())], names=["seed", "doc_id", "pos"])
    count, docs = Counter(s for s, _ in rows), {}
    for s, d in rows:
        docs.setdefault(s, set()).add(d)
    want = [(s, d, p, min(count[s], 8)) for p, (s, d) in enumerate(rows) if len(docs[s]) > 1]
    for size in (1, 7, 50, 600):
        batches = [table.slice(a, size) for a in range(0, 600, size)]
        shared = passages.Shared()
        told = [*(b for batch in batches for b in shared.take(batch)), *shared.close()]
        got = [r for b in told for r in zip(*(b[k].to_pylist() for k in ("hub", "doc_id", "pos", "hub_pos")))]
        assert got == want
    monkeypatch.undo()
    # Any eight shared runs of a window have their least frequent one among those kept.
    at = sorted(rng.sample(range(3000), 900))
    n = [rng.choice((2, 3, 900)) for _ in at]
    doc = pa.RecordBatch.from_arrays(
        [pa.array([rng.randrange(10**15) for _ in at], pa.int64()), pa.array([5] * 900, pa.int64()), pa.array(at, pa.int32()), pa.array([1] * 900, pa.int32()), pa.array(n, pa.int32())],
        names=["seed", "doc_id", "pos", "seeks", "n"],
    )
    kept = {p for b in passages._rarest(40, 0.75)(iter([doc])) for p in b["pos"].to_pylist()}
    frequency = dict(zip(at, n))
    for low in range(0, 2960, 3):
        places = [p for p in at if low <= p < low + 38]
        if len(places) >= 8:
            some = rng.sample(places, 8)
            least = min(frequency[p] for p in some)
            assert any(p in kept for p in some if frequency[p] == least)
    assert len(kept) < 900


def test_products_of_matrices_leave_out_no_alike_pair():
    rng = np.random.default_rng(23)
    width, n = passages._around(40)[1], 120
    words = passages.mix(rng.integers(1, 400, (n, width)).astype(np.uint64)).astype(np.uint16)
    for k in range(0, n, 2):
        changed = rng.random(width) < rng.choice([0.1, 0.2, 0.3])
        words[k + 1] = np.where(changed, words[k + 1], np.roll(words[k], rng.integers(-passages.OFF, passages.OFF)))
    words[5, :20] = words[8, 60:] = words[9] = 0
    i, j = (x.ravel() for x in np.meshgrid(range(n), range(n), indexing="ij"))
    alike = passages.alike_words(words[i], words[j], 40, 30).reshape(n, n)
    maybe = passages.maybe_alike(words, words, 40, 30)
    assert alike.sum() > n and not (alike & ~maybe).any() and maybe.mean() < 0.1


def test_cells_in_turns_give_the_same_passages_and_leave_no_tables(spark, monkeypatch):
    rng = random.Random(24)
    rows = []
    for group in range(4):
        stock = [prose(rng, 12, 10**7) for _ in range(6)]
        whole = sum(stock, [])
        changed = [f"x{group}x{k}" if k % 7 == 5 else w for k, w in enumerate(whole)]
        for k, part in enumerate([*stock * 5, whole, *stock * 5, changed, whole, *stock]):
            rows.append((group * 1000 + k, " ".join(prose(rng, 20, 10**7) + part + prose(rng, 20, 10**7))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tables, put = [], passages.written

    def watched(df, label, *args):
        tables.append((label, put(df, label, *args)))
        return tables[-1][1]

    monkeypatch.setattr(passages, "written", watched)
    want = {tuple(r) for r in passages.repeated_passages(docs).collect()}
    assert len({r[0] for r in want}) == 8 and [x for x, _ in tables].count("rest") == 1
    # Neither words nor matches stay on disk.
    for label, df in tables:
        assert label in ("passages", "covered") or not any(os.path.exists(f.removeprefix("file://")) for f in df.inputFiles()), label
    tables.clear()
    for name, value in (("PASS", 1), ("CELL", 4), ("DENSE", 2)):
        monkeypatch.setattr(passages, name, value)
    assert {tuple(r) for r in passages.repeated_passages(docs).collect()} == want
    assert [x for x, _ in tables].count("rest") > 2


def test_places_without_a_partner_get_no_words(spark, monkeypatch):
    """Of a seed's places only those that seek behind a holder, and those that hold before one that seeks."""
    rows = [(d, 7, p, 1 - (d == 9), 1, 5) for d, p in ((1, 0), (2, 30), (9, 0))]  # 9 seeks nothing
    rows += [(3, 8, 0, 0, 1, 2), (4, 8, 0, 0, 1, 2), (5, 9, 0, 1, 0, 2), (6, 9, 0, 0, 1, 2), (1, 10, 50, 1, 1, 2)]
    kept = spark.createDataFrame(rows, "doc_id long, seed long, pos int, seeks int, holds int, n int")
    docs = spark.createDataFrame([(d, " ".join(f"w{d}x{k}" for k in range(60))) for d in range(10)], "doc_id long, text string")
    seen, put = [], passages.written

    def watched(df, label, *args):
        out = put(df, label, *args)
        if label == "coded":
            seen.extend((r.doc_id, w.seed, w.seeks, w.holds) for r in out.collect() for w in r.wanted)
        return out

    monkeypatch.setattr(passages, "written", watched)
    passages._rest_pairs(docs, passages.written(kept, "rarest"), 40, 0.75)
    assert sorted(seen) == [(1, 7, 0, 1), (2, 7, 1, 0)]


def test_attention_gradients_are_slopes():
    rng = np.random.default_rng(1)
    model = quality.AttentionPooling()
    x, offsets, y = rng.normal(size=(7, quality.FEATURES)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])
    grads = model.gradients(x, offsets, y)

    def loss():
        p = model.forward(x, offsets)["y"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, value in model.p.items():
        at = tuple(rng.integers(0, s) for s in value.shape)
        keep = value[at]
        value[at] = keep + 1e-5
        up = loss()
        value[at] = keep - 1e-5
        slope = (up - loss()) / 2e-5
        value[at] = keep
        assert abs(slope - grads[name][at]) < 1e-6


def test_passage_features_do_not_depend_on_the_batch():
    rng = random.Random(3)
    texts = [None, "", "one", " lead", *(" ".join(prose(rng, n)) for n in (63, 64, 65, 200)), "tail \n"]
    x, offsets = quality.encode(pa.array(texts))
    assert np.diff(offsets).tolist() == [1, 1, 1, 1, 1, 1, 2, 4, 1]
    for i, text in enumerate(texts):
        alone, _ = quality.encode(pa.array([text], pa.string()))
        assert np.allclose(alone[:, quality.BUCKETS :], x[offsets[i] : offsets[i + 1], quality.BUCKETS :])


def test_trigrams_do_not_cross_rows():
    rng = random.Random(3)
    texts = ["ab", "x", "", None, "cd", " lead", *(" ".join(prose(rng, n)) for n in (1, 63, 65, 200)), "ab", "same text", "tail \n", "same text"]
    x, offsets = quality.encode(pa.array(texts))
    for i, text in enumerate(texts):
        alone, _ = quality.encode(pa.array([text], pa.string()))
        assert np.allclose(alone, x[offsets[i] : offsets[i + 1]])


def test_quality_holds_on_unseen_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scores = quality.quality_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    rows = scores.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.93 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scores.collect())


@pytest.fixture(scope="module")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_batches_give_the_ids_of_single_texts(tokenizer_path):
    rng = random.Random(2)
    letters = "aabcé 'sdt1.,\n\t\u2002\u3000\xa0\x85\x1c\x1f中!" + "\r"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)] + ["", "a  <|endoftext|>  b", "I'll  don't 'S", " " * 9]
    encoder = Encoder(tokenizer_path)
    ids, offsets = encoder.encode(texts)
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts_and_are_encoded_once(tokenizer_path, monkeypatch):
    rng = random.Random(12)
    letters = "aabcéü×÷ÀßŁжا中한𝔸 \n \n'sdt1½.,|#<>-\t\u0301\u2002\u3000\xa0\x85\x1c\x7f!" + "\r"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["", " ", "  a", "a  <|endoftext|>  b", "x <|endoftext|>.", "I'll  don't 'S", " " * 9, "\n\nA", "a \n b", "foo ", "foo.\n\nBar, baz"]
    encoder = Encoder(tokenizer_path)
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for known in (1 << 25, 0):
        monkeypatch.setattr(token_files, "KNOWN", known)
        for low in range(0, len(texts), 700):
            got = encoder.encode_rows(pa.array(texts[low : low + 700]))
            assert [np.frombuffer(b, encoder.width).tolist() for b in got.to_pylist()] == want[low : low + 700]
    assert encoder.cuttable
    monkeypatch.setattr(token_files, "KNOWN", 1 << 25)
    sizes, plain = [], encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda texts: sizes.append(sum(map(len, texts))) or plain(texts))
    encoder.forget()
    encoder.encode_rows(pa.array(["some words, some more words.\nSome words"] * 500))
    assert sum(sizes) < 100
    sizes.clear()
    encoder.encode_rows(pa.array(["more words, some words"] * 500))
    assert sum(sizes) < 10


def test_other_tokenizers_encode_whole_texts(tokenizer_path, tmp_path):
    from tokenizers import Tokenizer, normalizers

    changed = Tokenizer.from_file(tokenizer_path)
    changed.normalizer = normalizers.Replace(" b", "b")
    changed.save(f"{tmp_path}/changed.json")
    encoder = Encoder(f"{tmp_path}/changed.json")
    (row,) = encoder.encode_rows(pa.array(["a b c"])).to_pylist()
    assert np.frombuffer(row, encoder.width).tolist() == changed.encode("a b c", add_special_tokens=False).ids


def test_ranks_survive_coding():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 3, 4, 5, 100]
    ranks = np.concatenate([rng.integers(0, 1 << rng.integers(1, 33), n) for n in sizes]).astype(np.uint32)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    for i, (control, data) in enumerate(zip(*code(ranks, offsets))):
        assert decode(control, data, sizes[i]).tolist() == ranks[offsets[i] : offsets[i + 1]].tolist()
        assert len(control) == -(-sizes[i] // 4)


def test_token_files_hold_every_text_in_order(spark, tokenizer_path, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(prose(rng, rng.randrange(50)))) for i in rng.sample(range(10**6), 300)] + [(5, None), (5, ""), (None, "no id"), (-3, "x " * 40_000)]
    docs = spark.createDataFrame([(*r, "row") for r in rows], "doc_id long, text string, place string").repartition(6)
    write_token_files(docs, tokenizer_path, f"{tmp_path}/t")
    got = read_token_files(spark, f"{tmp_path}/t").orderBy("start").collect()
    tokenizer, at, want = Encoder(tokenizer_path).tokenizer, 0, Counter()
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i or 0))
    for r in got:
        assert r.start == at
        at += r.n_tokens
    write_token_files(docs.where("false"), tokenizer_path, f"{tmp_path}/none")
    assert read_token_files(spark, f"{tmp_path}/none").count() == 0


def test_notices_are_found_where_they_stand(spark):
    rng = random.Random(7)
    rows, want = [], set()
    for i in range(150):
        words = prose(rng, rng.randrange(5, 200), 10**6)
        if i % 3:
            number = rng.randrange(len(TEMPLATES))
            notice = TEMPLATES[number][1].split()
            if i % 3 == 2 and len(notice) > 30:
                notice[rng.randrange(len(notice))] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = notice
            want.add((i, TEMPLATES[number][0]))
        rows.append((i, " ".join(words)))
    found = license_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert want <= {(r.doc_id, r.license) for r in found}
    sets = []
    for _, text in TEMPLATES:
        w = split(text, False)
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)})
    texts = dict(rows)
    seen = {(r.doc_id, r.template) for r in found}
    for i, text in rows:
        w = split(text, False)
        grams = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        for t, s in enumerate(sets):
            if len(grams & s) < 0.75 * len(s):
                assert (i, t) not in seen
    for r in found:
        w = split(texts[r.doc_id], False)[r.first_word : r.last_word]
        inside = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        assert math.isclose(len(inside & sets[r.template]) / len(sets[r.template]), r.containment)


def test_boundaries_pad_least():
    rng = np.random.default_rng(5)
    for _ in range(50):
        lengths = np.unique(rng.integers(1, 60, rng.integers(1, 9)))
        counts = rng.integers(1, 20, len(lengths))
        for k in (1, 2, 3, 20):
            ends, padding = packing.bucket_boundaries(lengths, counts, k)

            def cost(chosen):
                return sum(int(c) * int(min(e for e in chosen if e >= n) - n) for n, c in zip(lengths, counts))

            tops = [t for size in range(min(k, len(lengths))) for t in itertools.combinations(lengths[:-1].tolist(), size)]
            assert cost(ends) == padding == min(cost([*t, lengths[-1]]) for t in tops)
            assert len(ends) <= k and ends == sorted(ends)


def test_batches_are_full_and_hold_every_token(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 50)
    rng = random.Random(8)
    rows = [(i, rng.choice([0, 3, 3, 3, 17, 90, 250])) for i in range(700)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, n_tokens long").repartition(4), buckets=3, max_length=100, budget=400).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, n in rows:
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at and length <= 100
            at += length
        assert at == n + 1
    places = Counter((r.bucket, r.batch, r.slot) for r in got)
    assert max(places.values()) == 1
    for bucket in {r.bucket for r in got}:
        capacity, batches = 400 // bucket, Counter(r.batch for r in got if r.bucket == bucket)
        assert sorted(batches) == list(range(len(batches)))
        assert all(n == capacity for b, n in batches.items() if b < len(batches) - 1)


def brute_vectors(rows, cosine):
    links = {i: set() for i, _, _ in rows}
    for (a, x, p), (b, y, q) in itertools.combinations(rows, 2):
        if p == q and np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)) >= cosine:
            links[a].add(b)
            links[b].add(a)
    root = {}
    for i in sorted(links):
        stack = [i] if i not in root else []
        while stack:
            j = stack.pop()
            if j not in root:
                root[j] = i
                stack += links[j]
    return {(i, len(links[i]), root[i], root[i] == i) for i in links}


@pytest.mark.parametrize("cell_rows", [6, 10**6])
def test_vector_links_are_those_of_all_pairs(spark, monkeypatch, cell_rows):
    for name, value in (("CELL_ROWS", cell_rows), ("BLOCK_ROWS", 40), ("CHUNK_ROWS", 16)):
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(9)
    vectors = [rng.normal(size=8) for _ in range(150)]
    for spread in (0.02, 0.1, 0.14, 0.2):
        centre = rng.normal(size=8)
        vectors += [centre / np.linalg.norm(centre) * rng.uniform(0.1, 9) + 0 * centre if k == 0 else centre / np.linalg.norm(centre) + rng.normal(size=8) * spread for k in range(60)]
    vectors += vectors[:20] + [v * 4 for v in vectors[:20]]
    rows = [(i, v.astype(np.float32).astype(np.float64), int(i % 3 == 0)) for i, v in enumerate(vectors)]
    table = spark.createDataFrame([(i, v.tolist(), p) for i, v, p in rows], "vec_id long, embedding array<float>, label int").repartition(5)
    assert {tuple(r) for r in embeddings.near_vectors(table).collect()} == brute_vectors(rows, 0.93)


def test_hypergeometric_draws_follow_the_law():
    rng = random.Random(1)
    for good, bad, draws in ((5, 7, 6), (40, 3, 20), (2, 100, 50), (0, 5, 3), (6, 0, 4)):
        drawn = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(20_000))
        for k in range(draws + 1):
            want = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws) if k <= good and draws - k <= bad else 0
            assert abs(drawn[k] / 20_000 - want) < 0.015


def test_matrix_has_exact_margins():
    rng = random.Random(2)
    for _ in range(30):
        parts = [rng.randrange(50) for _ in range(rng.randrange(1, 9))]
        total, shards = sum(parts), rng.randrange(1, 7)
        targets = [total // shards + (s < total % shards) for s in range(shards)]
        matrix = sharding.communication_matrix(parts, targets, rng.randrange(100))
        assert [sum(r) for r in matrix] == parts and [sum(c) for c in zip(*matrix)] == targets


def test_shuffle_is_uniform_and_repeatable(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 100)
    rows = spark.range(4000, numPartitions=6)
    first = sharding.shuffled_shards(rows, 8, seed=3).collect()
    assert {tuple(r) for r in first} == {tuple(r) for r in sharding.shuffled_shards(rows, 8, seed=3).collect()}
    assert {tuple(r) for r in first} != {tuple(r) for r in sharding.shuffled_shards(rows, 8, seed=4).collect()}
    place = {r.id: r.shard * 500 + r.slot for r in first}
    assert sorted(place.values()) == list(range(4000))
    # No trace of the old order: neighbours are as far apart as chance has it, and each old part reaches each shard.
    gaps = [abs(place[i] - place[i + 1]) for i in range(3999)]
    assert abs(np.mean(gaps) - 4000 / 3) < 60
    spread = Counter((i // 667, p // 500) for i, p in place.items())
    assert max(abs(n - 667 / 8) for (part, _), n in spread.items() if part < 5) < 45


def test_notices_of_few_words_are_found(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id for r in license_notices(documents).where("license = 'All rights reserved'").collect()}
    assert got == {r.doc_id for r in documents.collect() if re.search("(^| )all rights reserved( |$)", " ".join(split(r.text, False)))}
    assert {29, 163, 584, 684, 831, 888, 975} <= got
    rows = [(1, "All rights reserved"), (2, "a b ALL rights, reserved! c All rights reserved."), (3, "all rights"), (4, "reserved all rights"), (5, None)]
    found = license_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.first_word, r.last_word, r.containment) for r in found) == [(1, 0, 3, 1.0), (2, 2, 5, 1.0), (2, 6, 9, 1.0)]
