"""The Merkle manifest against a plain recursion, over one round of blocks and over several."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from assay.llm import merkle
from assay.llm.merkle import digest, folded, manifest, proof_text


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """The top of a list of nodes, and for each its siblings (left, right) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            low = i // 3 * 3
            paths[leaf].append(("".join(nodes[low:i]), "".join(nodes[i + 1 : low + 3])))
            at[leaf] = i // 3
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    """(doc_id, leaf, subroot, root, proof) of every row (doc_id, source, text)."""
    groups = {}
    for doc_id, source, text in rows:
        leaf = sha("".join(map(encoded, (doc_id, source, text))))
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf))
    names = sorted(groups, key=lambda s: b"" if s is None else b"=" + s.encode())
    tops = {s: climb([leaf for *_, leaf in sorted(groups[s])]) for s in names}
    root, above = climb([tops[s][0] for s in names])
    out = []
    for s, up in zip(names, above):
        for (known, doc_id, leaf), path in zip(sorted(groups[s]), tops[s][1]):
            out.append((doc_id if known else None, leaf, tops[s][0], root, sha("".join(a + b for a, b in path + up))))
    return out


def documents(seed, n, sources):
    rng = random.Random(seed)
    rows = [(i, rng.choice(sources), rng.choice([None, "", "ä\nö 　\U0001f600", f"text {i}\n"])) for i in range(n)]
    return rows + [(5, sources[0], "twice")] * 2 + [(None, sources[0], None), (None, None, "x" * 200_000)]


def run(spark, rows):
    table = spark.createDataFrame([(*r, "?", 1) for r in rows], "doc_id long, source string, text string, leaf string, _slot int")
    return manifest(table.repartition(4), ["doc_id"], "source", ["doc_id", "source", "text"])


@pytest.mark.parametrize("levels, n, sources", [(7, 120, ["a", "b", "é", "", "Z", None]), (1, 100, ["a"] * 9 + ["b", None]), (2, 200, ["a"] * 9 + ["b", "c"])])
def test_manifest_is_that_of_the_recursion(spark, monkeypatch, levels, n, sources):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    rows = documents(levels, n, sources)
    got = run(spark, rows).select("doc_id", "leaf", "subroot", "root", digest(proof_text(F.col("path"))).alias("proof"), folded(F.col("leaf"), F.col("path")).alias("again"))
    found = got.collect()
    assert all(r.again == r.root for r in found)
    assert sorted(map(str, (tuple(r)[:-1] for r in found))) == sorted(map(str, brute(rows)))


def test_few_and_no_rows(spark):
    for rows in ([(1, "a", "x")], [(1, None, None), (2, "a", "x")], [(i, "a", "x") for i in range(4)]):
        found = run(spark, rows).select("doc_id", "leaf", "subroot", "root", digest(proof_text(F.col("path"))).alias("proof")).collect()
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute(rows)))
    assert run(spark, [(1, "a", "x")]).where("false").count() == 0
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert manifest(none, ["doc_id"], "source", ["doc_id", "source", "text"]).count() == 0


def test_any_change_shows(spark):
    rows = [(i, "ab"[i % 2], f"text {i}") for i in range(40)]
    root = run(spark, rows).first().root
    for changed in (rows[:-1], rows + [(40, "a", "text 40")], [(0, "a", "text O"), *rows[1:]], [(0, "b", "text 0"), *rows[1:]]):
        assert run(spark, changed).first().root != root
