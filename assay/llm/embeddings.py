"""Exact cosine range join of embeddings as a metric range join.

On unit vectors, cosine at least c is distance at most eps = sqrt(2 - 2c). Pivots cut the vectors of a label into cells;
a vector belongs to the cell of its nearest pivot and is replicated to every cell whose ball or boundary the triangle
inequality leaves within eps. Cells join independently, in blocks of bounded size: pairs near enough to the pivot are
linked without being compared, pairs too far apart in pivot distance never are. Links are counted where they are found;
only a spanning forest of each block leaves it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.graph import components
from assay.llm.registry import query, table
from assay.llm.storage import partitions, runs, written

COSINE = 0.93
CELL_ROWS = 2000  # a pivot for so many vectors
PIVOT_BYTES = 16 << 20  # of all pivots together; beyond it cells grow instead
BLOCK_ROWS = 2048
CHUNK_ROWS = 256
SLACK = 1e-7  # distances within it of a bound are compared


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _digests(batches):
    names = ["vec_id", "label", "dim", "vector", "digest"]
    for batch in batches:
        dims, vectors, digests = [], [], []
        for label, value in zip(batch["label"].to_pylist(), batch["embedding"].to_pylist()):
            x = None if value is None or label is None or not value or None in value else np.array(value, np.float64)
            if x is None or not np.isfinite(x).all() or not x.any():
                dims.append(None)
                vectors.append(None)
                digests.append(None)
                continue
            # Scaled by a power of two, which is exact, so that squares neither overflow nor vanish.
            x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) + 0.0
            dims.append(len(x))
            vectors.append(x.tobytes())
            digests.append(hashlib.md5(x.tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(dims, pa.int32()), pa.array(vectors, pa.binary()), pa.array(digests, pa.string())], names=names)


def _place(pivots, eps: float, radii=None):
    """Without radii: the home cell of each vector and its distance; with them: all cells it must be compared in."""

    def run(batches):
        by_label = pivots.value
        names = ["class", "label", "dim", "vector", "copies", "cell", "home", "distance"]
        for batch in batches:
            rows, cells, homes, distances = [], [], [], []
            label, dim = batch["label"].to_pylist(), batch["dim"].to_numpy()
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(label, dim.tolist())):
                groups.setdefault(key, []).append(i)
            vectors = batch["vector"]
            for key, at in groups.items():
                at = np.array(at)
                centres = by_label.get(key)
                if centres is None:
                    rows.append(at)
                    cells.append(np.full(len(at), -1))
                    homes.append(np.ones(len(at), bool))
                    distances.append(np.zeros(len(at)))
                    continue
                x = unit(np.frombuffer(b"".join(vectors.take(pa.array(at)).to_pylist()), np.float64).reshape(len(at), -1))
                squares = np.maximum(2 - 2 * (x @ centres.T), 0)
                home = squares.argmin(1)
                d = np.sqrt(squares)
                if radii is None:
                    keep = np.zeros(d.shape, bool)
                else:
                    apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))[home]
                    nearest = np.take_along_axis(squares, home[:, None], 1)
                    # Distance to the hyperplane between the two pivots.
                    keep = (squares - nearest <= 2 * (eps + SLACK) * apart) | (apart < SLACK)
                    reach = np.array([radii.value.get((*key, c), -1.0) for c in range(len(centres))])
                    keep &= (d <= reach + eps + SLACK) & (reach >= 0)
                keep[np.arange(len(at)), home] = True
                i, c = np.nonzero(keep)
                rows.append(at[i])
                cells.append(c)
                homes.append(c == home[i])
                distances.append(d[i, c])
            if not rows:
                continue
            rows = pa.array(np.concatenate(rows))
            part = [batch[k].take(rows) for k in ("class", "label", "dim", "vector", "copies")]
            yield pa.RecordBatch.from_arrays([*part, pa.array(np.concatenate(cells).astype(np.int32)), pa.array(np.concatenate(homes)), pa.array(np.concatenate(distances))], names=names)

    return run


class Forest:
    """Union-find over a block; keeps the links that join two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[y] = x
            self.links.append((a, b))


def _join(eps: float, cosine: float):
    def run(batches):
        for block in runs(batches, ["label", "dim", "cell", "i", "j"]):
            left = block.filter(block["side"]).sort_by("distance")
            right = block.filter(pa.compute.invert(block["side"])).sort_by("distance")
            if not left.num_rows or not right.num_rows:
                continue
            arrays = []
            for side in (left, right):
                x = unit(np.frombuffer(b"".join(side["vector"].to_pylist()), np.float64).reshape(side.num_rows, -1))
                arrays += [x, side["class"].to_numpy(), side["copies"].to_numpy(), side["distance"].to_numpy()]
            x, ids, _, d = arrays[:4]
            y, others, copies, e = arrays[4:]
            upto = np.concatenate([[0], np.cumsum(copies)])
            pivot = block["cell"][0].as_py() >= 0
            counts, forest = np.zeros(len(ids), np.int64), Forest()
            for low in range(0, len(ids), CHUNK_ROWS):
                high = min(low + CHUNK_ROWS, len(ids))
                sure, far, near = 0, len(e), 0
                if pivot:
                    sure = int(np.searchsorted(e, eps - d[high - 1] - SLACK, "right"))
                    near = max(sure, int(np.searchsorted(e, d[low] - eps - SLACK)))
                    far = max(near, int(np.searchsorted(e, d[high - 1] + eps + SLACK, "right")))
                counts[low:high] += upto[sure]
                if sure:
                    for a in ids[low:high]:
                        forest.link(int(a), int(others[0]))
                    if low == 0:
                        for b in others[1:sure]:
                            forest.link(int(others[0]), int(b))
                for at in range(near, far, BLOCK_ROWS):
                    upper = min(at + BLOCK_ROWS, far)
                    hit = x[low:high] @ y[at:upper].T >= cosine
                    counts[low:high] += hit @ copies[at:upper]
                    # Each row to its first hit and each column to its first hit, then whatever still joins two trees.
                    some = np.flatnonzero(hit.any(1))
                    first = hit[some].argmax(1)
                    for r, c in zip(some, first):
                        forest.link(int(ids[low + r]), int(others[at + c]))
                    root_of = {}
                    columns = np.flatnonzero(hit.any(0))
                    for c in columns:
                        root_of[c] = forest.root(int(others[at + c]))
                    for r in some:
                        mine = forest.root(int(ids[low + r]))
                        for c in np.flatnonzero(hit[r]):
                            if root_of[c] != mine and forest.root(int(others[at + c])) != mine:
                                forest.link(int(ids[low + r]), int(others[at + c]))
                                mine = forest.root(int(ids[low + r]))
                            root_of[c] = mine
            a = np.concatenate([ids, np.array([l[0] for l in forest.links], np.int64)])
            b = pa.array([None] * len(ids) + [l[1] for l in forest.links], pa.int64())
            n = np.concatenate([counts, np.zeros(len(forest.links), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(n)], names=["a", "b", "n"])

    return run


def near_vectors(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``embeddings`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows of one label and one length are compared. A vector that is null, empty, zero or holds null or non-finite
    numbers, or has no label, links with nothing and is its own component. Equal vectors are one class, compared once;
    each of them links with the others of its class. A row without vec_id counts as a link of others; its component is
    the smallest vec_id that it reaches, null if there is none.
    """
    spark = embeddings.sparkSession
    eps = float(np.sqrt(2 - 2 * cosine))
    source = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = written(source.mapInArrow(_digests, "vec_id long, label string, dim int, vector binary, digest string"), "vectors")
    classes = rows.where("digest IS NOT NULL").groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    total, dim = classes.agg(F.count("*"), F.max("dim")).first()
    # A class is a pivot by its hash, at a rate that holds all pivots within PIVOT_BYTES.
    rate = min(1 / CELL_ROWS, PIVOT_BYTES / (8 * dim) / total) if total else 0.0
    chosen = classes.where(F.pmod(F.xxhash64("digest"), F.lit(1 << 40)) < int(rate * (1 << 40))).select("label", "dim", "vector").collect()
    centres: dict[tuple, list] = {}
    for label, size, vector in sorted(map(tuple, chosen)):
        centres.setdefault((label, size), []).append(np.frombuffer(vector, np.float64))
    pivots = spark.sparkContext.broadcast({k: unit(np.array(v)) for k, v in centres.items()})
    schema = "class long, label string, dim int, vector binary, copies long, cell int, home boolean, distance double"
    slim = classes.select("class", "label", "dim", "vector", "copies")
    homes = slim.mapInArrow(_place(pivots, eps), schema).where("cell >= 0").groupBy("label", "dim", "cell").agg(F.max("distance").alias("r"))
    radii = spark.sparkContext.broadcast({(r[0], r[1], r[2]): r[3] for r in homes.collect()})
    placed = written(slim.mapInArrow(_place(pivots, eps, radii), schema), "cells")
    cell = ["label", "dim", "cell"]
    sizes = placed.groupBy(*cell).agg(F.ceil(F.sum(F.col("home").cast("int")) / BLOCK_ROWS).cast("int").alias("lefts"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("rights"))
    sized = placed.join(written(sizes, "cell-sizes"), cell)
    block = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [*cell, "i", "j", "side", "class", "vector", "copies", "distance"]
    lefts = sized.where("home").withColumn("i", block("lefts")).withColumn("j", every("rights")).withColumn("side", F.lit(True))
    rights = sized.withColumn("j", block("rights")).withColumn("i", every("lefts")).withColumn("side", F.lit(False))
    dealt = lefts.select(columns).union(rights.select(columns)).repartition(partitions(spark), *cell, "i", "j").sortWithinPartitions(*cell, "i", "j")
    found = written(dealt.mapInArrow(_join(eps, cosine), "a long, b long, n long"), "links-found")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    joined = components(found.where("b IS NOT NULL").select("a", "b"))
    graph = classes.join(joined, classes["class"] == joined["node"], "left").select("label", "dim", "digest", "class", "least", F.coalesce("component", "class").alias("component"))
    roots = graph.groupBy("component").agg(F.min("least").alias("component_id"))
    # A vector is among the vectors it was compared with, so one of the counted links is its own.
    answers = written(graph.join(roots, "component").join(counts, "class", "left").select("label", "dim", "digest", (F.coalesce("n", F.lit(1)) - 1).alias("n_links"), "component_id"), "vector-answers")
    out = rows.select("vec_id", "label", "dim", "digest").join(answers, ["label", "dim", "digest"], "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


@query(
    "op9_metric_join",
    """
    WITH RECURSIVE vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    usable AS (SELECT * FROM vectors WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
        AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v)
        AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
    reach AS (SELECT vec_id AS node, vec_id AS root FROM vectors UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.node),
    counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
    SELECT node AS vec_id, coalesce(n, 0) AS n_links, min(root) AS component_id, node = min(root) AS kept
    FROM reach LEFT JOIN counts ON x = node GROUP BY node, n
    """,
)
def op9_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
