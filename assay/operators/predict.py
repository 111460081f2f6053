"""Batch prediction, label scores and drawing labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions import fixed_values as V
from assay.functions.arrays import doubles, draw, softmax
from assay.functions.text import md5_uniform
from assay.operators.ordinals import assign_ordinal
from assay.operators.vectors import (
    BLOCK_BYTES,
    as_matrix,
    book_bytes,
    codebook_blocks,
    mean_vectors,
    with_nearest,
)
from assay.session import written


class Predictor(Protocol):
    """Anything that adds ``pred`` and ``error`` (null when fine) to a table of examples."""

    def apply(self, df: DataFrame) -> DataFrame: ...


def predict(df: DataFrame, predictor: Predictor) -> DataFrame:
    """Predictions with failures turned into the error text; ``error`` keeps the reason."""
    out = predictor.apply(df)
    return out.withColumn("pred", F.when(F.col("error").isNull(), F.col("pred")).otherwise(F.lit(V.ERROR_TEXT)))


def _in_calls(inputs: list, call: Callable[[list], list], size: int) -> Iterator[tuple[object, str | None]]:
    """Output and error of every input. A call that fails is repeated input by input, so a bad one costs only itself."""
    for low in range(0, len(inputs), size):
        part = inputs[low : low + size]
        try:
            outputs = list(call(part))
            if len(outputs) != len(part):
                raise ValueError(f"{len(outputs)} outputs for {len(part)} inputs")
            yield from ((o, None) for o in outputs)
        except Exception as problem:  # noqa: BLE001 - the contract is to keep going
            if len(part) == 1:
                yield None, f"{type(problem).__name__}: {problem}"
            else:
                yield from _in_calls(part, call, 1)


@dataclass
class BatchPredictor:
    """An external model behind ``load() -> model`` and ``model(list of row dicts) -> list of texts``.

    The model is loaded once per task and called with ``size`` rows at a time, which hold ``columns`` only; no other
    column leaves the JVM. A row that fails keeps its id and gets an error instead of failing the job.
    """

    load: Callable[[], Callable[[list[dict]], list[str]]]
    columns: Sequence[str]
    size: int = 16

    def apply(self, df: DataFrame) -> DataFrame:
        load, size = self.load, self.size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                found = list(_in_calls(batch.to_dict("records"), model, size))
                preds = [None if error else str(out) for out, error in found]
                yield pd.DataFrame({"pred": pd.Series(preds, dtype=object), "error": pd.Series([e for _, e in found], dtype=object)})

        called = F.pandas_udf(_annotated(run), "pred string, error string").asNondeterministic()(F.struct(*self.columns))
        return df.withColumn("_called", called).select(*df.columns, "_called.pred", "_called.error")


@dataclass
class BatchScorer:
    """An external answer scorer behind ``load() -> scorer`` and
    ``scorer(list of (reference, prediction, question)) -> list of numbers``.

    Each row gets the best score over its references; one without references or with a failing scorer gets null. Only
    the three columns leave the JVM.
    """

    load: Callable[[], Callable[[list[tuple[str, str, str]]], list[float]]]
    references: str = "answers"
    prediction: str = "pred"
    question: str = "question"
    size: int = 64

    def apply(self, df: DataFrame, out: str = "score") -> DataFrame:
        load, size = self.load, self.size
        refs, pred, question = self.references, self.prediction, self.question

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            scorer = load()
            for batch in batches:
                rows = [[] if r is None else list(r) for r in batch[refs]]
                triples = [(ref, p, q) for r, p, q in zip(rows, batch[pred], batch[question]) for ref in r]
                found = iter(list(_in_calls(triples, scorer, size)))
                scores = []
                for r in rows:
                    mine = [next(found) for _ in r]
                    fine = mine and all(error is None for _, error in mine)
                    scores.append(float(max(score for score, _ in mine)) if fine else None)
                yield pd.Series(scores, dtype="Float64")

        called = F.pandas_udf(_annotated(run, series=True), "double").asNondeterministic()(F.struct(refs, pred, question))
        return df.withColumn(out, called)


def _annotated(run, series: bool = False):
    """Type hints by which Spark knows an iterator function over frames; a nested function's own are not resolved.

    The functions made of it are declared non-deterministic, or Spark would call the model once for each field that is
    read of its result.
    """
    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.Series if series else pd.DataFrame]}
    return run


@dataclass
class ColumnPredictor:
    """A rule model given as one Column expression; a null result is a failure."""

    rule: Column

    def apply(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("pred", self.rule.cast("string"))
        return out.withColumn("error", F.when(F.col("pred").isNull(), F.lit("no prediction")))


@dataclass
class CentroidPredictor:
    """Nearest class centroid of a vector column.

    ``centroids`` has ``code``, ``label``, ``vector``; its size grows with the label set, not with the data, and
    it reaches the tasks in blocks of checked size.
    """

    centroids: DataFrame
    vector: str = "embedding"

    @staticmethod
    def fit(train: DataFrame, label: str, vector: str = "embedding") -> CentroidPredictor:
        """Mean vector of every label; codes number the labels in order."""
        rows = train.where(F.col(vector).isNotNull() & F.col(label).isNotNull())
        means = mean_vectors(rows, label, doubles(vector)).withColumnRenamed(label, "label")
        numbered = assign_ordinal(means.select("label", "vector"), ["label"], name="code")
        return CentroidPredictor(numbered.select(F.col("code").cast("int").alias("code"), "label", "vector"), vector)

    def apply(self, df: DataFrame) -> DataFrame:
        best = with_nearest(df, self.centroids, self.vector)
        names = self.centroids.select(F.col("code").alias("_code"), F.col("label").cast("string").alias("pred"))
        out = best.withColumn("_code", F.col("_best.code")).join(names, "_code", "left").drop("_code", "_best")
        return out.withColumn("error", F.when(F.col("pred").isNull(), F.lit("no vector")))

    def scores(self, df: DataFrame, out: str = "scores") -> DataFrame:
        """Add ``array<struct<label, score>>``: the dot product with every centroid, in label order.

        All labels of an example are one row here, so the centroids must fit in one block; ``score_blocks`` has no limit.
        """
        if book_bytes(self.centroids, "vector") > BLOCK_BYTES:
            raise ValueError("too many labels for one row of scores, use score_blocks")
        (_, book), *_ = codebook_blocks(self.centroids, "code", "vector", BLOCK_BYTES)
        labels = [r["label"] for r in self.centroids.orderBy("code").select("label").collect()]
        names = F.array(*[F.lit(label) for label in labels])
        pairs = F.zip_with(names, F.col(out), lambda n, s: F.struct(n.alias("label"), s.alias("score")))
        return df.withColumn(out, _dots(book)(self.vector)).withColumn(out, pairs)

    def score_blocks(self, df: DataFrame, key: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
        """Dot products with every centroid as rows ``key``, ``block``, ``first`` (the code of its first score), ``scores``.

        One block of centroids is collected, multiplied with all vectors, written and forgotten before the next, so neither
        driver nor a row ever holds all labels. Unusable vectors have no rows.
        """
        out = None
        for i, (codes, book) in enumerate(codebook_blocks(self.centroids, "code", "vector", block_bytes)):
            here = df.select(key, F.lit(i).alias("block"), F.lit(int(codes[0])).alias("first"), _dots(book)(self.vector).alias("scores"))
            here = written(here.where(F.col("scores").isNotNull()), "scores")
            out = here if out is None else out.union(here)
        if out is None:
            raise ValueError("no centroids")
        return out


def _dots(book: np.ndarray):
    """Arrow function: dot products of a vector with every row of a matrix."""

    def multiply(vectors: pa.Array) -> pa.Array:
        z, valid = as_matrix(vectors)
        products = (z @ book.T).ravel() if z.shape[0] else np.zeros(0)
        ends = np.concatenate([[0], np.cumsum(valid * len(book))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(products), mask=pa.array(~valid))

    return F.arrow_udf(multiply, T.ArrayType(T.DoubleType()))


def argmax_label(scores: Column, allowed: Sequence | None = None) -> Column:
    """Label of the highest score, among ``allowed`` labels only if given; the first label wins ties."""
    kept = scores if allowed is None else F.filter(scores, lambda e: e["label"].isin(list(allowed)))
    ranked = F.transform(kept, lambda e, i: F.struct(e["score"].alias("s"), (-i).alias("o"), e["label"].alias("l")))
    return F.array_max(ranked)["l"]


def argmax_rows(df: DataFrame, key: str, allowed: DataFrame | None = None, label: str = "label", score: str = "score", ordinal: str = "ord") -> DataFrame:
    """Long form of :func:`argmax_label`: one row per example; the lowest ordinal wins ties."""
    kept = df if allowed is None else df.join(allowed, label, "left_semi")
    best = F.max_by(label, F.struct(F.col(score), -F.col(ordinal)))
    return kept.groupBy(key).agg(best.alias("pred"))


def softmax_scores(scores: Column, temperature: float) -> Column:
    """``array<struct<label, score>>`` -> ``array<struct<label, prob>>``."""
    probs = softmax(F.transform(scores, lambda e: e["score"]), temperature)
    return F.zip_with(scores, probs, lambda e, p: F.struct(e["label"].alias("label"), p.alias("prob")))


def sample_label(probs: Column, key: Column | str, seed: int = V.SPLIT_SEED) -> Column:
    """Draw one label by its probability; the same row and seed always draw the same label."""
    index = draw(F.transform(probs, lambda e: e["prob"]), md5_uniform(key, seed))
    return F.get(probs, index)["label"]


def best_of_blocks(blocks: DataFrame, key: str) -> DataFrame:
    """``key`` and the ``code`` of the highest score over all blocks; the lowest code wins ties."""
    top = F.array_max("scores")
    here = F.struct(top.alias("s"), (-F.col("first") - F.array_position("scores", top) + 1).alias("c"))
    return blocks.groupBy(key).agg((-F.max(here)["c"]).cast("int").alias("code"))


def _masses(blocks: DataFrame, key: str, temperature: float) -> DataFrame:
    """Per example: ``top``, the highest score, and ``masses`` (block, mass), the sums of ``exp((s - top) / t)``, in order.

    Each block gives its own highest score and the sum relative to it; these few numbers are brought to one scale.
    """
    top = F.array_max("scores")
    mass = F.aggregate("scores", F.lit(0.0), lambda total, v: total + F.exp((v - top) / F.lit(float(temperature))))
    sums = blocks.groupBy(key).agg(F.max(top).alias("top"), F.sort_array(F.collect_list(F.struct("block", top.alias("top"), mass.alias("mass")))).alias("parts"))
    scaled = F.transform("parts", lambda p: F.struct(p["block"].alias("block"), (p["mass"] * F.exp((p["top"] - F.col("top")) / F.lit(float(temperature)))).alias("mass")))
    return sums.select(key, "top", scaled.alias("masses"))


def softmax_blocks(blocks: DataFrame, key: str, temperature: float) -> DataFrame:
    """The blocks with ``probs`` instead of ``scores``: the softmax over all labels of the example."""
    masses = _masses(blocks, key, temperature)
    total = F.aggregate("masses", F.lit(0.0), lambda s, m: s + m["mass"])
    both = blocks.join(masses.select(key, "top", total.alias("total")), key)
    probs = F.transform("scores", lambda v: F.exp((v - F.col("top")) / F.lit(float(temperature))) / F.col("total"))
    return both.select(key, "block", "first", probs.alias("probs"))


def draw_from_blocks(blocks: DataFrame, key: str, temperature: float, seed: int = V.SPLIT_SEED) -> DataFrame:
    """``key`` and the ``code`` drawn by the softmax of all its labels, the same for the same key and seed.

    The running sum first passes over whole blocks, to the one in which it reaches the drawn number, and then over the
    labels of that block.
    """
    masses = _masses(blocks, key, temperature)
    total = F.aggregate("masses", F.lit(0.0), lambda s, m: s + m["mass"])
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(0.0).alias("before"), F.lit(0).alias("at"))

    def step(s: Column, m: Column) -> Column:
        mass = s["mass"] + m["mass"]
        passed = mass < F.col("wanted")
        return F.struct(mass.alias("mass"), F.when(passed, mass).otherwise(s["before"]).alias("before"), (s["at"] + passed.cast("int")).alias("at"))

    reached = masses.withColumn("wanted", md5_uniform(key, seed) * total).withColumn("reached", F.aggregate("masses", start, step))
    at = F.least(F.col("reached.at"), F.size("masses") - 1)
    reached = reached.select(key, "top", "wanted", F.col("reached.before").alias("before"), F.get("masses", at)["block"].alias("block"))
    chosen = blocks.join(reached, [key, "block"])
    weights = F.transform("scores", lambda v: F.exp((v - F.col("top")) / F.lit(float(temperature))))
    return chosen.select(key, (F.col("first") + draw(weights, F.col("wanted") - F.col("before"))).cast("int").alias("code"))
