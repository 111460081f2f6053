"""Codebooks, k-means and pooled features over vector columns.

Distances are matrix products on Arrow batches inside the tasks; Spark partitions the vectors, partially
aggregates the per-code sums and shuffles only one row per code and task. A codebook is sent to the tasks in
blocks of checked size, one after the other: driver and tasks never hold more than one of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions import fixed_values as V
from assay.functions.arrays import doubles, l2_normalize, standardize
from assay.functions.text import as_col
from assay.operators.ordinals import assign_ordinal
from assay.operators.prepare import sample_n
from assay.session import written

BLOCK_BYTES = 64 * 1024 * 1024
# Bytes of one matrix of distances; rows of a batch are cut to fit.
DISTANCE_BYTES = 16 * 1024 * 1024
BEST = T.StructType([T.StructField("dist", T.DoubleType()), T.StructField("code", T.IntegerType())])


def as_matrix(vectors: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Usable rows of an Arrow list column as a 2-d array, and which rows those are.

    A row that is null or holds a null or NaN is left out. Rows of different lengths, or not of ``width`` entries,
    raise an error.
    """
    valid = vectors.is_valid().to_numpy(zero_copy_only=False)
    present = vectors.drop_null()
    flat = present.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(present):
        return np.zeros((0, width or 0)), valid
    lengths = np.unique(present.value_lengths().to_numpy())
    if len(lengths) > 1 or width is not None and lengths[0] != width:
        raise ValueError(f"vectors of {', '.join(map(str, lengths))} entries" + (f" against {width}" if width is not None else ""))
    matrix = flat.reshape(len(present), -1)
    whole = ~np.isnan(matrix).any(axis=1)
    valid = valid.copy()
    valid[valid] = whole
    return matrix[whole], valid


def codebook_blocks(codebook: DataFrame, code: str, vector: str, block_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and vectors of a codebook in code order, at most ``block_bytes`` of vectors at a time."""
    shape = codebook.agg(
        F.count(F.lit(1)).alias("n"), F.min(code).alias("lo"), F.max(code).alias("hi"), F.max(F.size(vector)).alias("d")
    ).first()
    if not shape["n"]:
        return
    if shape["hi"] - shape["lo"] + 1 != shape["n"]:
        raise ValueError("codes must be distinct and without gaps")
    step = max(1, block_bytes // (8 * max(1, shape["d"])))
    for lo in range(shape["lo"], shape["hi"] + 1, step):
        rows = codebook.where(F.col(code).between(lo, lo + step - 1)).select(code, doubles(vector)).orderBy(code).collect()
        yield np.array([r[0] for r in rows], dtype=np.int32), np.array([r[1] for r in rows], dtype=np.float64)


def unit_rows(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-12)


def distances(z: np.ndarray, book: np.ndarray, cosine: bool) -> np.ndarray:
    """Squared distance (or negative dot product) of every row of ``z`` to every row of ``book``."""
    products = z @ book.T
    if cosine:
        return -products
    return (z * z).sum(axis=1)[:, None] + (book * book).sum(axis=1)[None, :] - 2.0 * products


def closest(z: np.ndarray, book: np.ndarray, cosine: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row of ``book`` nearest to each row of ``z`` and its distance; the first wins ties."""
    best, dist = np.zeros(len(z), dtype=np.int64), np.zeros(len(z))
    step = max(1, DISTANCE_BYTES // (8 * len(book)))
    for low in range(0, len(z), step):
        d = distances(z[low : low + step], book, cosine)
        best[low : low + step] = d.argmin(axis=1)
        dist[low : low + step] = d[np.arange(len(d)), best[low : low + step]]
    return best, dist


def _closest(codes: np.ndarray, book: np.ndarray, cosine: bool, normalize: bool):
    """Arrow function: nearest code of one block; the lowest code wins ties."""

    def score(vectors: pa.Array) -> pa.Array:
        z, valid = as_matrix(vectors, book.shape[1])
        dist = np.full(len(valid), np.nan)
        code = np.zeros(len(valid), dtype=np.int32)
        if z.shape[0]:
            best, dist[valid] = closest(unit_rows(z) if normalize else z, book, cosine)
            code[valid] = codes[best]
        parts = [pa.array(dist, pa.float64()), pa.array(code, pa.int32())]
        return pa.StructArray.from_arrays(parts, names=["dist", "code"], mask=pa.array(~valid))

    return F.arrow_udf(score, BEST)


def _partial_means(normalize: bool):
    """Arrow batch function over (code, vector): mean and count of the vectors of each code in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, _ = as_matrix(batch.column(1))
            if not z.shape[0]:
                continue
            z = unit_rows(z) if normalize else z
            codes, which, counts = np.unique(batch.column(0).to_numpy(), return_inverse=True, return_counts=True)
            means = np.zeros((len(codes), z.shape[1]))
            np.add.at(means, which, z)
            means /= counts[:, None]
            ends = np.arange(0, means.size + 1, z.shape[1], dtype=np.int32)
            columns = [pa.array(codes), pa.ListArray.from_arrays(pa.array(ends), pa.array(means.ravel())), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["code", "mean", "n"])

    return run


def with_nearest(
    df: DataFrame,
    codebook: DataFrame,
    vector: str,
    code: str = "code",
    code_vector: str = "vector",
    normalize: bool = True,
    cosine: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add ``_best``, the smallest (distance, code) of each vector over all blocks of the codebook.

    A block is collected, compared and forgotten before the next: the best so far is written to the shared folder in
    between. ``vector`` is a stored column: Spark 4.1 may fail to plan a Python function whose input holds a lambda
    expression, which is also why normalising happens inside the function.
    """
    out = None
    for codes, book in codebook_blocks(codebook, code, code_vector, block_bytes):
        here = _closest(codes, book, cosine, normalize)(as_col(vector))
        if out is None:
            out = df.withColumn("_best", here)
        else:
            out = written(out, "nearest").withColumn("_here", here)
            out = out.withColumn("_best", F.least("_best", "_here")).drop("_here")
    if out is None:
        raise ValueError("empty codebook")
    return out


def assign_codes(
    df: DataFrame,
    codebook: DataFrame,
    vector: str = "embedding",
    code: str = "code",
    code_vector: str = "vector",
    normalize: bool = True,
    cosine: bool = False,
    with_codeword: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add the nearest code and its squared distance, one row out per row in.

    Vectors are L2-normalised first unless ``normalize`` is false. A vector that is null or holds a null or NaN gets a
    null code; one of another length than the codebook's is an error.
    """
    out = with_nearest(df, codebook, vector, code, code_vector, normalize, cosine, block_bytes)
    out = out.select(*df.columns, F.col("_best.code").alias("code"), F.col("_best.dist").alias("dist"))
    if with_codeword:
        book = codebook.select(F.col(code).alias("code"), F.col(code_vector).alias("codeword"))
        out = out.join(book, "code", "left").select(*df.columns, "code", "dist", "codeword")
    return out


def mean_vectors(df: DataFrame, by: str, vector: Column) -> DataFrame:
    """Element-wise mean per group, merged from per-task partial means: ``by``, ``vector``, ``n``."""
    mean = Summarizer.mean(array_to_vector(vector))
    return df.groupBy(by).agg(vector_to_array(mean).alias("vector"), F.count(F.lit(1)).alias("n"))


def code_means(
    df: DataFrame,
    codebook: DataFrame,
    vector: str,
    normalize: bool,
    cosine: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Mean and count of the (normalised) vectors nearest to each code: ``code``, ``vector``, ``n``; used codes only.

    Every Arrow batch of assigned vectors gives one mean per code that it uses, and Spark merges these.
    """
    rows = df.where(F.col(vector).isNotNull()).select(vector)
    assigned = with_nearest(rows, codebook, vector, normalize=normalize, cosine=cosine, block_bytes=block_bytes)
    assigned = assigned.where(F.col("_best").isNotNull()).select(F.col("_best.code").alias("code"), vector)
    partial = assigned.mapInArrow(_partial_means(normalize), "code int, mean array<double>, n bigint")
    mean = Summarizer.mean(array_to_vector("mean"), F.col("n").cast("double"))
    return partial.groupBy("code").agg(vector_to_array(mean).alias("vector"), F.sum("n").alias("n"))


def book_bytes(codebook: DataFrame, vector: str) -> int:
    shape = codebook.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("d")).first()
    return 8 * shape["n"] * (shape["d"] or 0)


def initial_means(df: DataFrame, key: str, vector: str, k: int, seed: int = V.SPLIT_SEED) -> DataFrame:
    """``k`` sampled vectors as codes 0..k-1."""
    rows = df.where(F.col(vector).isNotNull()).select(key, vector)
    picked = sample_n(rows, key, k, seed)
    return picked.select(F.col("draw").cast("int").alias("code"), doubles(vector).alias("vector"))


def kmeans(
    df: DataFrame,
    k: int,
    iters: int = V.KMEANS_ROUNDS,
    cosine: bool = False,
    seed: int = V.SPLIT_SEED,
    key: str = "vec_id",
    vector: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Lloyd's rounds from sampled means: ``code``, ``vector``, ``n`` of the last assignment.

    With ``cosine`` the nearest mean is the one with the largest dot product, and means are re-normalised. An
    empty cluster keeps its mean. Every round is one pass over the vectors that shuffles a row per code and batch.
    """
    # Read and projected once for all rounds; what memory can't hold goes to disk.
    points = df.where(F.col(vector).isNotNull()).select(key, vector).persist()
    means = written(initial_means(points, key, vector, k, seed).withColumn("n", F.lit(0).cast("bigint")), "means")
    for _ in range(iters):
        fresh = code_means(points, means, vector, False, cosine, block_bytes)
        moved = l2_normalize("f.vector") if cosine else F.col("f.vector")
        both = means.alias("m").join(fresh.alias("f"), "code", "left")
        # Written, whatever its size: a round reads the means of the round before and nothing older.
        means = written(both.select("code", F.coalesce(moved, "m.vector").alias("vector"), F.coalesce("f.n", F.lit(0).cast("bigint")).alias("n")), "means")
    points.unpersist()
    return means


def code_usage(assigned: DataFrame, n: int, code: str = "code") -> DataFrame:
    """Occurrences of every code 0..n-1, unused codes with 0."""
    counts = assigned.groupBy(code).agg(F.count(F.lit(1)).alias("uses"))
    codes = assigned.sparkSession.range(n).select(F.col("id").cast("int").alias(code))
    return codes.join(counts, code, "left").select(code, F.coalesce("uses", F.lit(0).cast("bigint")).alias("uses"))


def ema(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    value: str,
    decay: float = V.EMA_DECAY,
    ranges: int | None = None,
) -> DataFrame:
    """``m = m * decay + new * (1 - decay)`` per key in batch order from 0, as one weighted sum.

    A batch weighs ``decay`` to the number of batches after it, so batches are numbered from the last one back
    and partial sums merge: a key with most of the rows is not collected anywhere.
    """
    steps = assign_ordinal(
        df.select(key, *order, value), order, by=[key], name="_after", ranges=ranges, descending=True
    )
    weight = F.pow(F.lit(decay), F.col("_after").cast("double"))
    return steps.groupBy(key).agg(
        F.sum(F.col(value) * F.lit(1.0 - decay) * weight).alias("ema"), F.count(F.lit(1)).alias("n")
    )


def masked_mean_pool(df: DataFrame, ids: Sequence[str], value: str = "value", padded: str = "padded") -> DataFrame:
    """Sigmoid of the mean over unpadded frames; null where every frame is padded."""
    mean = F.avg(F.when(~F.col(padded), F.col(value)))
    return df.groupBy(*ids).agg((F.lit(1.0) / (F.lit(1.0) + F.exp(-mean))).alias("pooled"))


def fit_standardize(df: DataFrame, arr: str, ids: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation over all entries of an array column, per group."""
    flat = df.select(*ids, F.explode(doubles(arr)).alias("x"))
    return flat.groupBy(*ids).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def standardize_by_group(df: DataFrame, arr: str, ids: Sequence[str], out: str = "standardized") -> DataFrame:
    """Standardise every array by the fitted mean and deviation of its group."""
    return df.join(fit_standardize(df, arr, ids), list(ids)).withColumn(out, standardize(arr, F.col("mean"), F.col("std")))


def update_codebook(
    codebook: DataFrame, df: DataFrame, vector: str = "embedding", decay: float = V.EMA_DECAY, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One refresh: normalised mean of each code's vectors, averaged into the old vector, normalised again.

    A code without vectors takes part with its old vector. Returns ``code``, ``vector``, ``n``.
    """
    fresh = code_means(df, codebook, vector, True, block_bytes=block_bytes)
    both = codebook.select("code", doubles("vector").alias("old")).join(fresh, "code", "left")
    target = F.coalesce(l2_normalize("vector"), F.col("old"))
    mixed = F.zip_with("old", target, lambda o, t: o * F.lit(decay) + t * F.lit(1.0 - decay))
    return both.select(
        "code", l2_normalize(mixed).alias("vector"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )
