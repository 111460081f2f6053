"""Means, confusion counts and F1 per group. Everything is partially aggregated before its shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import fixed_values as V


def _ratio(top: Column, bottom: Column) -> Column:
    return top / F.nullif(bottom, F.lit(0))


def accuracy(df: DataFrame, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Mean of 0/1 scores; failed rows hold 0 and count."""
    return df.groupBy(*by).agg(F.avg(score).alias("accuracy"), F.count(score).alias("n"))


def mean_skip_na(df: DataFrame, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Mean over the rows that have a score; null where none has."""
    return df.groupBy(*by).agg(F.avg(score).alias("mean_score"), F.count(score).alias("n_scored"))


def mean_na_as_zero(df: DataFrame, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Sum of scores over all lines: a missing score adds nothing but counts."""
    total = F.sum(F.coalesce(F.col(score).cast("double"), F.lit(0.0)))
    out = df.groupBy(*by).agg((total / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("mean_score"), F.count(F.lit(1)).alias("n_lines"))
    return out if by else out.where(F.col("n_lines") > 0)


def score_table(df: DataFrame, dials: Sequence[str], row: str = "model", dial: str = "dial", score: str = "score") -> DataFrame:
    """Mean score, a row per model and a column per dial. The dial list is fixed, so no job looks for it."""
    return df.groupBy(row).pivot(dial, list(dials)).agg(F.avg(score))


def _known(df: DataFrame, pred: str, strict: bool) -> DataFrame:
    """Under ``strict`` a null prediction, which no label map knows, fails the job."""
    if not strict:
        return df
    unknown = F.raise_error(F.lit("a prediction is not in the label map")).cast(df.schema[pred].dataType)
    return df.withColumn(pred, F.coalesce(F.col(pred), unknown))


def confusion(df: DataFrame, by: Sequence[str] = (), truth: str = "truth", pred: str = "pred", strict: bool = False) -> DataFrame:
    """Rows of each truth and prediction; null predictions are a column of their own, or an error under ``strict``."""
    df = _known(df, pred, strict)
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def f1_binary(
    df: DataFrame, positive: object, by: Sequence[str] = (), truth: str = "truth", pred: str = "pred", strict: bool = False
) -> DataFrame:
    """F1 of the positive label from ``truth`` and mapped ``pred`` values.

    A null prediction (failed or unmapped row) is wrong and not positive; ``n_error`` counts such rows. ``strict``
    makes it an error.
    """
    df = _known(df, pred, strict)
    is_pos = F.col(truth) == F.lit(positive)
    said_pos = F.coalesce(F.col(pred) == F.lit(positive), F.lit(False))
    out = df.groupBy(*by).agg(
        F.count_if(is_pos & said_pos).alias("tp"),
        F.count_if(~is_pos & said_pos).alias("fp"),
        F.count_if(is_pos & ~said_pos).alias("fn"),
        F.count_if(F.col(pred).isNull()).alias("n_error"),
    )
    weight = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return out.withColumn("f1", F.coalesce(_ratio(2.0 * F.col("tp"), weight), F.lit(0.0)))


def f1_weighted(
    df: DataFrame, by: Sequence[str] = (), error_class: str = "neutral", truth: str = "truth", pred: str = "pred",
    strict: bool = False,
) -> DataFrame:
    """Per-class F1 weighted by truth support over the union of truth and predicted classes, and accuracy.

    A prediction that contains the error text is scored as ``error_class``. A null prediction matches no class, or is
    an error under ``strict``.
    """
    df = _known(df, pred, strict)
    said = F.when(F.contains(F.col(pred).cast("string"), F.lit(V.ERROR_TEXT)), F.lit(error_class)).otherwise(F.col(pred).cast("string"))
    cells = confusion(df.withColumns({pred: said, truth: F.col(truth).cast("string")}), by, truth, pred)
    # Each cell speaks for its truth class and, if different, for its predicted class.
    match = (F.col("truth") == F.col("pred")) & F.col("truth").isNotNull()
    hit = F.coalesce(match, F.lit(False))
    sides = F.array(
        F.struct(F.col("truth").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called"),
                 F.when(hit, F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called"),
                 F.lit(0).cast("bigint").alias("tp")),
    )
    classes = (
        cells.select(*by, F.inline(sides))
        .where(F.col("cls").isNotNull())
        .groupBy(*by, "cls")
        .agg(*[F.sum(c).alias(c) for c in ("support", "called", "tp")])
    )
    f1 = F.coalesce(_ratio(2.0 * F.col("tp"), F.col("support") + F.col("called")), F.lit(0.0))
    total = F.sum("support")
    return classes.withColumn("f1", f1).groupBy(*by).agg(
        F.coalesce(_ratio(F.sum(F.col("support") * F.col("f1")), total), F.lit(0.0)).alias("f1_weighted"),
        F.coalesce(_ratio(F.sum("tp"), total), F.lit(0.0)).alias("accuracy"),
        total.alias("n"),
        F.count(F.lit(1)).alias("n_classes"),
    )
