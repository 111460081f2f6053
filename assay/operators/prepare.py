"""Preparation of example tables: filters, projections, decoding, splitting and sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions import fixed_values as V
from assay.functions.text import as_col, lookup, md5_uniform
from assay.operators.ordinals import assign_ordinal


@dataclass(frozen=True)
class EvalTask:
    """Input column, target column and the lazy table of one evaluation set."""

    name: str
    x: str
    y: str
    df: DataFrame


def drop_null_target(df: DataFrame, y: str) -> DataFrame:
    return df.where(F.col(f"`{y}`").isNotNull())


def extract_field(df: DataFrame, arr: str, field: str) -> DataFrame:
    """``array<struct>`` -> array of one of its fields."""
    return df.withColumn(arr, F.col(f"{arr}.{field}"))


def nonempty(df: DataFrame, arr: str) -> DataFrame:
    return df.where(F.size(arr) > 0)


def select_rename(df: DataFrame, order: Sequence[str], renames: Mapping[str, str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in order]).withColumnsRenamed(dict(renames))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating-point column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats})


def normalize_keys(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(key, F.col(key).cast("string"))


def decode_labels(
    df: DataFrame, code: str, names: Sequence[str] | Mapping[int, str], out: str = "label_name", strict: bool = True
) -> DataFrame:
    """Integer code -> name by a short fixed list; an unknown code fails when ``strict``, else gives null.

    A list is indexed by the code; a mapping, for codes with gaps, is searched.
    """
    if isinstance(names, Mapping):
        name = lookup(F.col(code).cast("int"), dict(names))
    else:
        name = F.get(F.array(*[F.lit(n) for n in names]), F.col(code).cast("int"))
    if strict:
        unknown = F.raise_error(F.concat(F.lit(f"no name for {code} "), F.coalesce(F.col(code).cast("string"), F.lit("null"))))
        name = F.coalesce(name, unknown)
    return df.withColumn(out, name)


def hash_split(
    df: DataFrame, key: str, test_share: float = V.TEST_SHARE, seed: int = V.SPLIT_SEED, out: str = "split"
) -> DataFrame:
    """Mark each row train or test by a hash of its key: stable under repartitioning, ratio approximate."""
    return df.withColumn(out, F.when(md5_uniform(key, seed) < test_share, "test").otherwise("train"))


def sample_n(df: DataFrame, key: str, n: int, seed: int = V.SPLIT_SEED) -> DataFrame:
    """``n`` rows in a reproducible order: without replacement if there are enough rows, else with.

    Adds ``draw``, the 0-based draw number. ``n`` is the size of the wanted sample, e.g. a codebook.
    """
    ranked = df.withColumn("_rank", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    # Rows by the first four digits of the digest, at most 65,536 counts: up to which of them the n smallest reach.
    heads = ranked.groupBy(F.substring("_rank", 1, 4).alias("head")).agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sum(r["n"] for r in heads)
    if rows == 0:
        return df.withColumn("draw", F.lit(0).cast("bigint"))
    if rows >= n:
        found, last = 0, ""
        for last, count in sorted((r["head"], r["n"]) for r in heads):
            found += count
            if found >= n:
                break
        top = ranked.where(F.substring("_rank", 1, 4) <= last)
        return assign_ordinal(top, ["_rank", key], name="draw").where(F.col("draw") < n).drop("_rank")
    draws = df.sparkSession.range(n).select(
        F.col("id").alias("draw"),
        F.pmod(
            F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:draw:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast(
                "bigint"
            ),
            F.lit(rows),
        ).alias("_pick"),
    )
    numbered = assign_ordinal(df, [key], name="_pick")
    return draws.join(numbered, "_pick").select(*df.columns, "draw")


def check_labels(labels: DataFrame, task: str = "task", label: str = "label", strict: bool = False) -> DataFrame:
    """Per task: labels, labels of several words, distinct first words, and whether first words are unique.

    Under ``strict`` a task whose labels collide after truncation fails the job.
    """
    first = truncate_label(label)
    checked = labels.groupBy(task).agg(
        F.count(F.lit(1)).alias("n_labels"),
        F.sum((F.size(F.split(label, " ")) > 1).cast("bigint")).alias("n_multi_word"),
        F.count_distinct(first).alias("n_distinct"),
    )
    unique = F.col("n_labels") == F.col("n_distinct")
    if strict:
        collide = F.raise_error(F.concat(F.lit("labels are not unique in "), F.col(task))).cast("boolean")
        unique = F.when(unique, F.lit(True)).otherwise(collide)
    return checked.withColumn("is_unique", unique)


def truncate_label(label: Column | str) -> Column:
    return F.get(F.split(as_col(label), " "), F.lit(0))
