"""Joins of example tables, logs, label maps and run dimensions.

Sides that can grow carry no broadcast hint: Spark broadcasts a side whose size is known to be below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise sort-merges, splitting skewed partitions at run time.
No side gets a hint: at run time the real size of a derived dimension table decides.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions import fixed_values as V
from assay.session import local_rows, written


def keep_keys(df: DataFrame, key: str, allow: DataFrame) -> DataFrame:
    """Rows whose key is in ``allow``; listed keys without rows are ignored."""
    return df.join(allow.select(F.col(allow.columns[0]).alias(key)), key, "left_semi")


def attach_existing(df: DataFrame, key: str, manifest: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """Attach the listed path to each row, null where the name is not listed. Every row stays, once.

    The listing is written before the join: both sides are then shuffled for the join alone, so that a name which many
    rows share is split among tasks.
    """
    listed = manifest.groupBy(F.col(name).alias(key)).agg(F.min(path).alias(path))
    return df.join(written(listed, "listing"), key, "left")


def match_rate(df: DataFrame, path: str = "path") -> DataFrame:
    return df.agg(F.count(path).alias("n_found"), F.count(F.lit(1)).alias("n_rows"))


def assemble_folds(
    folds: DataFrame, labels: DataFrame, texts: DataFrame, key: str = "file_id", strict: bool = True
) -> DataFrame:
    """Fold members with their label and text record, looked up by key.

    ``folds`` has one row per member, or an array column ``members`` that is exploded first. Under ``strict`` a
    member without label or text fails the job when its row is read; otherwise such members are left out.
    """
    if "members" in folds.columns:
        folds = folds.select(*[c for c in folds.columns if c != "members"], F.explode("members").alias(key))
    how = "left" if strict else "inner"
    out = folds.join(labels.withColumn("_has_label", F.lit(True)), key, how)
    out = out.join(texts.withColumn("_has_text", F.lit(True)), key, how)
    if strict:
        found = F.coalesce("_has_label", F.lit(False)) & F.coalesce("_has_text", F.lit(False))
        missing = F.concat(F.lit("no label or text for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
        out = out.withColumn(key, F.when(found, F.col(key)).otherwise(F.raise_error(missing)))
    return out.drop("_has_label", "_has_text")


def align(log: DataFrame, examples: DataFrame, by: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Pair the i-th log line with the i-th example of its run.

    Both sides carry ``ordinal``; the log also carries ``stored``, the index written in the line, by which its lines
    are numbered: a gap or a repeated index shows, the order of the lines in their file is not looked at. Log lines
    beyond the last example are ignored. Under ``strict`` a missing line or a stored index that differs from the
    position fails the job; otherwise the pair is kept with ``aligned = false``.
    """
    keys = [*by, "ordinal"]
    out = examples.join(log, keys, "left")
    fits = F.coalesce(F.col("stored") == F.col("ordinal"), F.lit(False))
    if not strict:
        return out.withColumn("aligned", fits)
    message = F.concat(F.lit("log does not match example "), F.col("ordinal").cast("string"))
    return out.withColumn("ordinal", F.when(fits, F.col("ordinal")).otherwise(F.raise_error(message)))


def label_map_frame(spark: SparkSession, label_map: Mapping[str, object], value_type: str = "string") -> DataFrame:
    """A label map as rows ``label``, ``value``, ``ord`` in map order."""
    rows = [(label, value, i) for i, (label, value) in enumerate(label_map.items())]
    return local_rows(spark, rows, f"label string, value {value_type}, ord int")


def apply_label_map(df: DataFrame, pred: str, labels: DataFrame, out: str = "value") -> DataFrame:
    """Target value of each predicted label, null for an unmapped one."""
    table = labels.select(F.col("label").alias(pred), F.col("value").alias(out))
    return df.join(table, pred, "left")


def score_label(df: DataFrame, pred: str, truth: str, labels: DataFrame, out: str = "score") -> DataFrame:
    """1 where the mapped prediction equals the truth, else 0.

    An unmapped prediction counts as a failed row: its text becomes the error text and its score 0.
    """
    mapped = apply_label_map(df, pred, labels, "_value")
    known = F.col("_value").isNotNull()
    hit = F.coalesce(known & (F.col("_value") == F.col(truth)), F.lit(False))
    return mapped.withColumns(
        {out: hit.cast("int"), pred: F.when(known, F.col(pred)).otherwise(F.lit(V.ERROR_TEXT))}
    ).drop("_value")


def with_error_policy(df: DataFrame, policy: str, error: str = "error", pred: str = "pred", score: str = "score") -> DataFrame:
    """Failed rows (non-null ``error``) get the error text and a score of 0 (``zero``) or null (``null``)."""
    if policy not in ("zero", "null"):
        raise ValueError(f"unknown policy {policy!r}")
    failed = F.col(error).isNotNull()
    blank = F.lit(0.0) if policy == "zero" else F.lit(None)
    return df.withColumns(
        {
            pred: F.when(failed, F.lit(V.ERROR_TEXT)).otherwise(F.col(pred)),
            score: F.when(failed, blank).otherwise(F.col(score).cast("double")),
        }
    )


def run_matrix(runs: DataFrame, dials: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """Every run on every dial of its data set, and on every example of that dial if ``examples`` is given.

    ``runs`` has ``dataset``, ``m_type``, ``model``; ``dials`` has ``dataset``, ``dial``; ``examples`` has
    ``dataset``, ``dial``. All three meet by equality of keys, so the result is as large as the work it lists.
    """
    matrix = runs.join(dials, "dataset")
    if examples is None:
        return matrix
    return examples.join(matrix, ["dataset", "dial"])


def unpivot_dialects(df: DataFrame, ids: Sequence[str], dials: Sequence[str]) -> DataFrame:
    """Dialect columns to rows ``dial``, ``x`` in one scan; null cells stay."""
    return df.unpivot(list(ids), list(dials), "dial", "x")


def pending(inputs: DataFrame, outputs: DataFrame, key: str = "id", pred: str = "pred") -> DataFrame:
    """Inputs that have no successful output yet."""
    done = outputs.where(F.col(pred).isNotNull() & (F.col(pred) != V.ERROR_TEXT)).select(key)
    return inputs.join(done, key, "left_anti")
