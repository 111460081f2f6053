"""The two evaluation runs as jobs: classify and log, then score the log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions import fixed_values as V
from assay.functions.text import lookup, strip
from assay.operators import metrics as M
from assay.operators.ordinals import assign_ordinal
from assay.operators.predict import Predictor, predict
from assay.operators.prepare import EvalTask
from assay.sources.results_log import RUN_COLUMNS, read_results_log, write_results_log


def first_words(label_map: Mapping[str, str]) -> dict[str, str]:
    """The map by the first word of each label, in the same order; labels that then collide are an error."""
    short = {label.split(" ")[0]: value for label, value in label_map.items()}
    if len(short) != len(label_map):
        raise ValueError(f"labels are not unique by their first word: {list(label_map)}")
    return short


def metric_run(
    pairs: DataFrame, label_map: Mapping[str, str], by: Sequence[str] = (), strict: bool = True, error_value: str = "neutral"
) -> DataFrame:
    """F1 and accuracy per run from aligned ``truth`` and logged ``pred``: ``by``, metric, f1, accuracy, n.

    Predictions are mapped to target values by the first word of each label. With at most two labels the F1 is that of
    the first label's value (``binary``), otherwise weighted by support (``weighted``). A prediction that contains the
    error text counts as ``error_value``; any other one outside the map is an error, or wrong without ``strict``.
    """
    names = first_words(label_map)
    text = strip(F.col("pred"))
    value = lookup(text, names)
    if strict:
        value = F.coalesce(value, F.raise_error(F.concat(F.lit("not a label: "), F.coalesce(text, F.lit("null")))).cast("string"))
    failed = F.coalesce(F.contains(F.col("pred"), F.lit(V.ERROR_TEXT)), F.lit(False))
    valued = pairs.select(*by, F.col("truth").cast("string").alias("truth"), F.when(failed, F.lit(error_value)).otherwise(value).alias("pred"))
    if len(names) > 2:
        return M.f1_weighted(valued, by).select(*by, F.lit("weighted").alias("metric"), F.col("f1_weighted").alias("f1"), "accuracy", "n")
    # The few cells of the confusion table give both figures.
    positive = next(iter(names.values()))
    is_pos, said_pos = F.col("truth") == positive, F.coalesce(F.col("pred") == positive, F.lit(False))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    cells = M.confusion(valued, by).groupBy(*by).agg(
        count(is_pos & said_pos).alias("tp"), count(is_pos | said_pos).alias("either"),
        count(F.coalesce(F.col("truth") == F.col("pred"), F.lit(False))).alias("hits"), F.sum("n").alias("n"),
    )
    f1 = F.coalesce(2.0 * F.col("tp") / F.nullif(F.col("either") + F.col("tp"), F.lit(0)), F.lit(0.0))
    return cells.select(*by, F.lit("binary").alias("metric"), f1.alias("f1"), (F.col("hits") / F.nullif("n", F.lit(0))).alias("accuracy"), "n")


def classification_run(
    task: EvalTask, predictor: Predictor, label_map: Mapping[str, str], m_type: str, model: str, order: Sequence[str], dial: str, root: str
) -> DataFrame:
    """Predict a task, write its result log below ``root``, and give the mean score per dial from that log.

    Examples are numbered in ``order`` within each ``dial``, which is the id in the log. A prediction that fails or is
    not in the label map is logged as the error text with score 0.
    """
    names = first_words(label_map)
    numbered = assign_ordinal(task.df, order, by=[dial], name="_id")
    called = predict(numbered, predictor)
    value = lookup(F.col("pred"), names)
    known = F.col("error").isNull() & value.isNotNull()
    hit = F.coalesce(known & (value == F.col(f"`{task.y}`").cast("string")), F.lit(False))
    scored = called.select(
        F.lit(task.name).alias("dataset"), F.lit(m_type).alias("m_type"), F.lit(model).alias("model"), F.col(dial).alias("dial"), F.col("_id").alias("id"),
        F.when(known, F.col("pred")).otherwise(F.lit(V.ERROR_TEXT)).alias("pred"), hit.cast("int").alias("score"),
    )
    write_results_log(scored, root)
    return M.mean_skip_na(read_results_log(task.df.sparkSession, root), RUN_COLUMNS)
