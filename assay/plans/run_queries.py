"""Whole evaluation runs: task, prediction, log, alignment and metric."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import fixed_values as V
from assay.operators.evaluation import classification_run, metric_run
from assay.operators.joins import align
from assay.operators.ordinals import assign_ordinal
from assay.operators.predict import BatchPredictor
from assay.plans import fixtures as fx
from assay.plans.evaluation_queries import CALLED_SQL, WEIGHTED_SQL, rounded
from assay.plans.registry import query
from assay.plans.tasks import load_task
from assay.session import scratch_path
from assay.sources.results_log import read_results_log, write_results_log

SARCASM = "Mustard_sarcasm"


@query(
    "metric_run_binary",
    fx.with_(
        [*fx.ANSWERS_SQL,
         """counts AS (SELECT model, dial, sum((truth = 1 AND pred = 'Yes')::INT) AS tp, sum((truth = 1 OR pred = 'Yes')::INT) AS either,
            avg(((truth = 1 AND pred = 'Yes') OR (truth = 0 AND pred = 'No'))::INT) AS accuracy, count(*) AS n FROM answers GROUP BY ALL)"""],
        """SELECT model, dial, 'binary' AS metric, round(CASE WHEN either = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (either + tp) END, 6) AS f1,
                  round(accuracy, 6) AS accuracy, n FROM counts""",
    ),
)
def metric_run_binary(spark, sf_dir):
    """The sarcasm log is written, read, aligned with its examples by position, and scored."""
    root, run = scratch_path(spark, "log"), ["model", "dial"]
    scored = assign_ordinal(fx.predictions(spark, sf_dir), ["id"], by=run)
    log = scored.select(F.lit(SARCASM).alias("dataset"), F.lit("e2e").alias("m_type"), *run, F.col("ordinal").alias("id"), "pred", "score")
    write_results_log(log, root)
    lines = read_results_log(spark, root).select(*run, F.col("id").cast("bigint").alias("stored"), "pred")
    lines = assign_ordinal(lines, ["stored"], by=run)
    examples = scored.select(*run, "ordinal", (F.col("truth") == 1).cast("string").alias("truth"))
    result = metric_run(align(lines, examples, run), V.LABEL_MAPS[SARCASM], run)
    return result.select(*run, "metric", rounded("f1"), rounded("accuracy"), "n")


def _list_sql(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


MELD = "MELD_emotion_recognition"
SEVEN = V.LABEL_MAPS[MELD]


@query(
    "metric_run_weighted",
    fx.with_(
        [*CALLED_SQL[:-1],
         f"""said AS (SELECT {_list_sql(SEVEN.values())}[truth % 7 + 1] AS truth,
            CASE WHEN vec_id % 19 = 0 THEN 'neutral' ELSE {_list_sql(SEVEN.values())}[best % 7 + 1] END AS pred
            FROM (SELECT vec_id, truth, arg_max(label, score) AS best FROM label_scores GROUP BY vec_id, truth))""",
         WEIGHTED_SQL.format(t="said")],
        """SELECT 'weighted' AS metric, round(sum(support * 2.0::DOUBLE * tp / (support + said)) / sum(support), 6) AS f1,
                  round(sum(tp) / sum(support), 6) AS accuracy, sum(support)::BIGINT AS n FROM per_class""",
    ),
)
def metric_run_weighted(spark, sf_dir):
    """Seven emotions; a failed row counts as neutral."""
    from assay.operators.predict import argmax_label

    name = lambda names, code: F.get(F.array(*[F.lit(n) for n in names]), (code % 7).cast("int"))
    said = F.when(F.col("vec_id") % 19 == 0, F.concat(F.lit(V.ERROR_TEXT), F.lit(": out of memory"))).otherwise(name(SEVEN, argmax_label(F.col("scores"))))
    pairs = fx.label_scores(spark, sf_dir).select(name(SEVEN.values(), F.col("truth")).alias("truth"), said.alias("pred"))
    return metric_run(pairs, SEVEN).select("metric", rounded("f1"), rounded("accuracy"), "n")


def _load_rule():
    def model(rows):
        if any(row["doc_id"] % 17 == 0 for row in rows):
            raise ValueError("broken clip")
        return ["Yes" if row["n_chars"] >= 400 else "No" for row in rows]

    return model


@query(
    "classification_run",
    fx.with_(
        [fx.ITEMS_SQL],
        """SELECT 'Mustard_sarcasm' AS dataset, 'e2e' AS m_type, 'm_len' AS model, lang AS dial,
                  round(avg(CASE WHEN doc_id % 17 <> 0 AND (n_chars >= 400) = (quality = 1) THEN 1 ELSE 0 END), 6) AS mean_score, count(*) AS n_scored
           FROM items WHERE quality IS NOT NULL AND split = 'train' GROUP BY lang""",
    ),
)
def classification_run_query(spark, sf_dir):
    items = fx.items(spark, sf_dir).select("doc_id", "n_chars", "lang", "split", (F.col("quality") == 1).alias("sarcasm"))
    task = load_task(lambda name: items, SARCASM)
    predictor = BatchPredictor(_load_rule, ["doc_id", "n_chars"])
    means = classification_run(task, predictor, V.LABEL_MAPS[SARCASM], "e2e", "m_len", ["doc_id"], "lang", scratch_path(spark, "log"))
    return means.withColumn("mean_score", F.round("mean_score", 6))
