"""Evaluation sets by name: input column, target column and the filtered table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions import fixed_values as V
from assay.operators.prepare import EvalTask, decode_labels, drop_null_target, extract_field, nonempty

Tables = Callable[[str], DataFrame]

# Sets whose integer codes are decoded: code column and names.
CODED = {
    "non_social_SLURP_speaker_intent": ("intent", V.INTENTS),
    "IEMOCAP_emotion_recognition": ("label", V.EMOTIONS_4),
    "MELD_emotion_recognition": ("label", V.EMOTIONS_7),
}
BY_LANGUAGE = ("CommonVoice_speaker_identity", "FLEURS_speaker_identity", "COVOST_translation")


def task_names() -> list[str]:
    return list(V.EVAL_SETS)


def load_task(tables: Tables, name: str, language: str | None = None) -> EvalTask:
    """The task of one evaluation set over ``tables(name)``, which carries ``split`` (and ``language``) columns.

    Filters on split and language reach partitioned storage as partition filters. The dialect set takes the
    language as its input column. An unknown name is an error.
    """
    if name not in V.EVAL_SETS:
        raise KeyError(f"unknown evaluation set {name!r}")
    x, y, split = V.EVAL_SETS[name]
    needs_language = x is None or name in BY_LANGUAGE
    if needs_language and language is None:
        raise ValueError(f"{name} needs a language")
    df = tables(name).where(F.col("split") == split)
    if name in BY_LANGUAGE:
        df = df.where(F.col("language") == language)
    if name in CODED:
        code, names = CODED[name]
        df = decode_labels(drop_null_target(df, code), code, names, out=y)
    else:
        df = drop_null_target(df, y)
    if name == "non_social_HeySquad_QA":
        df = nonempty(extract_field(df, "answers", "text"), "answers")
    return EvalTask(name, x or language, y, df)
