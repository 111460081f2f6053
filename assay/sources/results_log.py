"""Scored prediction logs: ``id[SEP_DIAL]\"\"\"prediction\"\"\"[SEP_DIAL]score`` lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions import fixed_values as V
from assay.functions.text import as_col, decode_pred, encode_pred
from assay.sources.lines import ranged, with_places

RUN_COLUMNS = ["dataset", "m_type", "model", "dial"]
# <dataset>_<run tag>_Results/<run type>_<model>/<dial>_outs.txt, a file or a folder of files
FLAT_PATH = r"([^/]+)_Results/([^/_]+)_([^/]+)/([^/]+)_outs\.txt(/[^/]*)?$"


def format_line(row_id: Column | str, pred: Column | str, score: Column | str) -> Column:
    """One log line. A null score is written as ``NA``, a null prediction as the error text; a null id is an error."""
    no_id = F.raise_error(F.lit("a result line needs an id")).cast("string")
    return F.concat_ws(
        V.FIELD_SEP,
        F.coalesce(as_col(row_id).cast("string"), no_id),
        encode_pred(F.coalesce(as_col(pred), F.lit(V.ERROR_TEXT))),
        F.coalesce(as_col(score).cast("string"), F.lit(V.MISSING_SCORE)),
    )


def parse_lines(df: DataFrame, line: str = "value", mode: str = "strict") -> DataFrame:
    """Replace the line column by ``id``, ``pred``, ``score`` (null for NA) and ``malformed``.

    A line is malformed unless it has exactly three fields and its score is a number or NA. ``strict`` fails on
    such a line, ``quarantine`` keeps it with ``malformed = true`` and the line in ``pred``.
    """
    if mode not in ("strict", "quarantine"):
        raise ValueError(f"unknown mode {mode!r}")
    keep = [F.col(c) for c in df.columns if c != line]
    fields = F.split(F.col(line), r"\[SEP_DIAL\]", -1)
    score_text = F.get(fields, F.lit(2))
    score = score_text.try_cast("double")
    is_na = score_text == V.MISSING_SCORE
    fine = (F.size(fields) == 3) & (is_na | score.isNotNull())
    if mode == "strict":
        bad = F.raise_error(F.concat(F.lit("malformed result line: "), F.col(line)))
        return df.select(
            *keep,
            F.when(fine, F.get(fields, F.lit(0))).otherwise(bad).alias("id"),
            decode_pred(F.get(fields, F.lit(1))).alias("pred"),
            score.alias("score"),
        )
    return df.select(
        *keep,
        F.when(fine, F.get(fields, F.lit(0))).alias("id"),
        F.when(fine, decode_pred(F.get(fields, F.lit(1)))).otherwise(F.col(line)).alias("pred"),
        F.when(fine, score).alias("score"),
        (~fine).alias("malformed"),
    )


def _dataset_of(folder: Column) -> Column:
    """Known evaluation set a folder name starts with; else the name without its ``_tmp`` tag."""
    known = [F.when(folder.startswith(name), F.lit(name)) for name in V.EVAL_SETS]
    return F.coalesce(*known, F.regexp_replace(folder, "_tmp$", ""))


def read_results_log(
    spark: SparkSession, path: str | list[str], mode: str = "strict", layout: str = "partitioned", base_path: str | None = None,
    places: bool = False,
) -> DataFrame:
    """Read logs with their run columns ``dataset``, ``m_type``, ``model``, ``dial``.

    ``partitioned`` is the layout ``write_results_log`` makes: filters on run columns skip whole folders. Several such
    folders below ``base_path`` may be given.
    ``places`` adds ``place``, the number of each line in its run (from 0, over all files of the run in their order).
    ``flat`` takes the run columns from ``<dataset>_<tag>_Results/<type>_<model>/<dial>_outs.txt`` paths.
    """
    if layout == "partitioned":
        schema = ", ".join(f"{c} string" for c in ("value", *RUN_COLUMNS))
        if path == []:
            lines = spark.createDataFrame([], schema)
        else:
            reader = spark.read if base_path is None else spark.read.option("basePath", base_path)
            lines = reader.schema(schema).text(path, lineSep="\n")
    elif layout == "flat":
        folder, m_type, model, dial = [F.regexp_extract("_metadata.file_path", FLAT_PATH, i) for i in (1, 2, 3, 4)]
        lines = spark.read.text(path, lineSep="\n", recursiveFileLookup=True)
        runs = {"dataset": _dataset_of(folder), "m_type": m_type, "model": model, "dial": dial}
        lines = lines.select("value", *[c.alias(name) for name, c in runs.items()], "_metadata")
    else:
        raise ValueError(f"unknown layout {layout!r}")
    if places:
        lines = with_places(ranged(lines), RUN_COLUMNS, "place")
    extra = [*(["place"] if places else []), *(["malformed"] if mode == "quarantine" else [])]
    return parse_lines(lines, mode=mode).select(*RUN_COLUMNS, "id", "pred", "score", *extra)


def write_results_log(df: DataFrame, root: str, mode: str = "errorifexists", order: str | None = None) -> None:
    """Write ``id``, ``pred``, ``score`` of every run below one root, a folder per run.

    A run is a dataset, a run type, a model and a dial. With ``order`` its lines stand in ascending order of that column:
    rows are sorted into ranges of run and order, and the numbers in the names of a run's files follow the ranges, so
    that reading with ``places`` numbers the lines as they were written, over any number of files.
    """
    line = format_line("id", "pred", "score").alias("value")
    if order is None:
        df.select(*RUN_COLUMNS, line).hint("rebalance", *RUN_COLUMNS).write.mode(mode).partitionBy(*RUN_COLUMNS).text(root, lineSep="\n")
        return
    # The writer sorts once more, and loses the order, unless it sees the folder names sorted: it does not see that of
    # nullable or constant ones, so they are made neither (nothing of the order is appended).
    nothing = F.substring(F.coalesce(F.col(f"`{order}`").cast("string"), F.lit("")), F.lit(1), F.lit(0))
    runs = [F.coalesce(F.concat(F.col(c).cast("string"), nothing), F.lit("")).alias(c) for c in RUN_COLUMNS]
    lines = df.select(*runs, F.col(f"`{order}`").alias("_order"), line)
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = lines.repartitionByRange(ranges, *RUN_COLUMNS, "_order").sortWithinPartitions(*RUN_COLUMNS, "_order")
    placed.select(*RUN_COLUMNS, "value").write.mode(mode).partitionBy(*RUN_COLUMNS).text(root, lineSep="\n")
