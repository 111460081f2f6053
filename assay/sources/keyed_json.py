"""JSON objects whose keys are record ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.sources.lines import json_members, numbered_lines

MODES = ("strict", "quarantine")


def explode_keyed_json(
    df: DataFrame, doc: Column | str, value_type: str, root: str | None = None, mode: str = "strict"
) -> DataFrame:
    """One row per key of every JSON object in ``doc``; ``root`` names an enclosing key to step into.

    ``value_type`` is a DDL type: a struct for records, a plain type for scalars. Text that is neither blank nor a
    whole JSON object (a line of a pretty-printed file is neither), an object without ``root``, and a value of another
    type are problems. ``strict`` fails on the first of them; ``quarantine`` adds the column ``problem``, null where
    all is well, and keeps the offending text in ``raw``. A bad value costs only its own key.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    kind = T._parse_datatype_string(value_type)
    trimmed = F.btrim(F.col(doc) if isinstance(doc, str) else doc, F.lit(" \t\r\n"))
    texts = df.select(trimmed.alias("text")).where(F.col("text") != "")
    # The outer object first, each value as its own text; a value is parsed alone.
    keyed = F.from_json("text", "map<string,string>", {"mode": "PERMISSIVE"})
    if root is not None:
        keyed = F.from_json(F.try_element_at(keyed, F.lit(root)), "map<string,string>")
    # The parser stops after the first object; as an array of one, the text must be valid to its end.
    alone = F.coalesce(F.json_array_length(F.concat(F.lit("["), "text", F.lit("]"))) == 1, F.lit(False))
    whole = F.col("text").startswith("{") & alone & F.col("keyed").isNotNull()
    parsed = texts.withColumn("keyed", keyed)
    wanted = "object" if root is None else f"object with the key {root}"
    problem = F.when(~whole, F.lit(f"not a JSON {wanted}"))
    empty = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    entries = F.when(whole, F.map_entries("keyed")).otherwise(empty)
    rows = parsed.select(problem.alias("problem"), "text", F.explode(entries).alias("e")).select("problem", "text", "e.key", F.col("e.value").alias("raw"))
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        value = F.from_json("raw", value_type, {"mode": "PERMISSIVE"})
        fits = F.col("raw").startswith("[" if isinstance(kind, T.ArrayType) else "{") & F.col("value").isNotNull()
    else:
        value = F.col("raw").try_cast(kind)
        fits = F.col("value").isNotNull()
    rows = rows.withColumn("value", value)
    wrong = F.concat(F.lit(f"not a {value_type}: "), F.col("raw"))
    problem = F.coalesce("problem", F.when(F.col("raw").isNotNull() & ~fits, wrong))
    if mode == "quarantine":
        raw = F.when(problem.isNotNull(), F.coalesce("raw", "text"))
        return rows.select("key", F.when(problem.isNull(), F.col("value")).alias("value"), problem.alias("problem"), raw.alias("raw"))
    stop = F.raise_error(F.concat(problem, F.lit(" in "), F.substring("text", 1, 200)))
    return rows.select(F.when(problem.isNull(), F.col("key")).otherwise(stop).alias("key"), "value")


def read_keyed_json(
    spark: SparkSession, path: str, value_type: str, root: str | None = None, whole_file: bool = False, mode: str = "strict"
) -> DataFrame:
    """Read object-of-records JSON, a line per object; a large file splits over many tasks.

    ``whole_file=True`` reads files that hold a single object with an enclosing key ``root``, each as one task's work;
    without such a key ``read_indented_json`` reads them in parallel.
    """
    lines = spark.read.text(path, wholetext=whole_file, lineSep=None if whole_file else "\n")
    return explode_keyed_json(lines, "value", value_type, root, mode)


def read_indented_json(spark: SparkSession, path: str, value_type: str, mode: str = "strict") -> DataFrame:
    """Read files that hold one object (or several, one after the other) laid out over lines, many tasks to a file.

    A file is cut where a member of the object ends with its line; only single members are parsed. Braces that don't close
    are a problem of their file.
    """
    return explode_keyed_json(json_members(numbered_lines(spark, path)), "value", value_type, mode=mode)


def write_keyed_json(df: DataFrame, key: str, path: str) -> None:
    """Write one single-key object per line: the splittable form ``read_keyed_json`` reads back."""
    record = F.struct(*[F.col(c) for c in df.columns if c != key])
    df.select(F.to_json(F.create_map(F.col(key).cast("string"), record)).alias("value")).write.text(path)
