"""Delimited files, file listings, splits and JSON records."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions import fixed_values as V
from assay.sources.lines import count_of, numbered_lines, quoted_records


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    sep: str = ",",
    na_values: list[str] | None = None,
    multi_line: bool = False,
    mode: str = "strict",
) -> DataFrame:
    """Delimited files with a header, columns by name; every missing-value spelling becomes null.

    ``schema`` names the wanted columns, in any order; the header decides where they stand, and all files must have the
    same one. A line with more or fewer fields than the header, a quote that nothing closes and a value of another type
    are problems: ``strict`` fails on the first, ``quarantine`` adds ``problem``, null where all is well, and the
    offending text as ``raw``. ``multi_line`` allows line breaks inside quoted fields; a file is read by many tasks either
    way. A wanted column that the header lacks, or has twice, is an error at once.
    """
    if mode not in ("strict", "quarantine"):
        raise ValueError(f"unknown mode {mode!r}")
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    lines = numbered_lines(spark, path)
    headers = lines.where("line = 0").select(F.rtrim(F.col("value"), F.lit("\r")).alias("value")).distinct().limit(2).collect()
    if len(headers) != 1:
        raise ValueError(f"{path} has no header" if not headers else f"{path} has different headers: {headers[0][0]!r}, {headers[1][0]!r}")
    header = next(csv.reader([headers[0][0]], delimiter=sep))
    wanted = [f.name for f in schema]
    wrong = [name for name in wanted if header.count(name) != 1]
    if wrong:
        raise ValueError(f"columns {wrong} are not in the header {header} once")
    records = quoted_records(lines) if multi_line else lines.withColumn("open", count_of(F.col("value"), '"') % 2 == 1)
    records = records.where("line > 0").withColumn("value", F.rtrim(F.col("value"), F.lit("\r"))).where("value <> ''")
    fields = [f"c{i}" for i in range(len(header))]
    options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "nullValue": "", "emptyValue": ""}
    parsed = records.withColumn("row", F.from_csv("value", ", ".join(f"{f} string" for f in fields), options))
    texts = {name: F.col(f"row.{fields[header.index(name)]}") for name in wanted}
    missing = V.NA_VALUES if na_values is None else na_values
    known = {name: F.when(~text.isin(missing), text) for name, text in texts.items()}
    values = {f.name: known[f.name].try_cast(f.dataType) for f in schema}
    problem = F.coalesce(
        F.when(F.col("open"), F.lit("open quote")),
        F.when(F.col("n_fields") != len(header), F.concat(F.lit(f"not {len(header)} fields but "), F.col("n_fields").cast("string"))),
        *[F.when(known[f.name].isNotNull() & values[f.name].isNull(), F.concat(F.lit(f"{f.name} is not {f.dataType.simpleString()}: "), texts[f.name])) for f in schema],
    )
    checked = parsed.withColumn("n_fields", _field_count(F.col("value"), sep)).withColumn("problem", problem)
    if mode == "quarantine":
        fine = F.col("problem").isNull()
        return checked.select(*[F.when(fine, values[n]).alias(n) for n in wanted], "problem", F.when(~fine, F.col("value")).alias("raw"))
    stop = F.raise_error(F.concat(F.col("problem"), F.lit(" in "), F.col("file"), F.lit(" after line "), F.col("line").cast("string")))
    return checked.select(*[F.when(F.col("problem").isNull(), values[n]).otherwise(stop).alias(n) for n in wanted])


def _field_count(record: Column, sep: str) -> Column:
    """Fields of a record: separators outside quotes, and one."""
    bare = F.regexp_replace(record, '"[^"]*+"', "")
    return count_of(bare, sep) + 1


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.csv(path, sep=sep, header=True, escape='"', nullValue="NA")


def file_manifest(spark: SparkSession, glob: str) -> DataFrame:
    """Path, name and size of the files matching a glob; file contents are not read."""
    listing = spark.read.format("binaryFile").load(glob).select("path", "length")
    return listing.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def read_split(spark: SparkSession, path: str, split: str, language: str | None = None) -> DataFrame:
    """One named split, optionally of one language; both are partition columns, so other folders are not read."""
    df = spark.read.parquet(path).where(F.col("split") == split)
    if language is not None:
        df = df.where(F.col("language") == language)
    return df


def publish(df: DataFrame, path: str, split_col: str = "split", extra: tuple[str, ...] = ()) -> None:
    """Write a data set partitioned by split (and e.g. language).

    Rebalancing lets AQE merge small output partitions and cut a dominating split into many files.
    """
    keys = [split_col, *extra]
    df.hint("rebalance", *keys).write.partitionBy(*keys).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Write records as line JSON, nulls kept."""
    df.write.json(path, ignoreNullFields=False)
