"""Text files as numbered lines, and running sums along them, with every file split over many tasks.

A file split is a byte range; its lines are read in order by one task. So the place of a line in its file is its place in the
range plus the lines of the ranges before, and any sum along the lines is a sum in the range plus those of the ranges before.
Only a row per range is needed to tell, so state that runs through a whole file (line numbers, open quotes, the depth of
braces) costs two scans instead of one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assay.session import written

# A writer's files: the task that wrote it, then the file of the task.
_PART, _FILE_OF_TASK = r"part-(\d+)-[^/]*$", r"\.c(\d+)[^/]*$"


def _number(path: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(path, pattern, 1).try_cast("bigint"), F.lit(-1))


def ranged(lines: DataFrame) -> DataFrame:
    """Lines of the text source with their ``file``, the byte where their ``range`` begins, and ``read``, which grows along it."""
    return lines.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("read"))


def with_places(lines: DataFrame, by: Sequence[str] = ("file",), name: str = "line") -> DataFrame:
    """Number the lines of ``ranged`` from 0 in each ``by`` group: file by file as their writer's tasks were numbered.

    The scan is planned twice, alike, so that ``read`` is the same in both; the ranges, a row for every file split, are
    broadcast, so that no text is shuffled for its place.
    """
    ranges = lines.groupBy(*dict.fromkeys([*by, "file", "range"])).agg(F.min("read").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy(_number(F.col("file"), _PART), _number(F.col("file"), _FILE_OF_TASK), "file", "range").rowsBetween(W.unboundedPreceding, -1)
    shifts = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("file", "range", "_first", "_before")
    placed = lines.join(F.broadcast(shifts), ["file", "range"])
    return placed.withColumn(name, F.col("read") - F.col("_first") + F.col("_before")).drop("_first", "_before", "read")


def numbered_lines(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """``file``, ``range``, ``line`` (from 0 in its file) and ``value`` of every line; a line ends with a line feed."""
    lines = ranged(spark.read.text(path, lineSep="\n", **options))
    return with_places(lines).select("file", "range", "line", "value")


def running(lines: DataFrame, amount: Column, name: str) -> DataFrame:
    """Add the sum of ``amount`` over the lines before in the file. ``lines`` must be stable (written), it is read twice."""
    inside = W.partitionBy("file", "range").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    summed = lines.withColumn("_run_amount", amount).withColumn("_run_inside", F.coalesce(F.sum("_run_amount").over(inside), F.lit(0)))
    ranges = lines.groupBy("file", "range").agg(F.sum(amount).alias("_run_sum"))
    before = W.partitionBy("file").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    shifts = ranges.select("file", "range", F.coalesce(F.sum("_run_sum").over(before), F.lit(0)).alias("_run_before"))
    return summed.join(F.broadcast(shifts), ["file", "range"]).withColumn(name, F.col("_run_inside") + F.col("_run_before")).drop("_run_amount", "_run_inside", "_run_before")


def grouped_lines(lines: DataFrame, group: str) -> DataFrame:
    """The lines of each ``group`` of a file joined by line feeds, in order: ``file``, ``line`` (the first), ``value``."""
    together = F.sort_array(F.collect_list(F.struct("line", "value")))
    joined = lines.groupBy("file", group).agg(together.alias("_lines"))
    return joined.select("file", F.col("_lines")[0]["line"].alias("line"), F.array_join(F.col("_lines.value"), "\n").alias("value"))


def count_of(text: Column, mark: str) -> Column:
    """How often a character occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def quoted_records(lines: DataFrame, quote: str = '"') -> DataFrame:
    """Lines joined to records where a quoted field spans several of them: ``file``, ``line``, ``value``, ``open``.

    A line begins inside quotes if an odd number of quotes stands before it. Lines that are records by themselves are left
    alone. After a quote that nothing closes, the lines up to the end of the file are rows of their own, with ``open``.
    """
    odd = count_of(F.col("value"), quote) % 2
    lines = running(written(lines, "lines"), odd, "_odds")
    # A record opens where the odd lines before are even in number; it goes on, and ends, where there is one more.
    lines = lines.withColumns({"_inside": F.col("_odds") % 2 == 1, "_opens": (F.col("_odds") % 2 == 0) & (odd == 1), "_record": F.floor(F.col("_odds") / 2)})
    lines = written(lines, "lines")
    alone = lines.where(~F.col("_inside") & ~F.col("_opens")).select("file", "line", "value", F.lit(False).alias("open"))
    parts = lines.where(F.col("_inside") | F.col("_opens"))
    # The last record of a file with an odd number of quotes never ends.
    ends = lines.groupBy("file").agg(F.max(F.struct("line", "_inside", "_opens", "_record", odd.alias("odd"))).alias("_end"))
    unclosed = ends.where((F.col("_end._inside") & (F.col("_end.odd") == 0)) | F.col("_end._opens")).select("file", F.col("_end._record").alias("_last"))
    parts = parts.join(unclosed, "file", "left")
    lost = F.coalesce(F.col("_record") == F.col("_last"), F.lit(False))
    whole = grouped_lines(parts.where(~lost), "_record").withColumn("open", F.lit(False))
    return alone.union(whole).union(parts.where(lost).select("file", "line", "value", F.lit(True)))


# A JSON string; the loops never give back, so they need no stack.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def json_members(lines: DataFrame) -> DataFrame:
    """Texts of JSON objects, cut between their members: ``file``, ``value``, each an object of a few members.

    Strings hold no line breaks in JSON, so the depth of a line is that of the braces before. A piece ends after a line at
    depth 1 that ends with the comma of a member or the opening brace, and after a line at depth 0; objects of one line
    each are pieces as they are. A file whose braces don't close gives one piece more, which is no object.
    """
    bare = F.regexp_replace("value", _STRING, "")
    delta = count_of(bare, "{") + count_of(bare, "[") - count_of(bare, "}") - count_of(bare, "]")
    last = F.right(F.btrim(bare, F.lit(" \t\r\n")), F.lit(1))
    filled = lines.where(F.btrim("value", F.lit(" \t\r\n")) != "").select("*", delta.alias("_delta"), last.alias("_end"))
    deep = running(written(filled, "lines"), F.col("_delta"), "_depth")
    after = F.col("_depth") + F.col("_delta")
    ends = (after == 0) | ((after == 1) & F.col("_end").isin(",", "{"))
    deep = written(deep.select("file", "range", "line", "value", "_depth", after.alias("_after"), ends.alias("_ends")), "lines")
    pieces = running(deep, F.col("_ends").cast("int"), "_piece")
    first, final = F.min_by("_depth", "line"), F.max_by("_after", "line")
    together = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n")
    texts = pieces.groupBy("file", "_piece").agg(together.alias("text"), first.alias("first"), final.alias("final"))
    body = F.btrim("text", F.lit(" \t\r\n"))
    # The brace of the object itself; a piece at depth 0 without it is no object.
    opened, closed = (F.col("first") > 0) | body.startswith("{"), (F.col("final") > 0) | body.endswith("}")
    start, end = F.when(F.col("first") == 0, 2).otherwise(1), F.when(F.col("final") == 0, F.length(body) - 1).otherwise(F.length(body))
    member = F.rtrim(F.btrim(F.substring(body, start, end - start + 1), F.lit(" \t\r\n")), F.lit(","))
    value = F.when(opened & closed & (F.col("first") >= 0), F.concat(F.lit("{"), member, F.lit("}"))).otherwise(body)
    unclosed = deep.groupBy("file").agg(F.max_by("_after", "line").alias("_left")).where("_left <> 0")
    return texts.select("file", value.alias("value")).union(unclosed.select("file", F.concat(F.lit("braces do not close in "), "file")))
