"""Row numbers over a whole table or within groups, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assay.session import written

# monotonically_increasing_id holds the task in its upper bits and the row of the task in the lower ones.
ROW_BITS = 33


def assign_ordinal(
    df: DataFrame,
    order_cols: Sequence[str],
    by: Sequence[str] = (),
    name: str = "ordinal",
    ranges: int | None = None,
    descending: bool = False,
    check_unique: bool = False,
) -> DataFrame:
    """Add a 0-based row number in ``order_cols`` order (nulls first), over the table or within each ``by`` group.

    Rows are sorted into ``ranges`` key ranges (as many as shuffle partitions by default) and written to the shared
    folder; a row's number is its place in its range plus the rows before that range. The ranges are the tasks of one
    global sort, so a group as large as the table spreads over all of them, at any size and by one path. Rows with
    equal keys keep the order they are read in, and may lie in several ranges. ``check_unique`` raises on equal
    keys. The input is read twice, once to sample its keys; only a row per range is broadcast.
    """
    spark = df.sparkSession
    n = ranges or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(f"`{c}`").desc() if descending else F.col(f"`{c}`").asc() for c in order_cols]
    keys = [*[F.col(f"`{c}`").asc() for c in by], *keys, F.col("_read")]
    tagged = df.withColumn("_read", F.monotonically_increasing_id())
    placed = tagged.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    stored = written(placed.drop("_read"), "ordered")
    row = F.col("_place").bitwiseAND((1 << ROW_BITS) - 1)
    stored = stored.withColumn("_range", F.shiftright("_place", ROW_BITS).cast("int"))
    if check_unique:
        # Equal keys may lie in two ranges, so they are counted over all of them.
        copies = stored.groupBy(*[F.col(f"`{c}`") for c in (*by, *order_cols)]).count()
        if copies.where("count > 1").first() is not None:
            raise ValueError(f"equal keys in {[*by, *order_cols]}")
    columns = [F.col(f"`{c}`") for c in df.columns]
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # over one row per range
    if not by:
        sizes = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
        shifts = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
        return stored.join(F.broadcast(shifts), "_range").select(*columns, (row + F.col("_before")).cast("bigint").alias(name))
    group = F.struct(*[F.col(f"`{c}`") for c in by])
    sizes = stored.groupBy("_range", group.alias("_group")).agg(F.count(F.lit(1)).alias("n"))
    # Only the first group of a range can have rows in earlier ranges, and there it is always the last group.
    ends = sizes.groupBy("_range").agg(F.min("_group").alias("first"), F.max("_group").alias("last"), F.max_by("n", "_group").alias("last_n"))
    running = W.partitionBy("last").orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)
    along = W.orderBy("_range")
    ends = ends.withColumn("run", F.sum("last_n").over(running))
    carry = ends.select("_range", F.col("first").alias("_group"), F.lag("last").over(along).alias("last"), F.lag("run").over(along).alias("_before"))
    carry = carry.where(F.col("last") == F.col("_group")).select("_range", "_group", "_before")
    local = F.row_number().over(W.partitionBy("_range", "_group").orderBy("_place"))
    numbered = stored.withColumn("_group", group).withColumn("_row", local).join(F.broadcast(carry), ["_range", "_group"], "left")
    return numbered.select(*columns, (F.col("_row") + F.coalesce("_before", F.lit(0)) - 1).cast("bigint").alias(name))


def positional_shards(df: DataFrame, order_cols: Sequence[str], k: int, ranges: int | None = None) -> DataFrame:
    """``k`` contiguous shards of ``n // k`` rows each; the trailing ``n % k`` rows are left out by definition."""
    numbered = assign_ordinal(df, order_cols, ranges=ranges)
    size = numbered.count() // k
    if size == 0:
        return numbered.where(F.lit(False)).withColumn("shard", F.lit(0).cast("bigint"))
    kept = numbered.where(F.col("ordinal") < k * size)
    return kept.withColumn("shard", F.floor(F.col("ordinal") / F.lit(size)).cast("bigint"))
