"""Sharding as one uniform shuffle, by a hypergeometric communication matrix.

How many rows of each part of the input go to each shard is drawn exactly as a uniform permutation would give it: the
matrix has the part sizes as row sums and the shard sizes as column sums. Rows are permuted inside their part, the
first of them exchanged to shard 0, the next to shard 1 and so on, and permuted again inside their shard. Every order
of all rows is equally likely and shard sizes are exact. Only part sizes and the matrix meet the driver.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.registry import query, table
from assay.llm.storage import dense_rank_in_blocks, partitions, written

# Parts are scan partitions, folded to this many: bounds the matrix at any size of the input.
PARTS = 1024
BLOCK_ROWS = 250_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good balls among ``draws`` of ``good + bad``, by inversion outward from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    peak = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - peak
    if u < 0:
        return mode
    below, above, at_below, at_above = mode, mode, peak, peak
    while below > low or above < high:
        if above < high:
            at_above *= (good - above) * (draws - above) / ((above + 1) * (bad - draws + above + 1))
            above += 1
            u -= at_above
            if u < 0:
                return above
        if below > low:
            at_below *= below * (bad - draws + below) / ((good - below + 1) * (draws - below + 1))
            below -= 1
            u -= at_below
            if u < 0:
                return below
    return mode


def communication_matrix(parts: list[int], shards: list[int], seed: int = 42) -> list[list[int]]:
    """Rows of each part for each shard, distributed as under a uniform permutation of all rows."""
    if sum(parts) != sum(shards):
        raise ValueError("parts and shards hold different numbers of rows")
    rng, room, out = random.Random(seed), list(shards), []
    for size in parts:
        left, rest, row = size, sum(room), []
        for s, free in enumerate(room):
            drawn = hypergeometric(rng, free, rest - free, left)
            row.append(drawn)
            left, rest = left - drawn, rest - free
            room[s] = free - drawn
        out.append(row)
    return out


def shuffled_shards(rows: DataFrame, shards: int, seed: int = 42) -> DataFrame:
    """The rows, with ``shard`` (0 to shards - 1; sizes at most one apart) and ``slot`` (gapless from 0 in the shard).

    Any column may be null, rows may repeat, an empty table gives an empty result. Columns named shard or slot are
    replaced.
    """
    spark = rows.sparkSession
    plain = rows.drop("shard", "slot")
    id_, part, key = "_shuffle_id", "_shuffle_part", "_shuffle_key"
    # Ids are fixed once written: whoever reads them later, after whatever failure, sees the same rows in the same parts.
    keyed = written(plain.withColumn(id_, F.monotonically_increasing_id()).withColumn(part, F.spark_partition_id() % PARTS), "shuffle-input")
    sizes = sorted((r[0], r[1]) for r in keyed.groupBy(part).count().collect())
    total = sum(n for _, n in sizes)
    if not total:
        return plain.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    targets = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([n for _, n in sizes], targets, seed)
    ends = [{"part": p, "ends": [sum(row[: s + 1]) for s in range(shards)]} for (p, _), row in zip(sizes, matrix)]
    bounds = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(ends)), "array<struct<part:int,ends:array<bigint>>>"))).withColumnRenamed("part", part)
    blocks = lambda n: max(1, -(-total // (n * BLOCK_ROWS)), -(-partitions(spark) // n))
    first = keyed.withColumn(key, F.xxhash64(F.lit(seed), id_))
    first = dense_rank_in_blocks(first, [part], key, "_rank", blocks(len(sizes)), id_)
    dealt = first.join(F.broadcast(bounds), part).withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("_rank"))))
    dealt = written(dealt.drop("ends", "_rank", part).withColumn(key, F.xxhash64(F.lit(seed + 1), id_)), "shuffle-exchange")
    return dense_rank_in_blocks(dealt, ["shard"], key, "slot", blocks(shards), id_).drop(key, id_)


@query("op10_hypergeometric_shards")
def op10_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    return shuffled_shards(rows, 40).withColumn("grown_shard", F.lit(None).cast("int"))
