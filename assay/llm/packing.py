"""Packing into optimal length buckets.

The global histogram of sequence lengths is folded into bucket boundaries by dynamic programming: no other choice of as
many boundaries pads less. Batches of a token budget then form inside each bucket, in random order, all full but the
last of a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.registry import query, table
from assay.llm.storage import dense_rank_in_blocks, partitions, written
from assay.llm.words import text_bytes, unspaced

MAX_LENGTH = 2048  # longer documents become several sequences, so the histogram has no more rows than this
BUCKETS = 8
TOKEN_BUDGET = 65_536
BLOCK_ROWS = 250_000


def word_counts(column: pa.Array) -> np.ndarray:
    """Words between white space, per row of a text column; null has none."""
    data, rows = text_bytes(column)
    inside = unspaced()[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = rows[(rows > 0) & (rows < len(data))]
    first[cut] = inside[cut]
    return np.diff(np.concatenate([[0], np.cumsum(first)])[rows])


def bucket_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """The boundaries (longest lengths of the buckets, ascending) that pad least, and the padding.

    ``lengths`` ascend. best[k][j]: least padding of the j shortest lengths in k buckets; a bucket that holds lengths
    i..j-1 pads each up to length j-1.
    """
    n = len(lengths)
    number = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    best = np.where(np.arange(n + 1) == 0, 0.0, np.inf)
    choice = []
    for _ in range(min(buckets, n)):
        after, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + (number[j] - number[:j]) * float(lengths[j - 1]) - (tokens[j] - tokens[:j])
            back[j] = int(cost.argmin())
            after[j] = cost[back[j]]
        best = after
        choice.append(back)
    ends, j = [], n
    for back in reversed(choice):
        ends.append(int(lengths[j - 1]))
        j = int(back[j])
    return ends[::-1], int(best[n]) if n else 0


def packed(sequences: DataFrame, buckets: int = BUCKETS, max_length: int = MAX_LENGTH, budget: int = TOKEN_BUDGET, seed: int = 42) -> DataFrame:
    """Sequences of at most ``max_length`` tokens, each with its bucket, batch and slot.

    ``sequences`` needs (doc_id, n_tokens); an end token is added to each, so an empty document is one token. Result:
    doc_id, piece (0 for the first sequence of a document), start, length, bucket (its padded length), batch (from 0 in
    the bucket), slot (from 0 in the batch). A batch has budget // bucket slots, at least one. Null ids and repeated
    rows are sequences like others; null n_tokens counts as 0.
    """
    if max_length > budget:
        raise ValueError("a batch must hold the longest sequence")
    spark = sequences.sparkSession
    total = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long") + 1
    rows = sequences.select("doc_id", total.alias("total"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / max_length).cast("long"))))
    start = F.col("piece") * max_length
    rows = rows.select("doc_id", "piece", start.alias("start"), F.least(F.lit(max_length).cast("long"), F.col("total") - start).cast("int").alias("length"), "_row")
    rows = written(rows.withColumn("_key", F.xxhash64(F.lit(seed), "_row", "piece")).withColumn("_tie", F.struct("_row", "piece")), "sequences")
    histogram = sorted((r[0], r[1]) for r in rows.groupBy("length").count().collect())
    lengths, counts = (np.array(x, np.int64) for x in (zip(*histogram) if histogram else ((), ())))
    ends, _ = bucket_boundaries(lengths, counts, buckets)
    bucket = F.lit(max_length)
    for end in reversed(ends):
        bucket = F.when(F.col("length") <= end, F.lit(end)).otherwise(bucket)
    n = int(counts.sum())
    blocks = max(1, -(-n // (max(1, len(ends)) * BLOCK_ROWS)), -(-partitions(spark) // max(1, len(ends))))
    ranked = dense_rank_in_blocks(rows.withColumn("bucket", bucket), ["bucket"], "_key", "_rank", blocks, "_tie")
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket"))).cast("long")
    return ranked.select("doc_id", "piece", "start", "length", "bucket", F.floor(F.col("_rank") / capacity).cast("long").alias("batch"), (F.col("_rank") % capacity).cast("int").alias("slot"))


def _counted(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(word_counts(batch["text"]))], names=["doc_id", "n_tokens"])


def word_lengths(documents: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): words of every whole text."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted, "doc_id long, n_tokens long")


@query("op8_length_buckets")
def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(word_lengths(table(spark, sf_dir, "documents")))
