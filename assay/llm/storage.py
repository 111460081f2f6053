"""Intermediate tables in the shared folder, and ranks that need no global window."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assay.session import scratch_path


def give_back() -> None:
    """Memory that this process has freed but still holds goes back to the system, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """The rows, written once to the shared folder and read back: lineage ends there, retries see the same rows."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    give_back()
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dense_rank_in_blocks(df: DataFrame, group: list[str], order: str, rank: str, blocks: int, tie: str) -> DataFrame:
    """Number the rows of each group from 0 in the order of ``order``, a uniformly spread 64-bit hash, then ``tie``.

    The hash range is cut into ``blocks`` equal parts; rows are numbered inside (group, part) and shifted by the
    counts of the parts before. So a group of any size spreads over ``blocks`` tasks, evenly, whatever the data are.
    The input must be stable (``written``) as it is read twice.
    """
    block = (F.shiftrightunsigned(F.col(order), 32).cast("long") * blocks / F.lit(1 << 32)).cast("int")
    parted = df.withColumn("_block", block)
    counts = parted.groupBy(*group, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*group, "_block").orderBy(F.shiftrightunsigned(order, 32), order, tie)
    numbered = parted.withColumn("_row", F.row_number().over(within) - 1)
    return numbered.join(shifts, [*group, "_block"]).withColumn(rank, F.col("_shift") + F.col("_row")).drop("_block", "_shift", "_row")


def runs(batches, keys: list[str]):
    """Runs of equal keys in a sorted stream of Arrow batches, each as one table; only the open run is held."""
    import numpy as np
    import pyarrow as pa

    open_run = None
    for batch in batches:
        if not batch.num_rows:
            continue
        here = pa.Table.from_batches([batch])
        if open_run is not None:
            here = pa.concat_tables([open_run, here])
        change = np.zeros(here.num_rows - 1, bool)
        for key in keys:
            values = here[key].combine_chunks().to_numpy(zero_copy_only=False)
            change |= values[1:] != values[:-1]
        cuts = np.flatnonzero(change) + 1
        for low, high in zip(np.concatenate([[0], cuts]), cuts):
            yield here.slice(low, high - low)
        open_run = here.slice(int(cuts[-1]) if len(cuts) else 0)
    if open_run is not None:
        yield open_run


def whole_runs(batches, keys: list[str]):
    """A sorted stream of numeric Arrow batches as (columns, bounds): numpy arrays that hold whole runs of equal keys;
    run r is rows ``bounds[r]:bounds[r + 1]``. Only the open run is held over."""
    import numpy as np

    names, rest = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        columns = {k: batch[k].to_numpy() for k in names}
        if rest is not None:
            columns = {k: np.concatenate([rest[k], columns[k]]) for k in names}
        change = np.zeros(len(columns[names[0]]) - 1, bool)
        for key in keys:
            change |= columns[key][1:] != columns[key][:-1]
        bounds = np.concatenate([[0], np.flatnonzero(change) + 1])
        rest = {k: v[bounds[-1] :] for k, v in columns.items()}
        if len(bounds) > 1:
            yield columns, bounds
    if rest is not None:
        yield rest, np.array([0, len(rest[names[0]])])
