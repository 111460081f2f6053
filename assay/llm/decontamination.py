"""Benchmark decontamination by winnowing.

Every window of ten words is known by its fingerprint: the smallest hash of its k-grams. Equal windows choose equal
fingerprints, so a join of training and test fingerprints misses no shared span; a hit is extended by comparing the
words of the whole window. An item of fewer than ten words is one window of its own length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.registry import query, table
from assay.llm.storage import discard, written
from assay.llm.words import Words, alphanumeric, shingles, window_starts, words_of

GRAM = 5
# The filter that spares documents without test fingerprints the shuffle has 2**26 bits at any size of the benchmark.
FILTER_BITS = 26


def fingerprints(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``size`` words that lie in one row, and the smallest k-gram hash of each."""
    k = min(GRAM, size)
    starts = window_starts(words.offsets, size)
    grams = shingles(words.hash, k)
    least = grams[starts]
    for j in range(1, size - k + 1):
        least = np.minimum(least, grams[starts + j])
    return starts, least


def _item_windows(window: int):
    schema = pa.schema([("item_id", pa.int64()), ("size", pa.int32()), ("print", pa.int64()), ("words", pa.string())])

    def run(batches):
        for batch in batches:
            words = words_of(batch["text"], alphanumeric())
            counts, rows = words.counts(), words.rows()
            for size in np.unique(np.minimum(counts[counts > 0], window)):
                starts, least = fingerprints(words, int(size))
                whole = (counts[rows[starts]] == size) if size < window else np.ones(len(starts), bool)
                starts, least = starts[whole], least[whole]
                text = [words.text(i, i + size) for i in starts]
                ids = batch["item_id"].take(pa.array(rows[starts]))
                sizes = pa.array(np.full(len(starts), size, np.int32))
                yield pa.RecordBatch.from_arrays([ids, sizes, pa.array(least.view(np.int64)), pa.array(text, pa.string())], schema=schema)

    return run


def _candidates(sizes: list[int], bits):
    hit = pa.struct([("start", pa.int32()), ("size", pa.int32()), ("print", pa.int64()), ("words", pa.string())])

    def run(batches):
        known = bits.value
        for batch in batches:
            words = words_of(batch["text"], alphanumeric())
            found = []
            for size in sizes:
                starts, least = fingerprints(words, size)
                place = least >> np.uint64(64 - FILTER_BITS)
                kept = (known[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                found.append((starts[kept], np.full(kept.sum(), size, np.int32), least[kept]))
            starts, size, least = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            order = np.argsort(starts, kind="stable")
            starts, size, least = starts[order], size[order], least[order]
            row = np.searchsorted(words.offsets, starts, "right") - 1
            values = pa.StructArray.from_arrays(
                [
                    pa.array((starts - words.offsets[row]).astype(np.int32)),
                    pa.array(size.astype(np.int32)),
                    pa.array(least.view(np.int64)),
                    pa.array([words.text(i, i + n) for i, n in zip(starts, size)], pa.string()),
                ],
                fields=list(hit),
            )
            ends = np.searchsorted(starts, words.offsets).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch["_row"], batch["doc_id"], batch["text_hash"], pa.array(words.counts()), pa.ListArray.from_arrays(pa.array(ends), values)],
                names=["_row", "doc_id", "text_hash", "n_words", "candidates"],
            )

    return run


def shared_windows(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (``_row``, ``doc_id``, ``text_hash``, ``n_words``), their hits (``_row``, ``start``, ``size``, ``window_id``), and the
    items of each window (``window_id``, ``item_id``).

    ``documents`` needs (doc_id, text), ``benchmark`` (item_id, text); other columns are not read. ``_row`` tells rows
    apart that share a doc_id. Rows without text have no words; items without id or words have no windows.
    """
    spark = documents.sparkSession
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    windows = written(items.mapInArrow(_item_windows(window), "item_id long, size int, print long, words string").distinct(), "item-windows")
    distinct = windows.select("size", "print", "words").distinct()
    distinct = written(distinct.withColumn("window_id", F.monotonically_increasing_id()), "windows")
    place = F.shiftrightunsigned("print", 64 - FILTER_BITS)
    cells = distinct.groupBy(F.shiftright(place, 6).cast("int").alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(print, {64 - FILTER_BITS}) & 63 as int))")).alias("bits"))
    found = cells.toArrow()
    known = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    known[found["cell"].to_numpy()] = found["bits"].to_numpy()
    sizes = sorted(r[0] for r in distinct.select("size").distinct().collect())
    keyed = documents.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    schema = "_row long, doc_id long, text_hash long, n_words long, candidates array<struct<start:int,size:int,print:long,words:string>>"
    docs = written(keyed.mapInArrow(_candidates(sizes, spark.sparkContext.broadcast(known.view(np.uint64))), schema), "document-words")
    candidates = docs.select("_row", F.inline("candidates"))
    hits = candidates.join(distinct, ["print", "words", "size"]).select("_row", "start", "size", "window_id")
    holders = windows.join(distinct, ["print", "words", "size"]).select("window_id", "item_id")
    return docs.select("_row", "doc_id", "text_hash", "n_words"), hits, holders


def covered(spans) -> F.Column:
    """Positions inside any of the sorted (start, end) spans."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    fold = lambda a, s: F.struct(
        F.greatest(a["upto"], s["end"]).alias("upto"),
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["start"]))).alias("n"),
    )
    return F.aggregate(spans, zero, fold, lambda a: a["n"])


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, text_hash.

    ``text_hash`` is xxhash64 of the text. ``spans`` lists the (start, end) word positions of every hit window. Documents that hit the same windows form one
    class; the items of a class are gathered once. Without text, words or hits: zeros, the digest of the empty string,
    no spans. Repeated rows are judged one by one.
    """
    docs, hits, holders = shared_windows(documents, benchmark, window)
    spans = F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    # The set of hit windows, sorted, names the class.
    per_doc = written(
        hits.groupBy("_row").agg(spans.alias("spans"), F.sort_array(F.collect_set("window_id")).alias("windows")).withColumn("class", F.md5(F.to_json("windows"))),
        "document-hits",
    )
    classes = per_doc.groupBy("class").agg(F.first("windows").alias("windows"))
    members = classes.select("class", F.explode("windows").alias("window_id")).join(holders, "window_id")
    named = F.sort_array(F.collect_set(F.col("item_id").cast("string")))
    reports = members.groupBy("class").agg(named.alias("items")).select("class", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    reported = per_doc.join(reports, "class").select("_row", covered(F.col("spans")).alias("n_hit"), "n_items", "items_sha256", "spans")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return docs.join(reported, "_row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        "text_hash",
    )


@query(
    "op1_winnowing",
    """
    WITH plain AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    item_windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS size,
            array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS words
        FROM items, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s(i) WHERE len(w) > 0),
    doc_windows AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS words
        FROM plain, (SELECT DISTINCT size FROM item_windows), unnest(generate_series(1, len(w) - size + 1)) AS s(i)
        WHERE len(w) >= size),
    hits AS (SELECT d.doc_id, d.i, d.size, t.item_id FROM doc_windows d JOIN item_windows t USING (size, words)),
    places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(generate_series(i, i + size - 1)) AS s(p) GROUP BY doc_id),
    found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
            sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM hits GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM plain LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
)
def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "text_hash")


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``documents`` that hold no window of the benchmark, with all their columns.

    A row is known by its doc_id, null or not, and its text.
    """
    dirty = contamination(documents, benchmark, window).where("contaminated").select("doc_id", "text_hash").distinct()
    same = documents["doc_id"].cast("long").eqNullSafe(dirty["doc_id"]) & (F.xxhash64(documents["text"]) == dirty["text_hash"])
    return documents.join(dirty, same, "left_anti")
