"""Fingerprints of documents by consistent weighted sampling, in DataFrame functions only.

Every (term, sample) has its own gamma variates r and c and a uniform shift b, from hashes of the term. A term of weight w is
rounded down to y = exp(r * (floor(ln w / r + b) - b)), the same for all weights between two such values, and the sample of a
weighted set is the term with the least c / (y * exp(r)). Two sets have the same sample with the probability of their
generalised Jaccard similarity, the sum of the smaller weights by the sum of the larger ones. The least value tells the
sampled (term, y) apart from any other, so that minima, which merge from partial ones, are all that is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assay.llm.registry import query, table
from assay.llm.storage import partitions

SAMPLES = 48
AT_ONCE = 8  # samples that one row of the sampling computes
HEX = 4  # digits of a fingerprint for each sample: different samples look alike once in 65,536
SPACE = r"[\x20\x09-\x0D]"


def _unit(bits: Column, shift: int) -> Column:
    """32 bits as a number between 0 and 1, neither of them."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(0xFFFFFFFF).cast("double") + 0.5) * 2.0**-32


def sampled_value(term: Column, sample: Column, log_weight: Column) -> Column:
    """The value of a weighted term in a sample, c / (y * exp(r)); the least one of a set is its sample.

    It is computed from the step alone, not from the weight, so that weights of one step give the very same number.
    """
    first = F.xxhash64(term, sample)
    second = F.xxhash64(first)
    r = -F.log(_unit(first, 0) * _unit(first, 32))  # the sum of two exponential variates is Gamma(2, 1)
    c = -F.log(_unit(second, 0) * _unit(second, 32))
    b = _unit(F.xxhash64(second), 0)
    step = F.floor(log_weight / r + b).cast("double")
    return c * F.exp(-r * (step - b + 1))


def sampled_minima(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """The samples of each set of ``terms`` (``keys``, term long, weight double above 0, each term once in its set).

    A row for every ``AT_ONCE`` samples: keys, ``block``, ``m0``, ``m1``, ... A set without terms has no row.
    """
    if samples % AT_ONCE:
        raise ValueError(f"samples must be a multiple of {AT_ONCE}")
    rows = terms.select(*keys, "term", F.log("weight").alias("log_weight"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(samples // AT_ONCE - 1))))
    values = [sampled_value(F.col("term"), F.col("block") * AT_ONCE + k, F.col("log_weight")) for k in range(AT_ONCE)]
    return rows.groupBy(*keys, "block").agg(*[F.min(v).alias(f"m{k}") for k, v in enumerate(values)])


def _digits(minima: list[Column]) -> Column:
    """Fingerprint digits of samples; null where the set has no terms."""
    digits = [F.right(F.lpad(F.hex(F.xxhash64(m)), F.lit(16), F.lit("0")), F.lit(HEX)) for m in minima]
    return F.when(minima[0].isNotNull(), F.concat(*digits))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples that two fingerprints have in common; two of nothing are alike, one of nothing is like no other."""
    same = F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.substring(a, i * HEX + 1, F.lit(HEX)) == F.substring(b, i * HEX + 1, F.lit(HEX)))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(F.size(same) / F.lit(float(samples)))


def in_rings(documents: DataFrame) -> DataFrame:
    """Documents in ascending order of doc_id (nulls first, equal ones by a hash of the text), each with the text after it.

    Columns: part, row, guest, doc_id, text, next_text. Ids are cut into parts at their approximate quantiles, so that any part
    is a window of its own; the first document of the next part (for the last: of the first) stands at its end as a guest.
    Only a few ids per part reach the driver.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = 4 * partitions(spark)  # several parts to a task, so that tasks get about as much
    cuts = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0]
    cuts = sorted(set(cuts or []))
    part = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c <= F.col("doc_id"))), F.lit(0)) if cuts else F.lit(0)
    part = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(part)
    starts = docs.groupBy(part.alias("part")).agg(F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).orderBy("part").collect()
    first = [None] * (len(cuts) + 1)
    before = [0] * (len(cuts) + 1)
    for k, s in enumerate(starts):
        first[s.part] = None if s.nulls else s["first"]
        before[s.part] = starts[k - 1].part
    at = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("part"))
    home = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    # Never null, and known to be: else a join by part filters one of its sides, which then needs an exchange of its own.
    visit = F.struct(F.coalesce(at(before, "int"), F.lit(0)).alias("part"), F.lit(True).alias("guest"))
    seats = F.when(F.col("doc_id").eqNullSafe(at(first, "bigint")), F.array(home, visit)).otherwise(F.array(home))
    seated = docs.withColumn("part", part).withColumn("seat", F.explode(seats)).select("seat.part", "seat.guest", "doc_id", "text")
    # As many tasks as parts, which AQE leaves as they are: a task holds the words of few texts.
    seated = seated.repartition(n, "part")
    order = Window.partitionBy("part").orderBy("guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return seated.select("part", F.row_number().over(order).alias("row"), "guest", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def edited_text(text: Column, next_text: Column) -> Column:
    """The text with its last quarter of code points replaced by the first as many of the next text."""
    cut = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(F.coalesce(next_text, F.lit("")), F.lit(1), cut))


def _terms(rings: DataFrame) -> DataFrame:
    """Weighted terms of every text and of its edited text: part, row, side (0 both, 1 the text's, 2 the edited text's).

    A term is a word, its weight the number of code points that it takes up. Words before the edit are split once.
    """
    size = F.length("text")
    head = F.substring(F.col("text"), F.lit(1), size - F.floor(size / 4).cast("int"))
    # Whole words of the part that stays: up to its last white space.
    shared = F.regexp_extract(head, rf"(?s)^(.*{SPACE})", 1)
    rest = lambda c: F.substring(c, F.length("shared") + 1, F.length(c))
    texts = rings.select("part", "row", "text", edited_text(F.col("text"), F.col("next_text")).alias("edited"), shared.alias("shared"))
    sides = enumerate([F.col("shared"), rest(F.col("text")), rest(F.col("edited"))])
    pieces = F.array(*[F.struct(F.lit(side).alias("side"), piece.alias("piece")) for side, piece in sides])
    words = texts.select("part", "row", F.explode(pieces).alias("p")).select("part", "row", "p.side", F.explode(F.split("p.piece", f"{SPACE}+")).alias("word"))
    words = words.where("word <> ''").select("part", "row", "side", F.xxhash64("word").alias("term"), F.length("word").cast("long").alias("size"))
    in_side = lambda other: F.coalesce(F.sum(F.when(F.col("side") != other, F.col("size"))), F.lit(0))
    sums = words.groupBy("part", "row", "term").agg(in_side(2).alias("one"), in_side(1).alias("two"))
    side = lambda n, c: F.struct(F.lit(n).alias("side"), F.col(c).cast("double").alias("weight"))
    sides = F.when(F.col("one") == F.col("two"), F.array(side(0, "one"))).otherwise(F.array(side(1, "one"), side(2, "two")))
    return sums.select("part", "row", "term", F.explode(sides).alias("s")).select("part", "row", "term", "s.side", "s.weight").where("weight > 0")


def edited_fingerprints(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A fingerprint has four digits for each sample and is empty for a text without words. Null texts are empty ones; rows
    that share a doc_id follow each other, so the next of a repeated row may be its copy; a single row follows itself; an
    empty table gives an empty result. Other columns are not looked at. A text is a row, whatever its length; the texts
    are exchanged once by the part of their id, and everything after that is grouped inside the part.
    """
    rings = in_rings(documents)
    keys = ["part", "row"]
    minima = sampled_minima(_terms(rings), [*keys, "side"], samples)
    merged = lambda other: [F.min(F.when(F.col("side") != other, F.col(f"m{k}"))).alias(f"m{k}") for k in range(AT_ONCE)]
    both = minima.groupBy(*keys, "block").agg(*[c.alias(f"a{k}") for k, c in enumerate(merged(2))], *[c.alias(f"b{k}") for k, c in enumerate(merged(1))])
    digits = both.select(*keys, "block", *[_digits([F.col(f"{s}{k}") for k in range(AT_ONCE)]).alias(s) for s in "ab"])
    joined = lambda c: F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("block", c))), lambda x: x[c])).alias(c)
    # Not written before the join: its two sides then read one exchange of the texts.
    prints = digits.groupBy(*keys).agg(joined("a"), joined("b"))
    plain = rings.select(*keys, "guest", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(edited_text(F.col("text"), F.col("next_text")), 256).alias("edited_sha256"))
    named = plain.join(prints, keys, "left").withColumns({"a": F.coalesce("a", F.lit("")), "b": F.coalesce("b", F.lit(""))})
    after = F.lead("a").over(Window.partitionBy("part").orderBy("row"))
    return named.withColumn("c", after).where("NOT guest").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("a").alias("fingerprint"),
        F.col("b").alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b"), samples).alias("near_edited"),
        likeness(F.col("a"), F.col("c"), samples).alias("near_next"),
    )


@query("op11_weighted_sampling")
def op11_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
