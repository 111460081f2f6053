"""N-gram Jaccard join on prefix trees.

Each text is its set of five-word shingles in one global order, rare shingles first. Texts that can be similar share a
shingle in a prefix of that order, which deals out the work. Similar candidates of a hub text are stored in a trie, common
shingles first; the hub walks it once, sharing overlaps along common paths, and leaves a subtree when the overlap so
far and the lengths that remain can no longer reach the threshold.

Only classes of equal sets are compared. A group that shares a shingle is first linked to a hub; what that leaves in
different components is compared block by block, so every link between components is tried, and no pairs of a group
that hangs together already are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.graph import components
from assay.llm.registry import query, table
from assay.llm.storage import partitions, runs, whole_runs, written
from assay.llm.words import mix, shingles, unspaced, window_starts, words_of

SHINGLE = 5
PERCENT = 75
# Counters for frequent shingles per task, and frequent shingles in all: they only order shingles, so any size is exact.
COUNTERS = 50_000
FREQUENT = 1 << 17
FREQUENT_FROM = 16
SALTS = 64
TRIE_ROWS = 256
BLOCK_ROWS = 512
# Bits of the parity sketch of a set: the second for sets of more shingles than the first has bits.
SKETCH_BITS = (1024, 8192)
FILTER_BITS = 26
ROUNDS, HUBS = 2, 8


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, and the offsets of the rows.

    A row of fewer than five words, but not none, has its whole sequence as its one shingle.
    """
    words = words_of(column, unspaced())
    counts = words.counts()
    at, values = [], []
    starts = window_starts(words.offsets, SHINGLE)
    at.append(starts)
    values.append(shingles(words.hash, SHINGLE)[starts])
    for k in range(1, SHINGLE):
        short = words.offsets[:-1][counts == k]
        at.append(short)
        values.append(shingles(words.hash, k)[short])
    at, values = np.concatenate(at), np.concatenate(values)
    row = np.searchsorted(words.offsets, at, "right") - 1
    order = np.argsort(row, kind="stable")
    row, values = row[order], values[order]
    ends = np.searchsorted(row, np.arange(len(column) + 1))
    sets = [np.unique(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    offsets = np.zeros(len(column) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), offsets


def digests(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums that name each set."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values ^ np.uint64(salt)), out=sums[1:])
        out.append(mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64))
    return out


class Frequent:
    """The most frequent keys of a stream in bounded memory: counters, lowered together when they are too many."""

    def __init__(self, size: int):
        self.size, self.keys, self.counts = size, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []

    def add(self, values: np.ndarray) -> None:
        self.waiting.append(values)
        if sum(map(len, self.waiting)) > 20 * self.size:
            self.merge()

    def merge(self) -> None:
        keys, counts = np.unique(np.concatenate([*self.waiting, np.zeros(0, np.uint64)]), return_counts=True)
        self.waiting = []
        merged, place = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        total = np.bincount(place, np.concatenate([self.counts, counts]), len(merged)).astype(np.int64)
        if len(merged) > self.size:
            total -= np.partition(total, len(total) - self.size - 1)[len(total) - self.size - 1]
        self.keys, self.counts = merged[total > 0], total[total > 0]


def parity_sketch(values: np.ndarray) -> bytes:
    """A bit for each residue of the hashes: whether an odd number of them falls there."""
    size = SKETCH_BITS[len(values) > SKETCH_BITS[0]]
    bits = (values & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(bits, minlength=size) & 1).astype(bool)).tobytes()


def fold(sketch: bytes) -> np.ndarray:
    """A parity sketch in the smaller size, as 64-bit words."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, SKETCH_BITS[0] // 64))


class Sketches:
    """Parity sketches of a batch: all of them folded to the smaller size, and the larger ones as they are."""

    def __init__(self, column: pa.Array):
        parts = column.to_pylist()
        self.large = np.array([len(p) * 8 > SKETCH_BITS[0] for p in parts], bool)
        self.folded = np.array([fold(p) for p in parts], np.uint64).reshape(-1, SKETCH_BITS[0] // 64)
        self.place = np.cumsum(self.large) - 1
        whole = b"".join(p for p, large in zip(parts, self.large) if large)
        self.whole = np.frombuffer(whole, np.uint64).reshape(-1, SKETCH_BITS[1] // 64)

    def apart(self, i: np.ndarray, other: "Sketches", j: np.ndarray) -> np.ndarray:
        """Shingles that differ at least between set i[k] and the other set j[k]: the bits in which sketches differ."""
        out = np.bitwise_count(self.folded[i] ^ other.folded[j]).sum(1).astype(np.int64)
        both = self.large[i] & other.large[j]
        if both.any():
            a, b = self.whole[self.place[i[both]]], other.whole[other.place[j[both]]]
            out[both] = np.bitwise_count(a ^ b).sum(1)
        return out


def _profile(batches):
    frequent = Frequent(COUNTERS)
    names = ["doc_id", "n", "c1", "c2", "sketch", "token", "count"]
    for batch in batches:
        values, offsets = shingle_sets(batch["text"])
        c1, c2 = digests(values, offsets)
        sketch = [parity_sketch(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        frequent.add(values)
        size = batch.num_rows
        none = pa.nulls(size, pa.int64())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(offsets)), pa.array(c1), pa.array(c2), pa.array(sketch, pa.binary()), none, none], names=names)
    frequent.merge()
    keep = frequent.counts > 1
    size = int(keep.sum())
    none = pa.nulls(size, pa.int64())
    yield pa.RecordBatch.from_arrays(
        [none, none, none, none, pa.nulls(size, pa.binary()), pa.array(frequent.keys[keep].view(np.int64)), pa.array(frequent.counts[keep])], names=names
    )


def _prefixes(frequent):
    def run(batches):
        # Frequent shingles by hash, and the place of each in the order of ascending counts.
        common, place = frequent.value
        seen: set[int] = set()
        for batch in batches:
            values, offsets = shingle_sets(batch["text"])
            c1 = digests(values, offsets)[0]
            at = np.minimum(np.searchsorted(common, values), max(len(common) - 1, 0))
            is_common = common[at] == values if len(common) else np.zeros(len(values), bool)
            tokens, owner, salts = [], [], []
            for i in range(batch.num_rows):
                a, b = offsets[i], offsets[i + 1]
                if a == b or int(c1[i]) in seen:
                    continue
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(int(c1[i]))
                n = int(b - a)
                size = n - -(-PERCENT * n // 100) + 1
                rare = values[a:b][~is_common[a:b]][:size]
                tokens.append(rare)
                salts.append(np.zeros(len(rare), np.int32))
                if len(rare) < size:
                    late = values[a:b][is_common[a:b]]
                    late = late[np.argsort(place[at[a:b][is_common[a:b]]])][: size - len(rare)]
                    tokens.append(late)
                    salts.append(np.full(len(late), 1 + int(c1[i]) % SALTS, np.int32))
                owner.append(np.full(size, i))
            if owner:
                owner = np.concatenate(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(salts)), pa.array(c1[owner])], names=["token", "salt", "c1"]
                )

    return run


def _hubs(batches):
    """Rows of shingles that several classes share: (grp, salt, c1, hub), the hub being the first class of the run.

    Sorted input. Repeated rows go. ``grp`` names the shingle by its holders, so the shingles of a passage make one group;
    a frequent shingle, dealt out by salts, keeps its own name, and its rows even where a salt has one class.
    """
    for columns, bounds in whole_runs(batches, ["token", "salt"]):
        token, salt, c1 = (columns[k][: bounds[-1]] for k in ("token", "salt", "c1"))
        starts, sizes = bounds[:-1], np.diff(bounds)
        fresh = np.ones(len(c1), bool)
        fresh[1:] = c1[1:] != c1[:-1]
        fresh[starts] = True
        holders = np.add.reduceat(np.where(fresh, mix(c1.view(np.uint64)), np.uint64(0)), starts)
        shared = np.repeat(np.add.reduceat(fresh.astype(np.int64), starts) > 1, sizes)
        keep = fresh & (shared | (salt > 0))
        grp = np.where(salt > 0, token, np.repeat(mix(holders).view(np.int64), sizes))
        hub = np.repeat(c1[starts], sizes)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (grp, salt, c1, hub)], names=["grp", "salt", "c1", "hub"])


def with_ids(bits, wanted: bool = True, key: str = "doc_id"):
    """Batches less the rows whose key cannot be among the ids of ``id_filter``; or only those, not ``wanted``."""

    def run(batches):
        known = bits.value
        for batch in batches:
            place = mix(batch[key].cast(pa.int64()).fill_null(-1).to_numpy().view(np.uint64)) >> np.uint64(64 - FILTER_BITS)
            kept = (known[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            yield batch.filter(pa.array(kept == wanted))

    return run


def _filter_cells(batches):
    for batch in batches:
        place = mix(batch["id"].to_numpy().view(np.uint64)) >> np.uint64(64 - FILTER_BITS)
        cells, where = np.unique(place >> np.uint64(6), return_inverse=True)
        bits = np.zeros(len(cells), np.uint64)
        np.bitwise_or.at(bits, where, np.uint64(1) << (place & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(bits.view(np.int64))], names=["cell", "bits"])


def rows_with_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose key may be in ``ids`` (id): the first half of ``parted_by_ids``."""
    return parted_by_ids(df, ids, key)[0]


def parted_by_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose key may be in ``ids`` (id), and the others, by a filter of fixed size that lets no wanted
    row go.

    It spares most rows the shuffle of the join that follows; 8 MB at any size of ``ids``.
    """
    bits = id_filter(ids)
    may, others = (df.mapInArrow(with_ids(bits, wanted, key), df.schema) for wanted in (True, False))
    return may, others


def made_with_ids(df: DataFrame, ids: DataFrame, make, schema: str, key: str = "doc_id") -> DataFrame:
    """What ``make`` makes of the batches of ``rows_with_ids``, without another way from and to Python."""
    known = with_ids(id_filter(ids), True, key)
    return df.mapInArrow(lambda batches: make(known(batches)), schema)


def id_filter(ids: DataFrame):
    cells = ids.select(F.col("id").cast("long")).where("id IS NOT NULL").mapInArrow(_filter_cells, "cell int, bits long")
    found = cells.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    known = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    known[found["cell"].to_numpy()] = found["bits"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(known.view(np.uint64))


def similar_in_trie(hub: np.ndarray, others: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Indexes of ``others`` whose Jaccard similarity with ``hub`` reaches ``percent``; all are sorted distinct hashes."""
    pool, where, counts = np.unique(np.concatenate(others), return_inverse=True, return_counts=True)
    # Common shingles first: their place in the order of the trie.
    order = np.lexsort((pool, -counts))
    place = np.empty(len(pool), np.int64)
    place[order] = np.arange(len(pool))
    in_hub = np.isin(pool[order], hub, assume_unique=True)
    ends = np.cumsum([len(o) for o in others])
    paths = [np.sort(place[where[e - len(o) : e]]) for o, e in zip(others, ends)]
    ranked = sorted(range(len(paths)), key=lambda i: paths[i].astype(">i8").tobytes())
    size, found = len(hub), []
    stack = [(0, len(ranked), 0, 0)]
    while stack:
        low, high, depth, overlap = stack.pop()
        first, last = paths[ranked[low]], paths[ranked[high - 1]]
        reach = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:reach] != last[depth:reach])
        upto = depth + int(differ[0]) if len(differ) else reach
        overlap += int(in_hub[first[depth:upto]].sum())
        lengths = [len(paths[ranked[i]]) for i in range(low, high)]
        best = overlap + min(max(lengths) - upto, size - overlap)
        if (100 + percent) * best < percent * (size + min(lengths)):
            continue
        i = low
        while i < high and len(paths[ranked[i]]) == upto:
            if (100 + percent) * overlap >= percent * (size + upto):
                found.append(ranked[i])
            i += 1
        while i < high:
            branch, j = paths[ranked[i]][upto], i + 1
            while j < high and paths[ranked[j]][upto] == branch:
                j += 1
            stack.append((i, j, upto, overlap))
            i = j
    return found


def _verify(batches):
    for run in runs(batches, ["hub", "salt"]):
        ids = run["doc_id"].to_numpy()
        # Equal ids come once: a class may have reached this group from several tasks.
        _, first = np.unique(ids, return_index=True)
        run, ids = run.take(pa.array(first)), ids[first]
        values, offsets = shingle_sets(run["text"].combine_chunks())
        hub = run["hub"][0].as_py()
        sets = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        others = [i for i in range(len(ids)) if ids[i] != hub and len(sets[i])]
        at = np.flatnonzero(ids == hub)
        if len(others) and len(at):
            linked = [int(ids[others[i]]) for i in similar_in_trie(sets[at[0]], [sets[i] for i in others])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(linked), hub, np.int64)), pa.array(linked, pa.int64())], names=["a", "b"])


def verified_links(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar. Candidates of one hub meet in tries of at most a few hundred texts."""
    spark = pairs.sparkSession
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / TRIE_ROWS).cast("int").alias("salts"))
    others = pairs.join(sizes, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("id"))
    hubs = sizes.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("id"))
    members = written(others.union(hubs), "trie-members")
    texts = rows_with_ids(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), members.select("id"))
    rows = members.join(texts, members["id"] == texts["doc_id"]).select("hub", "salt", "doc_id", "text")
    dealt = rows.repartition(partitions(spark), "hub", "salt").sortWithinPartitions("hub", "salt")
    return dealt.mapInArrow(_verify, "a long, b long")


def required(both):
    """Shingles that two sets of ``both`` shingles together must share to be similar."""
    return -(-PERCENT * both // (100 + PERCENT))


def least_shared(n, m):
    """Prefix shingles that two similar sets of n and m shingles share at least.

    The prefix that ends first in the global order lies, as far as the other set has it, in the other's prefix; of its
    shingles at most n - required are not in the other set.
    """
    need = required(n + m)
    prefix = lambda k: k - -(-PERCENT * k // 100) + 1
    return np.maximum(1, np.minimum(prefix(n) - (n - need), prefix(m) - (m - need)))


def _compare_blocks(batches):
    found, size = [], 0
    pack = lambda parts: pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=["a", "b", "least", "weight"])
    for run in runs(batches, ["grp", "i", "j"]):
        part, rep, comp, n = (run[k].to_numpy() for k in ("part", "rep", "comp", "n"))
        sketch = Sketches(run["sketch"].combine_chunks())
        i, j, weight = run["i"][0].as_py(), run["j"][0].as_py(), run["weight"][0].as_py()
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        for x in left:
            ys = right[right > x] if i == j else right
            ys = ys[(comp[ys] != comp[x]) & (n[ys] * 100 >= n[x] * PERCENT) & (n[x] * 100 >= n[ys] * PERCENT)]
            if not len(ys):
                continue
            apart = sketch.apart(np.full(len(ys), x), sketch, ys)
            both = n[ys] + n[x]
            ys = ys[apart <= both - 2 * required(both)]
            found.append((np.minimum(rep[ys], rep[x]), np.maximum(rep[ys], rep[x]), least_shared(n[ys], n[x]), np.full(len(ys), weight)))
            size += len(ys)
            if size >= 50_000 or len(found) >= 10_000:
                yield pack(found)
                found, size = [], 0
    if found:
        yield pack(found)


def classes_of_similar(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their set (``doc_id``, ``n``, ``c1``, ``c2``), and sets with their class (``c1``, ``c2``, ``component``).

    ``documents`` needs (doc_id, text). Rows with an empty or null text have an empty set and no class.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = written(docs.mapInArrow(_profile, "doc_id long, n long, c1 long, c2 long, sketch binary, token long, count long"), "shingle-profile")
    counted = profile.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= FREQUENT_FROM)
    frequent = counted.orderBy(F.desc("count"), "token").limit(FREQUENT).toArrow()
    tokens = frequent["token"].to_numpy().view(np.uint64)
    by_hash = np.argsort(tokens)
    place = np.arange(len(tokens))[::-1][by_hash]
    sets = profile.where("token IS NULL AND n > 0 AND doc_id IS NOT NULL")
    reps = written(sets.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sets")
    prefixes = docs.mapInArrow(_prefixes(spark.sparkContext.broadcast((tokens[by_hash], place))), "token long, salt int, c1 long")
    dealt = prefixes.repartition(partitions(spark), "token", "salt").sortWithinPartitions("token", "salt", "c1")
    shared = written(dealt.mapInArrow(_hubs, "grp long, salt int, c1 long, hub long"), "shared-shingles")

    # Star links: to the hub of the shingle, and from the hubs of a frequent shingle's salts to the least of them.
    stars = shared.where("c1 <> hub").groupBy("c1", "hub").agg(F.count("*").alias("shared"))
    salted = shared.where("salt > 0").select("grp", "hub").distinct()
    tops = written(salted.groupBy("grp").agg(F.min("hub").alias("top")), "top-hubs")
    stars = stars.union(salted.join(tops, "grp").where("hub <> top").select("hub", "top").distinct().withColumn("shared", F.lit(None).cast("long")))
    names = reps.select("c1", "rep")
    stars = stars.join(names, "c1").join(names.toDF("hub", "hub_rep"), "hub").select(F.col("hub_rep").alias("a"), F.col("rep").alias("b"), "shared")
    links = written(verified_links(written(_near_pairs(stars, reps), "pairs"), docs), "similar")
    found = written(components(links), "components")

    # The holders of each group of shingles, and how many shingles it stands for.
    held = written(shared.groupBy("grp", "c1").agg(F.count("*").alias("weight")), "holders")
    held = written(_with_component(held.join(names, "c1").drop("c1"), found), "holders")

    # Groups whose holders are in several components meet a few other hubs in each round, the same ones wherever it can
    # be, so that near copies come together by a few tries each.
    for turn in range(ROUNDS):
        drawn = [F.min_by(F.struct("rep", "comp"), F.xxhash64("rep", F.lit(turn * HUBS + k))).alias(f"hub{k}") for k in range(HUBS)]
        held = written(held.join(_mixed(held).select("grp"), "grp", "left_semi"), "holders")
        hubs = held.groupBy("grp").agg(*drawn).select("grp", F.inline(F.array_distinct(F.array(*[f"hub{k}" for k in range(HUBS)]))))
        hubs = written(hubs.toDF("grp", "hub", "hub_comp"), "hubs")
        met = held.join(hubs, "grp").where(F.col("comp") != F.col("hub_comp"))
        stars = met.groupBy(F.col("hub").alias("a"), F.col("rep").alias("b")).agg(F.sum("weight").alias("shared"))
        pairs = written(_near_pairs(stars, reps), "pairs")
        found = _joined(found, written(verified_links(pairs, docs), "similar"))
        held = written(_with_component(held.drop("comp"), found), "holders")

    # What is still in different components is compared across components, block by block.
    mixed = written(_mixed(held).select("grp", F.ceil(F.col("size") / BLOCK_ROWS).cast("int").alias("parts")), "mixed")
    rows = held.join(mixed, "grp").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    rows = rows.join(reps.select("rep", "n", "sketch"), "rep")
    blocks = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = blocks.select("grp", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "comp", "n", "sketch", "weight")
    dealt = blocks.repartition(partitions(spark), "grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    tried = dealt.mapInArrow(_compare_blocks, "a long, b long, least long, weight long").groupBy("a", "b", "least").agg(F.sum("weight").alias("shared"))
    rest = written(tried.where("shared >= least").select("a", "b"), "pairs")
    more = written(verified_links(rest, docs), "similar")
    found = _joined(found, more)
    classed = reps.join(found, reps["rep"] == found["node"], "left").select("c1", "c2", F.coalesce("component", "rep").alias("component"))
    return profile.where("token IS NULL").select("doc_id", "n", "c1", "c2"), classed


def _mixed(held: DataFrame) -> DataFrame:
    """Groups whose holders are in several components, and their sizes."""
    return held.groupBy("grp").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low <> high")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: those known so far are stars of links themselves."""
    return written(components(links.select("a", "b").union(found.select("node", "component"))), "components")


def _with_component(held: DataFrame, found: DataFrame) -> DataFrame:
    return held.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")


def _near_pairs(stars: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow to be similar.

    The large sketches of long texts travel only for pairs that share a quarter of what similar sets must. ``shared``
    counts the shingles at which b met this hub, null where it is not known; a hub is not met at all that two sets share,
    so similar pairs may be left out here: the blocks compare them, with all that they share.
    """
    sizes = reps.select("rep", "n")
    sized = stars.where("a <> b").join(sizes.toDF("a", "xn"), "a").join(sizes.toDF("b", "yn"), "b")
    alike = F.least("xn", "yn") * 100 >= F.greatest("xn", "yn") * PERCENT
    both = F.col("xn") + F.col("yn")
    need = F.ceil(both * PERCENT / (100 + PERCENT))
    spare = lambda n: F.col(n) - F.ceil(F.col(n) * PERCENT / 100) + 1 - (F.col(n) - need)
    short = F.greatest("xn", "yn") <= SKETCH_BITS[0]
    often = short | F.col("shared").isNull() | (F.col("shared") * 4 >= F.least(spare("xn"), spare("yn")))
    sized = sized.where(alike & often).select("a", "b", "xn", "yn").distinct()
    sketches = reps.select("rep", "sketch")
    return sized.join(sketches.toDF("a", "xs"), "a").join(sketches.toDF("b", "ys"), "b").mapInArrow(_near, "a long, b long")


def _near(batches):
    for batch in batches:
        both = batch["xn"].to_numpy() + batch["yn"].to_numpy()
        rows = np.arange(batch.num_rows)
        apart = Sketches(batch["xs"]).apart(rows, Sketches(batch["ys"]), rows)
        keep = pa.array(apart <= both - 2 * required(both))
        yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])


def similarity_classes(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles, component_id.

    Null and empty texts have no shingles and are their own class; equal sets are linked; a row without doc_id takes
    the class of its set, and null where no row with a doc_id has that set. A doc_id is taken to name one text: where
    rows of several texts share one, any of these texts stands for it.
    """
    docs, classed = classes_of_similar(documents)
    joined = docs.join(classed, ["c1", "c2"], "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


@query(
    "op3_prefix_tree",
    """
    WITH RECURSIVE plain AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
        FROM plain, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS g(i) WHERE len(w) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sets a JOIN sets b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM shared JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * i >= 75 * (p.n + q.n - i)),
    reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.node)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id
    FROM reach JOIN (SELECT DISTINCT doc_id FROM documents) d ON d.doc_id = node LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
    """,
)
def op3_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"))


def _with_digests(batches):
    for batch in batches:
        c1, c2 = digests(*shingle_sets(batch["text"]))
        yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], pa.array(c1), pa.array(c2)], names=["row", "doc_id", "c1", "c2"])


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose doc_id is the smallest of its class, with all their columns.

    A row is judged by its doc_id and its text: where rows of different texts share a doc_id, only those whose text has an
    earlier copy go. A row without doc_id can't be named and stays, as do rows without shingles.
    """
    docs, classed = classes_of_similar(documents)
    sets = docs.where("n > 0 AND doc_id IS NOT NULL").distinct().join(classed, ["c1", "c2"])
    sets = written(sets.select("doc_id", "c1", "c2", (F.col("doc_id") != F.col("component")).alias("copy")), "copies")
    ids = sets.groupBy("doc_id").agg(F.bool_or("copy").alias("any"), F.bool_and("copy").alias("all"), F.count("*").alias("texts")).where("any")
    # Empty texts beside a copy make it a doc_id of several texts too.
    empty = docs.where("n = 0").select(F.col("doc_id").alias("_copy")).distinct().withColumn("_empty", F.lit(True))
    ids = ids.select(F.col("doc_id").alias("_copy"), "all").join(empty, "_copy", "left")
    ids = written(ids.select("_copy", (~F.col("all") | F.coalesce("_empty", F.lit(False))).alias("_several")), "copies")
    own = documents["doc_id"].cast("long") == ids["_copy"]
    kept = documents.join(ids, own, "left_anti")
    # Whole rows travel as one struct, so that no column of theirs can clash with these.
    several = documents.join(ids.where("_several"), own, "left_semi")
    rows = several.select(F.struct(*[several[f"`{c}`"] for c in documents.columns]).alias("row"), several["doc_id"].cast("long").alias("doc_id"), several["text"].alias("text"))
    kind = T.StructType([T.StructField("row", documents.schema), *[T.StructField(c, T.LongType()) for c in ("doc_id", "c1", "c2")]])
    single = rows.mapInArrow(_with_digests, kind).join(sets.where("copy"), ["doc_id", "c1", "c2"], "left_anti")
    return kept.unionByName(single.select([F.col("row").getField(c).alias(c) for c in documents.columns]))
