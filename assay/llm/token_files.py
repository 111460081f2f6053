"""Token ids in files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A document's ids are replaced by their rank in the corpus (0: most frequent). A rank takes one to four bytes, little
end first; its length less one is a two-bit code, four to a control byte, kept apart from the data bytes so that
decoding is a table lookup over all control bytes at once. Texts are cut where the tokenizer splits in any case, and a
piece that was met before is not encoded again. A file is Parquet, written by Spark to any store: a row for
each document in ascending doc_id order, with its place, its control and its data bytes. A table of the ids by rank goes
with it.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assay.llm.registry import query, table
from assay.llm.storage import discard, partitions, written
from assay.session import scratch_path

END = 0  # id that ends each document
CHUNK = 1 << 18  # characters encoded at a time
PIECES = 1 << 24  # bytes of texts whose pieces are looked up at a time
KNOWN = 1 << 25  # bytes of pieces that a worker remembers
JOINED = 64  # pieces that are encoded as one string

#: Of each byte: an ASCII letter, a blank or line feed, a sign (no apostrophe, which may open a contraction), the first byte of
#: a character that is surely no white space.
LETTER, GAP, SIGN, SOLID = 1, 2, 4, 8
KIND = np.zeros(256, np.uint8)
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] |= LETTER
KIND[[0x0A, 0x20]] |= GAP
KIND[[c for c in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] |= SIGN
KIND[[*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xEE), *range(0xF0, 0xF5)]] |= SOLID


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether GPT-2's byte-level rule splits UTF-8 before these bytes, and the one beyond, whatever stands around: before the
    last blank or line feed ahead of other characters, and between a letter (ASCII, Latin-1) and a sign."""
    kind = KIND[data]
    letter = kind & LETTER > 0
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut = np.zeros(len(data) + 1, bool)
    cut[: max(len(data) - 1, 0)] = (kind[:-1] & GAP > 0) & (kind[1:] & SOLID > 0)
    cut[1:-1] |= letter[:-1] & (kind[1:] & SIGN > 0)
    return cut


def spans(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of strings or of binary values."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def binary(offsets: np.ndarray, data) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


class Encoder:
    """Ids of whole texts by a tokenizer file, on one thread: Spark's tasks are the parallelism."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.width = "<u2" if self.size <= 1 << 16 else "<u4"
        rules = json.loads(self.tokenizer.to_str())
        splits, model = rules["pre_tokenizer"] or {}, rules["model"]
        #: Whether texts may be cut: only a plain byte-level BPE splits as ``cuts`` says.
        self.cuttable = (
            (splits.get("type"), splits.get("use_regex"), splits.get("add_prefix_space")) == ("ByteLevel", True, False)
            and (model["type"], model.get("dropout") or None, rules["normalizer"], rules["truncation"], rules["padding"]) == ("BPE", None, None, None, None)
        )
        self.added = [t["content"] for t in rules["added_tokens"]]
        #: Bytes that an id stands for: a character of its token each.
        self.bytes = np.zeros(self.size, np.int64)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes[number] = len(token)
        self.forget()

    def forget(self) -> None:
        self.known, self.values = (pa.array([], pa.binary()) for _ in range(2))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of the texts."""
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
        return np.concatenate([*ids, np.zeros(0, np.uint32)]), offsets

    def encode_in_chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, low = [], 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) <= CHUNK):
                size += len(texts[high])
                high += 1
            parts.append(self.encode(texts[low:high]))
            low = high
        counts = np.concatenate([np.diff(o) for _, o in parts] or [np.zeros(0, np.int64)])
        return np.concatenate([*(i for i, _ in parts), np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum(counts)])

    def whole(self, texts: pa.Array) -> pa.Array:
        """The ids of each text as bytes."""
        ids, offsets = self.encode_in_chunks(texts.to_pylist())
        data = ids.astype(self.width)
        return binary(offsets * data.itemsize, data)

    def encode_rows(self, texts: pa.Array) -> pa.Array:
        """The same, with pieces that are known looked up; texts that hold an added token are encoded whole."""
        if not self.cuttable or texts.nbytes > 1 << 30:
            return self.whole(texts)
        special = functools.reduce(pc.or_, [pc.match_substring(texts, t) for t in self.added], pa.array(np.zeros(len(texts), bool)))
        if pc.any(special).as_py():
            rows = self.encode_rows_of_pieces(pc.if_else(special, "", texts))
            return self.whole(texts) if rows is None else pc.replace_with_mask(rows, special, self.whole(texts.filter(special)))
        rows = self.encode_rows_of_pieces(texts)
        return self.whole(texts) if rows is None else rows

    def encode_rows_of_pieces(self, texts: pa.Array) -> pa.Array | None:
        if self.known.nbytes > KNOWN:
            self.forget()
        offsets, data = spans(texts)
        cut = cuts(data)
        # What follows a text does not split it.
        last = offsets[1:][np.diff(offsets) > 0] - 1
        cut[last[KIND[data[last]] & GAP > 0]] = False
        cut[offsets] = True
        at = np.flatnonzero(cut)
        pieces = binary(at, data) if len(data) else pa.array([], pa.binary())
        had = len(self.known)
        numbered = pa.concat_arrays([self.known, pieces]).dictionary_encode()
        new = self._encode_pieces(numbered.dictionary.slice(had))
        if new is None:
            self.cuttable = False
            return None
        self.known, self.values = numbered.dictionary, pa.concat_arrays([self.values, new])
        ends, ids = spans(self.values.take(numbered.indices.slice(had)))
        return binary(ends[np.searchsorted(at, offsets)], np.ascontiguousarray(ids))

    def _encode_pieces(self, pieces: pa.Array) -> pa.Array | None:
        """Pieces that open with a gap ahead of something are encoded many in one string, as a cut is there in any case; the
        bytes that ids stand for tell which are whose. None if they don't."""
        if not len(pieces):
            return pieces
        offsets, data = spans(pieces)
        second = data[np.minimum(offsets[:-1] + 1, len(data) - 1)]
        joins = (KIND[data[offsets[:-1]]] & GAP > 0) & (np.diff(offsets) > 1) & (KIND[second] & SOLID > 0)
        order = np.argsort(~joins, kind="stable")
        n = int(joins.sum())
        offsets, data = spans(pieces.take(pa.array(order)))
        bounds = offsets[np.concatenate([np.arange(0, n, JOINED), np.arange(n, len(pieces) + 1)])].tolist()
        text = data.tobytes()
        ids, _ = self.encode_in_chunks([text[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:])])
        upto = np.concatenate([[0], np.cumsum(self.bytes[ids])])
        at = np.searchsorted(upto, offsets)
        if upto[-1] != offsets[-1] or (upto[at] != offsets).any():
            return None
        values = ids.astype(self.width)
        return binary(at * values.itemsize, values).take(pa.array(np.argsort(order)))


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One a worker: its tasks share what it knows."""
    return Encoder(path)


def code(ranks: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of each document."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    counts = np.diff(offsets)
    bytes_ = -(-counts // 4)
    opens = np.concatenate([[0], np.cumsum(bytes_)])
    row = np.repeat(np.arange(len(counts)), counts)
    codes = np.zeros(int(opens[-1]) * 4, np.uint8)
    codes[opens[row] * 4 + np.arange(len(ranks)) - offsets[row]] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    ends = np.concatenate([[0], np.cumsum(size)])[offsets]
    controls = [control[a:b].tobytes() for a, b in zip(opens[:-1], opens[1:])]
    return controls, [data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]


#: Byte lengths of the four ranks of every control byte.
SIZES = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a document."""
    size = SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.concatenate([[0], np.cumsum(size)[:-1]]) if n else np.zeros(0, np.int64)
    padded = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    ranks = padded[at]
    for k in (1, 2, 3):
        more = size > k
        ranks[more] |= padded[at[more] + k] << np.uint32(8 * k)
    return ranks


def _tokenize(path: str):
    def run(batches):
        encoder = encoder_of(path)
        counts = np.zeros(encoder.size, np.int64)
        names = ["doc_id", "row", "ids", "token", "count"]
        held, size = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                size += batch["text"].nbytes
                if size < PIECES:
                    continue
            if not held:
                continue
            texts = pa.concat_arrays([b["text"].fill_null("") for b in held])
            docs, places = (pa.concat_arrays([b[k] for b in held]) for k in ("doc_id", "row"))
            held, size = [], 0
            rows = encoder.encode_rows(texts)
            counts += np.bincount(spans(rows)[1].view(encoder.width), minlength=len(counts))
            counts[END] += len(texts)
            for low in range(0, len(texts), 512):
                part = [c.slice(low, 512) for c in (docs, places, rows)]
                none = pa.nulls(len(part[0]), pa.int64())
                yield pa.RecordBatch.from_arrays([*part, none.cast(pa.int32()), none], names=names)
        used = np.flatnonzero(counts)
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(used), pa.binary()), pa.array(used.astype(np.int32)), pa.array(counts[used])], names=names)

    return run


def _code(ranks, width: str):
    """Sorted rows of ids as control and data bytes, with the ids before each row in its part."""

    def run(batches):
        rank_of, done = ranks.value, 0
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                ids = [np.append(np.frombuffer(b, width), np.array([END], width)) for b in part["ids"].to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
                controls, data = code(rank_of[np.concatenate(ids)], offsets)
                columns = [part["doc_id"], part["row"], pa.array(np.diff(offsets)), pa.array(controls, pa.binary()), pa.array(data, pa.binary()), pa.array(done + offsets[:-1])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n_tokens", "control", "data", "place"])
                done += int(offsets[-1])

    return run


def write_token_files(documents: DataFrame, tokenizer_path: str, folder: str) -> None:
    """Encode every whole text of ``documents`` (doc_id, text) and write the token files and the rank table to ``folder``.

    ``folder``/tokens: part (ascending doc_id, then row of the input), place (ids before the document in its part),
    doc_id, n_tokens, control, data. ``folder``/ranks: rank, token. Null texts are empty and hold the end id alone; rows
    without doc_id come first; rows that share one follow each other.
    """
    from tokenizers import Tokenizer

    spark = documents.sparkSession
    size = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    width = "<u2" if size <= 1 << 16 else "<u4"
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    encoded = written(rows.mapInArrow(_tokenize(tokenizer_path), "doc_id long, row long, ids binary, token int, count long"), "token-ids", compression="zstd")
    counts = encoded.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("n")).collect()
    n = {token: count for token, count in counts}
    order = sorted(range(size), key=lambda t: (-n.get(t, 0), t))
    rank_of = np.empty(size, np.uint32)
    rank_of[order] = np.arange(size)
    ranked = spark.createDataFrame(pa.table({"rank": pa.array(range(size), pa.int32()), "token": pa.array(order, pa.int32())}))
    ranked.coalesce(1).write.parquet(f"{folder}/ranks")
    texts = encoded.where("token IS NULL")
    # Dealt before they are coded, as the exchange reads its rows twice.
    dealt = texts.select("doc_id", "row", "ids").repartitionByRange(partitions(spark), "doc_id", "row").sortWithinPartitions("doc_id", "row")
    placed = dealt.mapInArrow(_code(spark.sparkContext.broadcast(rank_of), width), "doc_id long, row long, n_tokens long, control binary, data binary, place long")
    placed.select(F.spark_partition_id().alias("part"), "place", "doc_id", "n_tokens", "control", "data").write.option("compression", "zstd").parquet(f"{folder}/tokens")
    discard(encoded)


def _read(tokens):
    def run(batches):
        of_rank = tokens.value
        for batch in batches:
            sums = []
            for control, data, n in zip(batch["control"].to_pylist(), batch["data"].to_pylist(), batch["n_tokens"].to_pylist()):
                ids = of_rank[decode(control, data, n)]
                sums.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            counts, crc = (np.array(x, np.int64) for x in (zip(*sums) if sums else ((), ())))
            yield pa.RecordBatch.from_arrays([batch["part"], batch["place"], batch["doc_id"], pa.array(counts), pa.array(crc)], names=["part", "place", "doc_id", "n_tokens", "ids_crc32"])

    return run


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Decode the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32, one row per document."""
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").toArrow()
    of_rank = ranks["token"].to_numpy().astype(np.uint32)
    files = spark.read.parquet(f"{folder}/tokens")
    ids = files.mapInArrow(_read(spark.sparkContext.broadcast(of_rank)), "part int, place long, doc_id long, n_tokens long, ids_crc32 long")
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each part: as many as the files.
    shifts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return ids.join(F.broadcast(shifts), "part").select("doc_id", (F.col("shift") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_token_files(spark, folder)
