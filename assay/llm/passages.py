"""Substring dedup by collinear chaining.

Texts share seeds of two kinds, joined in two rounds. Long ones are k-grams that are the least of a window, so every common
run of ``GRAM + WINDOW - 1`` words holds one. Short ones are runs of ``SHORT`` words, sought for what no passage of the first
round covers. A holder of a long seed is matched with the first holder, one of a short seed with the first and the one right
before, so matches grow with the words, whatever the size of a group. What both rounds leave is compared with all earlier
holders: with a quarter of the words changed some of the runs of a window of ``min_words`` are left, and the least frequent of
these is among the rarest of the window (the q-gram lemma), so the most frequent runs are never needed. The matches of a document with one of these hubs
are joined to exact segments, chained in both orders with a cost for gaps (a Fenwick tree keeps the best chain that
ends before a place of the hub), and aligned: equal words in gaps count, ends are extended while they gain.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from assay.llm.exchange import PACKED, Dealer, Layout, dealt, exchanged, in_order, parts_of
from assay.llm.jaccard import id_filter, made_with_ids, with_ids
from assay.llm.registry import query, table
from assay.llm.storage import discard, partitions, whole_runs, written
from assay.llm.words import alphanumeric, mix, shingles, text_bytes, window_starts, words_of

GRAM = 8
SHORT = 3
PARTS = 2  # times as many parts for short seeds, of which there are as many as words
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
NEAR = 40  # words within which a short seed needs another one ...
DRIFT = 12  # ... as far ahead in the hub, up to so many words put in or left out
NEIGHBOURS = 24  # matches that are looked at for it
SUPPORT = 3  # so many of them beside one match at least make a pair of texts worth chaining
SEEDED = 9  # words of a chain of short seeds that are in seeds, at least
MANY = 1 << 15  # rows of a seed are counted up to so many
STEP = 6  # of places of one seed in so many words the first is compared, with that many more words around
OFF = DRIFT + STEP - 1
CELL = 2048  # rows of a seed that one task compares with as many, about
PASS = 64 << 20  # bytes of words around places that are dealt to cells at a time ...
TEXTS = 3  # ... or so many times what all words take up
DENSE = 1 << 12  # pairs of a cell from which they are first told apart by products of matrices
BUCKETS = 1 << 10  # of words there
ALIKE = 0.95  # what is this similar to an earlier document needs no seeds of its own
WINDOW = 16
MIN_WORDS = 40  # shorter passages are not reported; an exact one of that length has long seeds that span 16 words
MIN_SEEDED = 16  # of long seeds; what has fewer is sought by short ones
SIMILARITY = 0.75
GAP_COST = 0.25  # a word of gap, on either side; a word in a segment gains 1
MAX_GAP = 32
SEGMENT = 256  # longest segment
PIECE = 384  # longest part of a chain that is aligned at a time
MARGIN = 64  # words beyond an end that may be added
BLOCK = 512  # words; a block also holds those of the next
PACK = 1 << 11  # segments of a pair in one row
OPEN = 1 << 20  # places of a seed that are held until all of them are seen

SEEDS = Layout("seeds", (("seed", "i8"), ("doc_id", "i8"), ("pos", "i4")), ("seed",), ("seed", "doc_id", "pos"), several=True)
MATCHES = Layout("matches", (("doc_id", "i8"), ("hub", "i8"), ("pos", "i4"), ("hub_pos", "i4"), ("size", "i4")), ("doc_id", "hub"), ("doc_id", "hub", "pos", "hub_pos", "-size"), "doc_id")
# Places of shared seeds, n with the bit that tells whether they seek; and spans: place -1, their ends for the seed, n less than 0.
SHARED = Layout("shared", (("doc_id", "i8"), ("seed", "i8"), ("pos", "i4"), ("n", "i4")), ("doc_id",), ("doc_id", "pos"), "doc_id")
_KEPT = (("doc_id", "i8"), ("seed", "i8"), ("pos", "i4"), ("n", "i4"), ("seeks", "i4"), ("holds", "i4"))
KEPT = Layout("kept", _KEPT, ("seed",), ("seed", "doc_id", "pos"), several=True)
WANTED = Layout("wanted", _KEPT, ("doc_id",), ("doc_id", "seed", "pos"), "doc_id")


def _seeds(batches):
    for batch in batches:
        words = words_of(batch["text"], alphanumeric())
        grams = shingles(words.hash, GRAM)
        starts = window_starts(words.offsets, GRAM + WINDOW - 1)
        if not len(starts):
            continue
        # The last least place of ever wider windows; that of the next window is never before it.
        least, where, wide = grams, np.arange(len(grams)), 1
        while wide < WINDOW:
            step = min(wide, WINDOW - wide)
            right = least[step:] <= least[:-step]
            least, where = np.where(right, least[step:], least[:-step]), np.where(right, where[step:], where[:-step])
            wide += step
        where = where[starts]
        where = where[np.append(True, where[1:] != where[:-1])]
        row = np.searchsorted(words.offsets, where, "right") - 1
        pos = (where - words.offsets[row]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(grams[where].view(np.int64)), batch["doc_id"].take(pa.array(row)), pa.array(pos)], names=["seed", "doc_id", "pos"])


def _long_matches(batches):
    """Holders of a seed, sorted by document, with the first place of the first one; in any number of batches."""
    kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
    for batch in in_order(SEEDS, batches):
        seed, doc, pos = (np.concatenate([k, batch[c].to_numpy()]) for k, c in zip(kept, ("seed", "doc_id", "pos")))
        first = np.maximum.accumulate(np.where(np.append(True, seed[1:] != seed[:-1]), np.arange(len(seed)), 0))
        mine = np.flatnonzero(doc != doc[first])
        theirs = first[mine]
        columns = [doc[mine], doc[theirs], pos[mine], pos[theirs], np.full(len(mine), GRAM, np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "hub", "pos", "hub_pos", "size"])
        kept = [c[first[-1] :][:1] for c in (seed, doc, pos)]


def rare_enough(key: np.ndarray, window: int, spare: int) -> np.ndarray:
    """Places that, in some window of so many places, have ``spare`` lesser keys (32 bits) beside them."""
    n = len(key)
    if spare <= 0 or not n:
        return np.ones(n, bool)
    keep = np.empty(n, bool)
    beyond = np.full(window, 0xFFFFFFFF, np.uint32)
    padded = np.concatenate([beyond, key, beyond])
    for at in range(0, n, 1 << 15):
        size = min(1 << 15, n - at)
        own = padded[at + window : at + window + size]
        # Lesser keys from the start of the first window up to each place around.
        upto = np.zeros((2 * window, size), np.int16)
        for k in range(1, 2 * window):
            np.add(upto[k - 1], padded[at + k : at + k + size] < own, out=upto[k])
        most = np.zeros(size, np.int16)
        for k in range(window):
            np.maximum(most, upto[k + window] - upto[k], out=most)
        keep[at : at + size] = most >= spare
    return keep


def _uncovered(words, starts: np.ndarray, spans: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
    """Whether the short runs that start here are outside of all spans of their row, and outside of those that are ``alike``."""
    seek, hold = np.ones(len(words.hash) + 1, np.int32), np.ones(len(words.hash) + 1, np.int32)
    for r, row in enumerate(spans.to_pylist() if spans is not None else ()):
        base, end = int(words.offsets[r]), int(words.offsets[r + 1])
        for span in row or ():
            low, high = min(base + span["start_word"], end), min(base + span["end_word"], end)
            seek[low:high] = 0
            if span["alike"]:
                hold[low:high] = 0
    return seek[starts] + seek[starts + SHORT - 1] > 0, hold[starts] + hold[starts + SHORT - 1] > 0


def _short_seeds(min_words: int):
    def run(batches):
        for batch in batches:
            words = words_of(batch["text"], alphanumeric())
            starts = window_starts(words.offsets, SHORT)
            row = np.searchsorted(words.offsets, starts, "right") - 1
            values = shingles(words.hash, SHORT)[starts]
            mine = words.counts()[row] >= min_words
            seeks, holds = _uncovered(words, starts, batch["spans"] if "spans" in batch.schema.names else None)
            at = np.flatnonzero(mine & holds)
            doc = batch["doc_id"].take(pa.array(row[at]))
            pos = (starts - words.offsets[row])[at].astype(np.int32)
            # A place that does not seek is given as its complement.
            columns = [values[at].view(np.int64), doc, np.where(seeks[at], pos, ~pos)]
            whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["seed", "doc_id", "pos"])
            for low in range(0, whole.num_rows, 1 << 15):
                yield whole.slice(low, 1 << 15)

    return run


def _short_matches(batches, in_turn: bool = False):
    """Holders of a seed, sorted by document, with the first one and with the last of the document before; in any number of
    batches, between which the open seed's rows of its first and of the last two documents are kept.

    ``in_turn``: where those documents hold the seed several times, its places are also matched the n-th with the n-th. In
    runs of a few repeated words all places of a seed have else one and the same partner, and make no chain.
    """
    kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
    for batch in batches:
        if not batch.num_rows:
            continue
        seed, doc, pos = (np.concatenate([k, batch[c].to_numpy()]) for k, c in zip(kept, ("seed", "doc_id", "pos")))
        n = len(seed)
        new_seed = np.ones(n, bool)
        new_seed[1:] = seed[1:] != seed[:-1]
        new_doc = new_seed.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        rows = np.arange(n)
        first = np.maximum.accumulate(np.where(new_seed, rows, 0))
        own = np.maximum.accumulate(np.where(new_doc, rows, 0))  # the first row of the document
        before, nth = own - 1, rows - own  # the last row of the document before, the number among its own
        times = np.diff(np.append(np.flatnonzero(new_doc), n))[np.cumsum(new_doc) - 1]  # rows of the document
        seeks = (pos >= 0) & (doc != doc[first])
        two = seeks & (doc[before] != doc[first])
        pairs = [(seeks, first), (two, before)]
        if in_turn:
            turns = [first + nth % times[first], own[before] + nth % times[before]]
            pairs += [(seeks & (turns[0] != first), turns[0]), (two & (turns[1] != before), turns[1])]
        mine, theirs = np.concatenate([np.flatnonzero(x) for x, _ in pairs]), np.concatenate([other[x] for x, other in pairs])
        place = np.where(pos < 0, ~pos, pos)
        columns = [doc[mine], doc[theirs], place[mine], place[theirs], np.full(len(mine), SHORT, np.int32)]
        whole = pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["doc_id", "hub", "pos", "hub_pos", "size"])
        for at in range(0, max(whole.num_rows, 1), 1 << 15):
            yield whole.slice(at, 1 << 15)
        last = n - 1
        start, end = int(first[last]), int(first[last] + times[first[last]])
        stay = np.unique(np.concatenate([rows[start:end], rows[max(start, int(own[before[last]])) if before[last] >= start else int(own[last]) :]]))
        kept = [seed[stay], doc[stay], ~place[stay]]


class Shared:
    """Of a stream sorted by seed and document, the places of seeds of several documents, with the number of the seed's rows.

    ``MANY`` stands for as many or more, so that no more rows of an open seed are held than that.
    """

    def __init__(self):
        self.held, self.full = None, None  # rows of the open seed; the seed that has many

    def take(self, batch: pa.RecordBatch):
        columns = {k: batch[k].to_numpy() for k in ("seed", "doc_id", "pos")}
        if self.held is not None:
            columns = {k: np.concatenate([self.held[k], columns[k]]) for k in columns}
        seed, doc = columns["seed"], columns["doc_id"]
        if not len(seed):
            return
        new = np.flatnonzero(np.append(True, seed[1:] != seed[:-1]))
        rows = np.diff(np.append(new, len(seed)))
        several, size = doc[new] != doc[new + rows - 1], np.minimum(rows, MANY)
        if self.full is not None and seed[0] == self.full:
            several[0], size[0] = True, MANY
        # The last seed stays open, unless it is known to have many rows in several documents.
        self.full = seed[-1] if several[-1] and size[-1] >= MANY else None
        end = len(seed) if self.full is not None else int(new[-1])
        self.held = None if self.full is not None else {k: v[end:] for k, v in columns.items()}
        yield from self._rows(columns, np.repeat(np.where(several, size, 0), rows), end)

    def close(self):
        if self.held is not None:
            doc = self.held["doc_id"]
            yield from self._rows(self.held, np.full(len(doc), min(len(doc), MANY) if doc[0] != doc[-1] else 0), len(doc))

    @staticmethod
    def _rows(columns: dict, n: np.ndarray, end: int):
        """As rows of matches of no words: the seed for the hub, the number for the place in it."""
        at = np.flatnonzero(n[:end])
        given = [columns["doc_id"][at], columns["seed"][at], columns["pos"][at], n[at].astype(np.int32), np.zeros(len(at), np.int32)]
        whole = pa.RecordBatch.from_arrays([pa.array(c) for c in given], names=["doc_id", "hub", "pos", "hub_pos", "size"])
        for low in range(0, whole.num_rows, 1 << 15):
            yield whole.slice(low, 1 << 15)


def _matches_and_shared(batches):
    shared, told = Shared(), []

    def watched():
        for batch in batches:
            told.extend(shared.take(batch))
            yield batch

    for matches in _short_matches(watched(), in_turn=True):
        yield matches
        yield from told
        told.clear()
    yield from told
    yield from shared.close()


def _short_dealt(parts: int):
    """Matches of short seeds (kind 0) and places of shared ones (kind 1), packed."""

    def run(batches):
        matches, shared = Dealer(MATCHES, parts, 0), Dealer(SHARED, parts, 1)
        for batch in _matches_and_shared(in_order(SEEDS, batches)):
            if batch.num_rows and batch["size"][0].as_py():
                yield from matches.take(batch)
            elif batch.num_rows:
                doc, seed, pos, n = (batch[k].to_numpy() for k in ("doc_id", "hub", "pos", "hub_pos"))
                columns = [doc, seed, np.where(pos < 0, ~pos, pos), n << 1 | (pos >= 0)]
                yield from shared.take(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "seed", "pos", "n"]))
        yield from matches.close()
        yield from shared.close()

    return run


def _rarest_uncovered(min_words: int, similarity: float):
    """Of the places and spans of documents, the rarest places that still seek or hold."""
    rarest = _rarest(min_words, similarity)

    def run(batches):
        for columns, bounds in whole_runs(in_order(SHARED, batches), ["doc_id"]):
            doc, seed, pos, n = (columns[k][: bounds[-1]] for k in ("doc_id", "seed", "pos", "n"))
            spans = n < 0
            docs = np.unique(doc[spans])  # of the covered documents
            spans, place = (np.searchsorted(docs, doc[spans]).astype(np.int64) << 33, seed[spans], n[spans] < -1), np.flatnonzero(~spans)
            given = [seed[place], doc[place], pos[place], (n[place] & 1).astype(np.int32), n[place] >> 1]
            for kept in rarest(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in given], names=["seed", "doc_id", "pos", "seeks", "n"])])):
                seed, doc, pos, seeks, n = (c.to_numpy() for c in kept.columns)
                own = np.searchsorted(docs, doc)
                known = np.append(docs, -1)[own] == doc if len(docs) else np.zeros(len(doc), bool)
                own = np.where(known, own, -1).astype(np.int64) << 33
                seeks = np.where(_inside(own + pos, *spans[:2]), 0, seeks).astype(np.int32)
                holds = (~_inside(own + pos, *(c[spans[2]] for c in spans[:2]))).astype(np.int32)
                more = np.flatnonzero(seeks + holds)
                yield pa.RecordBatch.from_arrays([pa.array(c[more]) for c in (doc, seed, pos, n, seeks, holds)], names=[k for k, _ in _KEPT])

    return run


def _inside(place: np.ndarray, own: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the short runs that start here lie within a span, of which ``own`` tells the document and ``ends`` start and end."""
    if not len(own):
        return np.zeros(len(place), bool)
    start, end = own + (ends >> 32), own + (ends & 0xFFFFFFFF)
    order = np.argsort(start, kind="stable")
    reach = np.maximum.accumulate(end[order])
    before = np.searchsorted(start[order], place, "right") - 1
    return (before >= 0) & (reach[before] >= place + SHORT)


def _paired(batches):
    """Places that seek behind one that holds their seed, and places that hold before one that seeks. Of a seed of
    more than ``OPEN`` rows all places behind the first that holds stay, as one that seeks may still come."""
    names = [k for k, _ in _KEPT]
    held, full = None, None  # rows of the open seed; a seed some rows of which were given, with its first holder
    for batch in itertools.chain(in_order(KEPT, batches), [None]):
        if batch is not None:
            here = {k: batch[k].to_numpy() for k in names}
            held = here if held is None else {k: np.concatenate([held[k], here[k]]) for k in names}
        if held is None or not len(held["seed"]):
            continue
        seed = held["seed"]
        new = np.flatnonzero(np.append(True, seed[1:] != seed[:-1]))
        some = batch is not None and len(seed) - int(new[-1]) > OPEN
        end = len(seed) if batch is None or some else int(new[-1])
        rows, held = {k: v[:end] for k, v in held.items()}, {k: v[end:] for k, v in held.items()}
        if not end:
            continue
        new = new[new < end]
        most = np.iinfo(np.int64)
        first = np.minimum.reduceat(np.where(rows["holds"] > 0, rows["doc_id"], most.max), new)
        last = np.maximum.reduceat(np.where(rows["seeks"] > 0, rows["doc_id"], most.min), new)
        if full is not None and full[0] == rows["seed"][0]:
            first[0] = min(first[0], full[1])
        full = (seed[end - 1], first[-1]) if some else None
        if some:
            last[-1] = most.max
        of = np.repeat(np.arange(len(new)), np.diff(np.append(new, end)))
        doc, first, last = rows["doc_id"], first[of], last[of]
        rows["seeks"], rows["holds"] = np.where(doc > first, rows["seeks"], 0), np.where(doc < last, rows["holds"], 0)
        stay = np.flatnonzero((first < last) & (rows["seeks"] + rows["holds"] > 0))
        yield pa.RecordBatch.from_arrays([pa.array(rows[k][stay].astype(t, copy=False)) for k, t in _KEPT], names=names)


def _rarest(min_words: int, similarity: float):
    """Of the shared seeds of a document those that are among the rarest of a window: one of what any similar words share."""
    window = min_words - SHORT + 1
    left = max(window - SHORT * int(min_words * (1 - similarity) + 1e-9), 1)  # runs that are left, at least

    def run(batches):
        for columns, bounds in whole_runs(batches, ["doc_id"]):
            n = int(bounds[-1])
            pos = columns["pos"][:n].astype(np.int64)  # ascending
            run_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            # Places of which so many lie in one window.
            place = pos + run_of * (1 << 33)
            keep = np.zeros(n, bool)
            dense = np.flatnonzero(place[left - 1 :] - place[: max(n - left + 1, 0)] < window)
            for k in range(left):
                keep[dense + k] = True
            at = np.flatnonzero(keep)
            # As far apart as they are, but for gaps of more than a window.
            apart = np.minimum(np.diff(place[at], prepend=0), window)
            spread = np.cumsum(apart)
            mixed = mix(columns["seed"][at].view(np.uint64)) >> np.uint64(48)
            key = (np.uint64(MANY) - columns["n"][at].astype(np.uint64)) << np.uint64(16) | mixed
            keys = np.full(int(spread[-1]) + 1 if len(at) else 0, 0xFFFFFFFF, np.uint32)
            np.minimum.at(keys, spread, key.astype(np.uint32))
            at = at[rare_enough(keys, window, left - 1)[spread]]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(columns[k][at]) for k in columns], names=list(columns))

    return run


def _around(min_words: int) -> tuple[int, int]:
    """How many words before a place, and how many in all, the windows of it and of the next ``STEP`` places hold."""
    return min_words - SHORT + STEP - 1, 2 * min_words - SHORT + 2 * (STEP - 1)


def _codes(parts: int):
    """Texts as two bytes a word, dealt to the parts of ``WANTED``; zero stands for no word."""

    def run(batches):
        for batch in batches:
            words = words_of(batch["text"], alphanumeric())
            code = (mix(words.hash) >> np.uint64(48)).astype(np.uint16)
            code[code & 0xFF == 0] += 1
            doc = batch["doc_id"].to_numpy()
            part = parts_of([doc], parts)
            order = np.argsort(part, kind="stable")
            out = []
            for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else ():
                texts = [code[words.offsets[r] : words.offsets[r + 1]].tobytes() for r in rows]
                out.append((2, int(part[rows[0]]), len(rows), b"".join([doc[rows].tobytes(), words.counts()[rows].tobytes(), *texts])))
            if out:
                kind, part, rows, data = zip(*out)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in (kind, part, rows)), pa.array(data, pa.binary())], names=["kind", "part", "rows", "data"])

    return run


def _coded(batches):
    """The places of a document and its codes in one row. The first text, by bytes, of the rows of a document stands for it."""
    texts = []

    def places():
        for batch in batches:
            for n, data in zip(*(batch.filter(pc.equal(batch["kind"], 2))[k].to_pylist() for k in ("rows", "data"))):
                doc, size = (np.frombuffer(data, np.int64, n, at) for at in (0, 8 * n))
                texts.append((doc, data, np.cumsum(np.append(16 * n, 2 * size))))
            yield batch.filter(pc.not_equal(batch["kind"], 2))

    ids = None
    for columns, bounds in whole_runs(in_order(WANTED, places()), ["doc_id"]):
        if ids is None:
            ids = {}
            for doc, data, ends in texts:
                for k, d in enumerate(doc.tolist()):
                    code = memoryview(data)[ends[k] : ends[k + 1]]
                    ids[d] = code if d not in ids else min(ids[d], code, key=bytes)
        fields = [pa.array(columns[k][: bounds[-1]]) for k in ("seed", "pos", "seeks", "holds", "n")]
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays(fields, ["seed", "pos", "seeks", "holds", "n"]))
        doc = columns["doc_id"][bounds[:-1]]
        for low in range(0, len(doc), 1 << 7):
            there = [k for k in range(low, min(low + (1 << 7), len(doc))) if int(doc[k]) in ids]
            codes = pa.array([bytes(ids[int(doc[k])]) for k in there], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(doc[there]), codes, lists.take(pa.array(there, pa.int64()))], names=["doc_id", "codes", "wanted"])


def _contexts(min_words: int, turn: int, turns: int):
    """Seeds with the words around them, dealt to the cells (part that seeks, part that holds) of their seed; only of the
    cells whose turn it is."""
    before, width = _around(min_words)

    def mine_now(seed, a, b):
        return (mix(seed.view(np.uint64) + mix((a << 32 | b).view(np.uint64))) >> np.uint64(33)) % np.uint64(turns) == turn

    def run(batches):
        for batch in batches:
            code = np.frombuffer(b"".join(batch["codes"].to_pylist()), np.uint16)
            offsets = np.concatenate([[0], np.cumsum(pc.binary_length(batch["codes"]).to_numpy(zero_copy_only=False) // 2)]).astype(np.int64)
            wanted = batch["wanted"]
            rows = np.repeat(np.arange(batch.num_rows), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
            flat = wanted.flatten()
            seed, pos, seeks, holds, n = (flat.field(k).to_numpy() for k in ("seed", "pos", "seeks", "holds", "n"))
            doc = batch["doc_id"].to_numpy()
            order = np.lexsort((pos, seeks, seed, rows))
            rows, seed, pos, seeks, holds, n = (c[order] for c in (rows, seed, pos, seeks, holds, n))
            first = np.ones(len(rows), bool)
            first[1:] = (np.diff(rows) != 0) | (seed[1:] != seed[:-1]) | (np.diff(seeks) != 0) | (np.diff(pos // STEP) != 0)
            rows, seed, pos, seeks, holds, n = (c[first] for c in (rows, seed, pos, seeks, holds, n))
            for low in range(0, len(rows), 1 << 12):
                row = rows[low : low + (1 << 12)]
                parts = -(-n[low : low + (1 << 12)].astype(np.int64) // CELL)
                own = (mix(doc[row].view(np.uint64)) >> np.uint64(33)).astype(np.int64) % parts
                searching, holding = seeks[low : low + (1 << 12)] > 0, holds[low : low + (1 << 12)] > 0
                dealt = []
                # Sides: 1 seeks, 2 holds, 3 does both; a place of a seed of one part is one row.
                for side, mine in ((1, searching & (parts > 1)), (2, holding & ((parts > 1) | ~searching)), (3, searching & (parts == 1))):
                    mine = np.flatnonzero(mine)
                    which = np.repeat(mine, parts[mine])
                    other = np.arange(len(which)) - np.repeat(np.cumsum(parts[mine]) - parts[mine], parts[mine])
                    a, b = (other, own[which]) if side == 2 else (own[which], other)
                    now = mine_now(seed[low + which], a, b)
                    dealt.append((which[now], a[now], b[now], np.full(int(now.sum()), side)))
                which, a, b, side = (np.concatenate(c) for c in zip(*dealt))
                if not len(which):
                    continue
                used, again = np.unique(which, return_inverse=True)
                places = (offsets[row[used]] + pos[low + used] - before)[:, None] + np.arange(width)
                inside = (places >= offsets[row[used]][:, None]) & (places < offsets[row[used] + 1][:, None])
                context = np.where(inside, code[np.clip(places, 0, max(len(code) - 1, 0))], 0).astype(np.uint16) if len(code) else np.zeros(places.shape, np.uint16)
                texts = pa.array([c.tobytes() for c in context])
                columns = [seed[low + which], a.astype(np.int32), b.astype(np.int32), doc[row[which]], side.astype(np.int32), pos[low + which]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns] + [texts.take(pa.array(again))], names=["seed", "a", "b", "doc_id", "side", "pos", "words"])

    return run


def alike_words(x: np.ndarray, y: np.ndarray, min_words: int, equal: int) -> np.ndarray:
    """Rows of words around two places that may have so many equal ones in a window, up to ``OFF`` places off."""
    width = x.shape[1]
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    same = np.zeros(x.shape, bool)
    for d in range(-OFF, OFF + 1):
        low, high = max(0, -d), min(width, width - d)
        same[low:high] |= x[low:high] == y[low + d : high + d]
    same &= x != 0
    upto = np.zeros((width + 1, x.shape[1]), np.int16)
    np.cumsum(same, axis=0, out=upto[1:])
    return (upto[min_words:] - upto[:-min_words]).max(axis=0) >= equal


def word_tables(words: np.ndarray, min_words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the first and for the last of the windows of a row: its words by bucket, and the buckets that may equal them."""
    width, middle = words.shape[1], (words.shape[1] - min_words) // 2

    def table(part: np.ndarray) -> np.ndarray:
        flat = np.ascontiguousarray(part).ravel()
        at = np.flatnonzero(flat)
        cell = at // part.shape[1] * BUCKETS + (flat[at] & (BUCKETS - 1))
        return np.bincount(cell, minlength=len(part) * BUCKETS).reshape(-1, BUCKETS).astype(np.float32)

    def there(part: np.ndarray) -> np.ndarray:
        flat = np.ascontiguousarray(part).ravel()
        at = np.flatnonzero(flat)
        out = np.zeros((len(part), BUCKETS), np.float32)
        out.ravel()[at // part.shape[1] * BUCKETS + (flat[at] & (BUCKETS - 1))] = 1
        return out

    spans = ((0, middle + min_words), (middle + 1, width))
    return [(table(words[:, a:b]), there(words[:, max(a - OFF, 0) : b + OFF])) for a, b in spans]


def maybe_alike(x: np.ndarray, y: np.ndarray, min_words: int, equal: int) -> np.ndarray:
    """All pairs of rows of words, of which none may be left out that ``alike_words`` takes."""
    out = np.zeros((len(x), len(y)), bool)
    for (counts, _), (_, there) in zip(word_tables(x, min_words), word_tables(y, min_words)):
        out |= counts @ there.T >= equal
    return out


def _rest_matches(min_words: int, similarity: float):
    """All pairs of a cell's seeking and earlier holding places whose words around may be a passage, as matches of short runs."""
    (before, width), equal = _around(min_words), int(np.ceil(min_words * similarity - 1e-9))
    names = ["doc_id", "hub", "pos", "hub_pos", "size"]

    def matches(words, doc, pos, mine, theirs):
        bytes_ = (words & 0xFF).astype(np.uint8)
        for low in range(0, len(mine), 1 << 13):
            i, j = mine[low : low + (1 << 13)], theirs[low : low + (1 << 13)]
            # By one byte of each word first, which lets no pair go that is alike by both.
            for codes in (bytes_, words):
                fine = alike_words(codes[i], codes[j], min_words, equal)
                i, j = i[fine], j[fine]
            for at in range(0, len(i), 1 << 10):
                yield from runs_of(words, doc, pos, i[at : at + (1 << 10)], j[at : at + (1 << 10)])

    def runs_of(words, doc, pos, i, j):
        """Equal words in a row, at least as many as a short seed has, each given once."""
        x, y, out = words[i], words[j], []
        for d in range(-OFF, OFF + 1):
            low, high = max(0, -d), min(width, width - d)
            same = np.zeros((len(i), high - low + 1), bool)
            same[:, 1:] = (x[:, low:high] == y[:, low + d : high + d]) & (x[:, low:high] != 0)
            flat = np.append(same.ravel(), False)
            # Runs begin and end by turns.
            change = np.flatnonzero(flat[1:] != flat[:-1])
            start, size = change[::2], change[1::2] - change[::2]
            long = np.flatnonzero(size >= SHORT)
            r, start = np.divmod(start[long], high - low + 1)
            start, size = start + low - before, size[long]
            out.append((doc[i[r]], doc[j[r]], pos[i[r]] + start, pos[j[r]] + start + d, size))
        given = [np.concatenate(o) for o in zip(*out)]
        key = np.zeros(len(given[0]), np.uint64)
        for column in given:
            key = mix(key + column.astype(np.int64).view(np.uint64))
        once = np.unique(key, return_index=True)[1]
        given = [c[once].astype(np.int64 if k < 2 else np.int32) for k, c in enumerate(given)]
        whole = pa.RecordBatch.from_arrays([pa.array(c) for c in given], names=names)
        for at in range(0, whole.num_rows, 1 << 15):
            yield whole.slice(at, 1 << 15)

    def run(batches):
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            here = pa.Table.from_batches([b for b in (batch,) if b is not None]) if rest is None and batch is not None else rest if batch is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if here is None:
                return
            here = here.combine_chunks()
            seed, a, b, doc, side, pos = (here[k].to_numpy() for k in ("seed", "a", "b", "doc_id", "side", "pos"))
            new = np.append(True, (seed[1:] != seed[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            end = len(seed) if batch is None else int(np.flatnonzero(new)[-1])
            rest = here.slice(end)
            if not end:
                continue
            words = np.frombuffer(b"".join(here["words"].slice(0, end).to_pylist()), np.uint16).reshape(end, width)
            new = new[:end]
            new_doc = new | np.append(True, doc[1:end] != doc[: end - 1])
            rows = np.arange(end)
            holding = np.flatnonzero(side[:end] & 2)
            seen = np.concatenate([[0], np.cumsum(side[:end] & 2 > 0)])  # holders before a row
            first, last = seen[np.maximum.accumulate(np.where(new, rows, 0))], seen[np.maximum.accumulate(np.where(new_doc, rows, 0))]
            seeking = np.flatnonzero((side[:end] & 1 > 0) & (last > first))
            # Cells of many pairs by themselves.
            cell, pairs = np.cumsum(new)[seeking], (last - first)[seeking]
            dense = np.bincount(cell, pairs)[cell] >= DENSE if len(cell) else np.zeros(0, bool)
            for mine, theirs in _ranges(seeking[~dense], first[seeking[~dense]], last[seeking[~dense]]):
                yield from matches(words, doc, pos, mine, holding[theirs])
            seeking, cell = seeking[dense], cell[dense]
            cuts = np.flatnonzero(np.diff(cell, prepend=-1, append=-1))
            for low, high in zip(cuts[:-1], cuts[1:]):
                for at in range(low, high, CELL // 2):
                    mine = seeking[at : min(at + CELL // 2, high)]
                    for one in range(int(first[mine[0]]), int(last[mine].max()), CELL // 2):
                        theirs = np.arange(one, min(one + CELL // 2, int(last[mine].max())))
                        i, j = np.divmod(np.flatnonzero(maybe_alike(words[mine], words[holding[theirs]], min_words, equal) & (theirs < last[mine][:, None])), len(theirs))
                        yield from matches(words, doc, pos, mine[i], holding[theirs[j]])

    return run


def _ranges(rows: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Pairs of each row with the numbers from ``first`` to ``last``, some at a time."""
    ends = np.cumsum(last - first)
    low = 0
    while low < len(rows):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + (1 << 18), "right")))
        sizes = (last - first)[low:high]
        which = np.repeat(np.arange(low, high), sizes)
        yield rows[which], first[which] + np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        low = high


def supported(pair: np.ndarray, pos: np.ndarray, hub_pos: np.ndarray) -> np.ndarray:
    """Matches of short seeds, sorted by pair and place, beyond whose words another one stands near in both texts; only of
    pairs that have such a match with ``SUPPORT`` others."""
    others = np.zeros(len(pos), np.int32)
    drift = pos - hub_pos
    for k in range(1, min(NEIGHBOURS, len(pos) - 1) + 1):
        apart = pos[k:] - pos[:-k]
        near = (pair[k:] == pair[:-k]) & (apart >= SHORT) & (apart <= NEAR) & (np.abs(drift[k:] - drift[:-k]) <= DRIFT)
        others[k:] += near
        others[:-k] += near
    most = np.zeros(int(pair[-1]) + 1 if len(pair) else 0, np.int32)
    np.maximum.at(most, pair, others)
    return (others > 0) & (most[pair] >= SUPPORT)


def segments(pos: np.ndarray, hub_pos: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches of so many words each as exact segments (start, hub start, length)."""
    return segments_of_pairs(np.zeros(len(pos), np.int64), pos, hub_pos, words)[1:]


def segments_of_pairs(pair: np.ndarray, pos: np.ndarray, hub_pos: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same of many pairs of texts, with the pair first."""
    order = np.lexsort((pos, pos - hub_pos, pair))
    pair, pos, hub_pos, words = pair[order], pos[order].astype(np.int64), hub_pos[order].astype(np.int64), words[order]
    change = np.ones(len(pos), bool)
    change[1:] = (np.diff(pos - hub_pos) != 0) | (pair[1:] != pair[:-1])
    # The furthest end so far on the same diagonal.
    shift = np.cumsum(change) << 32
    reach = np.maximum.accumulate(pos + words + shift) - shift
    breaks = change.copy()
    breaks[1:] |= pos[1:] > reach[:-1]
    first = np.flatnonzero(breaks)
    last = np.append(first[1:], len(pos)) - 1
    pair, start, hub_start, size = pair[first], pos[first], hub_pos[first], reach[last] - pos[first]
    parts = -(-size // SEGMENT)
    if (parts > 1).any():
        which = np.repeat(np.arange(len(size)), parts)
        shift = (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
        pair, start, hub_start, size = pair[which], start[which] + shift, hub_start[which] + shift, np.minimum(SEGMENT, size[which] - shift)
    order = np.lexsort((hub_start, start, pair))
    return pair[order], start[order], hub_start[order], size[order]


def chains(start: np.ndarray, hub_start: np.ndarray, size: np.ndarray) -> list[list[int]]:
    """Disjoint chains of segments, each in ascending order on both sides, best first.

    A chain scores the words of its segments less GAP_COST for each word between them. The best chain that ends at or
    before a hub place is the maximum of a prefix, which a Fenwick tree over the sorted hub ends returns in log time.
    """
    n = len(start)
    if n == 1:
        return [[0]]
    end, hub_end = start + size, hub_start + size
    places = np.unique(hub_end)
    upto = np.searchsorted(places, hub_start, "right")  # places at or before the start
    slot = np.searchsorted(places, hub_end) + 1
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (len(places) + 1)
    score, before = [0.0] * n, [-1] * n
    by_end = np.argsort(end, kind="stable").tolist()
    start, hub_start, size, end, hub_end, upto, slot = (c.tolist() for c in (start, hub_start, size, end, hub_end, upto, slot))
    entered = 0
    for i in range(n):
        while entered < n and end[by_end[entered]] <= start[i]:
            j = by_end[entered]
            item, at = (score[j] + GAP_COST * (end[j] + hub_end[j]), j), slot[j]
            while at <= len(places):
                if item > tree[at]:
                    tree[at] = item
                at += at & -at
            entered += 1
        best, at = (-np.inf, -1), upto[i]
        while at:
            best = max(best, tree[at])
            at -= at & -at
        gain = best[0] - GAP_COST * (start[i] + hub_start[i])
        score[i] = float(size[i]) + max(gain, 0.0)
        if gain > 0:
            before[i] = best[1]
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if not chain:
            continue
        chain.reverse()
        # A gap that is too long parts the chain.
        part = [chain[0]]
        for a, b in zip(chain, chain[1:]):
            if max(start[b] - end[a], hub_start[b] - hub_end[a]) > MAX_GAP:
                out.append(part)
                part = []
            part.append(b)
        out.append(part)
    return out


# A segment with its piece and chain; flags: 1 begins a piece, 2 of the first piece of a chain, 4 of the last.
_SEGMENT = np.dtype([("chain", "i8"), ("flags", "i4"), ("start", "i4"), ("hub_start", "i4"), ("seg_start", "i4"), ("seg_hub", "i4"), ("seg_size", "i4")])
_PIECES = "doc_id long, hub long, block int, hub_block int, low int, hub_low int, high int, hub_high int, pieces binary"


def _chained(columns: dict, starts: np.ndarray, ends: np.ndarray, span: int, seeded: int = 0):
    starts, ends = starts[starts < ends], ends[starts < ends]
    if not len(starts):
        return
    doc, hub = columns["doc_id"], columns["hub"]
    rows = np.repeat(starts - np.cumsum(np.append(0, ends - starts))[:-1], ends - starts) + np.arange(int((ends - starts).sum()))
    pair = np.repeat(np.arange(len(starts)), ends - starts)
    pair, *found = segments_of_pairs(pair, *(columns[k][rows] for k in ("pos", "hub_pos", "size")))
    bounds = np.append(np.flatnonzero(np.append(True, pair[1:] != pair[:-1])), len(pair))
    alone = np.diff(bounds) == 1
    # Pairs of one segment need no chains.
    single = bounds[:-1][alone]
    single = single[(found[2][single] >= span) & (found[2][single] >= seeded)]
    used, flags, low, first = [single], [np.full(len(single), 7)], [single], [single]  # segments; of each the first of its chain and of its piece
    for a, b in zip(bounds[:-1][~alone].tolist(), bounds[1:][~alone].tolist()):
        arrays = [c[a:b] for c in found]
        start, hub_start, size = (c.tolist() for c in arrays)
        chosen, marks, heads, begins = [], [], [], []
        for chain in chains(*arrays):
            if start[chain[-1]] + size[chain[-1]] - start[chain[0]] < span or sum(size[i] for i in chain) < seeded:
                continue
            cuts, place, hub_place = [0], start[chain[0]], hub_start[chain[0]]
            for k, i in enumerate(chain):
                if k > cuts[-1] and max(start[i] + size[i] - place, hub_start[i] + size[i] - hub_place) > PIECE:
                    place, hub_place = start[chain[k - 1]] + size[chain[k - 1]], hub_start[chain[k - 1]] + size[chain[k - 1]]
                    cuts.append(k)
            cuts.append(len(chain))
            for at, upto in zip(cuts[:-1], cuts[1:]):
                mark = 2 * (at == 0) + 4 * (upto == len(chain))
                marks += [mark + 1] + [mark] * (upto - at - 1)
                begins += [chain[at - 1] if at else -1] * (upto - at)
            chosen += chain
            heads += [chain[0]] * len(chain)
        used.append(np.array(chosen, np.int64) + a)
        flags.append(np.array(marks, np.int64))
        low.append(np.array(heads, np.int64) + a)
        # A piece begins where the one before it ends.
        begins = np.array(begins, np.int64)
        first.append(np.where(begins < 0, low[-1], -1 - (begins + a)))
    used, flags, low, first = (np.concatenate(c) for c in (used, flags, low, first))
    if not len(used):
        return
    at = starts[pair[used]]
    out = np.zeros(len(used), _SEGMENT)
    out["chain"], out["flags"] = _chain_names(doc[at], hub[at], found[0][low], found[1][low]), flags
    after, before = first >= 0, np.where(first >= 0, first, -1 - first)
    for place, c in (("start", found[0]), ("hub_start", found[1])):
        out[place] = np.where(after, c[before], c[before] + found[2][before])
    out["seg_start"], out["seg_hub"], out["seg_size"] = (c[used] for c in found)
    yield from _pieces(doc[at], hub[at], out)


def _pieces(doc: np.ndarray, hub: np.ndarray, segs: np.ndarray):
    """Pieces of a pair of texts that lie in the same blocks in one row, with the ends of the words that they need."""
    begins = np.flatnonzero(segs["flags"] & 1)
    count = np.diff(np.append(begins, len(segs)))
    last = begins + count - 1
    block, hub_block = (np.maximum(segs[k][begins] - MARGIN, 0) // BLOCK for k in ("start", "hub_start"))
    order = np.lexsort((hub_block, block, hub[begins], doc[begins]))
    begins, count, last, block, hub_block = (c[order] for c in (begins, count, last, block, hub_block))
    keys = [doc[begins], hub[begins], block, hub_block]
    # Not more than so many segments in a row, or one piece.
    change = np.append(True, functools.reduce(np.logical_or, [k[1:] != k[:-1] for k in keys]))
    ends = np.cumsum(count)
    since = ends - count - np.repeat((ends - count)[change], np.diff(np.append(np.flatnonzero(change), len(change))))
    part = since // PACK
    change[1:] |= part[1:] != part[:-1]
    group = np.flatnonzero(change)
    rows = np.repeat(begins - (ends - count), count) + np.arange(int(ends[-1]))
    data, cuts = segs[rows], np.append((ends - count)[group], ends[-1]).tolist()
    low, hub_low = (np.maximum(np.minimum.reduceat(segs[k][begins], group) - MARGIN, 0) for k in ("start", "hub_start"))
    high, hub_high = (np.maximum.reduceat(segs[k][last] + segs["seg_size"][last], group) + MARGIN for k in ("seg_start", "seg_hub"))
    blobs = pa.array([data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
    numbers = [*(k[group] for k in keys), low, hub_low, high, hub_high]
    columns = [*(pa.array(c.astype(np.int64 if k < 2 else np.int32)) for k, c in enumerate(numbers)), blobs]
    whole = pa.RecordBatch.from_arrays(columns, names=["doc_id", "hub", "block", "hub_block", "low", "hub_low", "high", "hub_high", "pieces"])
    for at in range(0, whole.num_rows, 1 << 12):
        yield whole.slice(at, 1 << 12)


def _chain_names(doc: np.ndarray, hub: np.ndarray, low: np.ndarray, hub_low: np.ndarray) -> np.ndarray:
    return (mix((doc * 3 + low).view(np.uint64)) + mix((hub + hub_low).view(np.uint64))).view(np.int64)


def _chain(batches):
    for columns, bounds in whole_runs(batches, ["doc_id", "hub"]):
        span = columns["pos"][bounds[1:] - 1] + GRAM - columns["pos"][bounds[:-1]]
        long = np.flatnonzero(span >= MIN_SEEDED)
        yield from _chained(columns, bounds[long], bounds[long + 1], MIN_SEEDED)


def _chain_short(batches):
    for columns, bounds in whole_runs(batches, ["doc_id", "hub"]):
        m = int(bounds[-1])
        pair = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        keep = np.flatnonzero(supported(pair, columns["pos"][:m].astype(np.int64), columns["hub_pos"][:m].astype(np.int64)))
        if len(keep):
            starts = np.flatnonzero(np.diff(pair[keep], prepend=-1))
            yield from _chained({k: v[keep] for k, v in columns.items()}, starts, np.append(starts[1:], len(keep)), SEEDED, SEEDED)


def _chain_rest(batches):
    """Matches that come from several seeds count once."""
    for columns, bounds in whole_runs(batches, ["doc_id", "hub"]):
        m = int(bounds[-1])
        new = np.ones(m, bool)
        new[1:] = (np.diff(columns["pos"][:m]) != 0) | (np.diff(columns["hub_pos"][:m]) != 0)
        new[bounds[:-1]] = True
        keep = np.flatnonzero(new)
        starts = np.searchsorted(keep, bounds[:-1])
        yield from _chained({k: v[keep] for k, v in columns.items()}, starts, np.append(starts[1:], len(keep)), SEEDED, SEEDED)


def _blocks(batches):
    for batch in batches:
        words = words_of(batch["text"], alphanumeric())
        ids, places, values = [], [], []
        for row, count in enumerate(words.counts()):
            base = words.offsets[row]
            for b in range(-(-int(count) // BLOCK)):
                ids.append(row)
                places.append(b)
                values.append(words.hash[base + b * BLOCK : base + min((b + 2) * BLOCK, count)].tobytes())
        doc = batch["doc_id"].take(pa.array(ids, pa.int64()))
        yield pa.RecordBatch.from_arrays([doc, pa.array(places, pa.int32()), pa.array(values, pa.binary())], names=["doc_id", "block", "words"])


def gain(equal: np.ndarray) -> tuple[int, int]:
    """How far to extend over these words, and the equal ones among them: where matches less mismatches are most."""
    if not len(equal):
        return 0, 0
    score = np.cumsum(np.where(equal, 1, -2))
    best = int(score.argmax())
    return (best + 1, int(equal[: best + 1].sum())) if score[best] > 0 else (0, 0)


def common_words(x: np.ndarray, y: np.ndarray) -> int:
    """Words in the best alignment of two gaps: by place if they are as long, else a longest common subsequence."""
    if len(x) == len(y):
        return int((x == y).sum())
    row = np.zeros(len(y) + 1, np.int64)
    for word in x:
        diagonal = row[:-1] + (y == word)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], diagonal))
    return int(row[-1])


def widest(left: np.ndarray, right: np.ndarray, size: int, equal: int, similarity: float) -> tuple[int, int, int, int]:
    """How far to extend to either side, and the equal words there: the most words at this similarity that end in equal ones."""
    ends = [np.concatenate([[0], np.flatnonzero(x) + 1]) for x in (left, right)]
    total = size + ends[0][:, None] + ends[1][None, :]
    same = equal + np.arange(len(ends[0]))[:, None] + np.arange(len(ends[1]))[None, :]
    i, j = np.unravel_index(int(np.where(same >= similarity * total, total, -1).argmax()), total.shape)
    return int(ends[0][i]), int(ends[1][j]), int(i), int(j)


def _align(min_words: int, similarity: float):
    return lambda batches: _aligned(batches, min_words, similarity)


def _extended(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``gain`` of many rows; words that are not there count as unequal ones."""
    score = np.cumsum(np.where(equal, 1, -2).astype(np.int16), axis=1, dtype=np.int16)
    best = score.argmax(axis=1)
    rows = np.arange(len(equal))
    more = np.where(score[rows, best] > 0, best + 1, 0)
    upto = np.cumsum(equal, axis=1, dtype=np.int16)
    return more, np.where(more > 0, upto[rows, best], 0).astype(np.int64)


def _widest_of(left: np.ndarray, right: np.ndarray, size: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """``widest`` of many rows, each around so many equal words."""
    n, margin = left.shape
    need = np.ceil(similarity * (size[:, None] + np.arange(2 * margin + 1))).astype(np.int16)
    upto = [np.concatenate([np.zeros((n, 1), np.int16), np.cumsum(x, axis=1, dtype=np.int16)], axis=1) for x in (left, right)]
    ends = [np.concatenate([np.ones((n, 1), bool), x], axis=1) for x in (left, right)]
    after = np.where(ends[1], upto[1], np.int16(-(1 << 14)))
    rows, i, j, most = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)
    for k in range(margin + 1):
        fits = after - need[:, k : k + margin + 1] >= -(size + upto[0][:, k]).astype(np.int16)[:, None]
        furthest = margin - fits[:, ::-1].argmax(axis=1)
        total = np.where(fits[rows, furthest] & ends[0][:, k], k + furthest, -1)
        better = total > most
        i[better], j[better], most[better] = k, furthest[better], total[better]
    return i, j, upto[0][rows, i].astype(np.int64), upto[1][rows, j].astype(np.int64)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of all rows, and the first of each row."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.uint64), (offsets - offsets[0]) // 8


def _aligned_alone(x: tuple, y: tuple, lows: tuple, row: np.ndarray, segs: np.ndarray, min_words: int, similarity: float) -> tuple[np.ndarray, dict]:
    """``_aligned`` of chains of one segment, all at a time; only what is a passage."""
    (x, x_at), (y, y_at) = x, y
    size, place, hub_place = (segs[k].astype(np.int64) for k in ("seg_size", "start", "hub_start"))
    s, h = place - lows[0][row], hub_place - lows[1][row]
    k = np.arange(MARGIN)

    def equal(count: np.ndarray, x_first: np.ndarray, y_first: np.ndarray, step: int) -> np.ndarray:
        inside = k < count[:, None]
        mine, theirs = (np.where(inside, first[:, None] + step * k, 0) for first in (x_first, y_first))
        return (x[mine] == y[theirs]) & inside

    x_first, y_first = x_at[row] + s, y_at[row] + h
    left = equal(np.minimum(s, h), x_first - 1, y_first - 1, -1)
    right = equal(np.minimum(x_at[row + 1] - x_first, y_at[row + 1] - y_first) - size, x_first + size, y_first + size, 1)
    (before, same_before), (after, same_after) = _extended(left), _extended(right)
    long, same = size + before + after, size + same_before + same_after
    # Where gains are small, the similarity alone says how far; only with as many equal words as the least passage has.
    short = (long < min_words) | (same < similarity * long)
    again = np.flatnonzero(short & (size + left.sum(axis=1) + right.sum(axis=1) >= similarity * min_words))
    i, j, more, beyond = _widest_of(left[again], right[again], size[again], similarity)
    wide = size[again] + i + j >= min_words
    again = again[wide]
    before[again], after[again], same[again] = i[wide], j[wide], size[again] + more[wide] + beyond[wide]
    long = size + before + after
    good = np.flatnonzero((long >= min_words) & (same / long >= similarity))
    ends = {"start": place - before, "end": place + size + after, "hub_start": hub_place - before, "hub_end": hub_place + size + after, "equal": same}
    return good, {"chain": segs["chain"][good]} | {k: v[good] for k, v in ends.items()}


def _aligned(batches, min_words: int, similarity: float):
    names = ("doc_id", "hub", "chain", "start", "end", "hub_start", "hub_end", "equal")
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = _texts(batch["words"]), _texts(batch["hub_words"])
        doc, hub, low, hub_low = (batch[k].to_numpy().astype(np.int64) for k in ("doc_id", "hub", "low", "hub_low"))
        segs = np.frombuffer(b"".join(batch["pieces"].to_pylist()), _SEGMENT)
        row = np.repeat(np.arange(batch.num_rows), pc.binary_length(batch["pieces"]).to_numpy() // _SEGMENT.itemsize)
        begins = np.flatnonzero(segs["flags"] & 1)
        count = np.diff(np.append(begins, len(segs)))
        alone = (segs["flags"][begins] == 7) & (count == 1)
        single = begins[alone]
        for at in range(0, len(single), 1 << 11):
            some = single[at : at + (1 << 11)]
            good, given = _aligned_alone(x, y, (low, hub_low), row[some], segs[some], min_words, similarity)
            given = [doc[row[some[good]]], hub[row[some[good]]], *given.values()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in given], names=list(names))
        out = {k: [] for k in names}
        for a, n in zip(begins[~alone].tolist(), count[~alone].tolist()):
            r = int(row[a])
            values = _aligned_piece(*(t[0][t[1][r] : t[1][r + 1]] for t in (x, y)), int(low[r]), int(hub_low[r]), segs[a : a + n], min_words, similarity)
            for key, value in zip(names, (doc[r], hub[r], int(segs["chain"][a]), *values)):
                out[key].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[k], pa.int64()) for k in names], names=list(names))


def _aligned_piece(x: np.ndarray, y: np.ndarray, dx: int, dy: int, segs: np.ndarray, min_words: int, similarity: float) -> tuple[int, ...]:
    flags, at, hub_at = (int(segs[k][0]) for k in ("flags", "start", "hub_start"))
    # Places relative to the words that are here.
    at, hub_at, equal = at - dx, hub_at - dy, 0
    low, hub_low = s0, h0 = at, hub_at
    if flags & 2:
        n = min(at, hub_at, MARGIN)
        more, same = gain((x[at - n : at] == y[hub_at - n : hub_at])[::-1])
        low, hub_low, equal = at - more, hub_at - more, same
    equal0 = equal
    for s, h, size in zip(*(segs[k].tolist() for k in ("seg_start", "seg_hub", "seg_size"))):
        s, h = s - dx, h - dy
        equal += size + (common_words(x[at:s], y[hub_at:h]) if s > at and h > hub_at else 0)
        at, hub_at = s + size, h + size
    if flags & 4:
        n = min(len(x) - at, len(y) - hub_at, MARGIN)
        more, same = gain(x[at : at + n] == y[hub_at : hub_at + n])
        core, ends = (at - s0, hub_at - h0, equal - equal0), (at, hub_at)
        at, hub_at, equal = at + more, hub_at + more, equal + same
        longer = max(at - low, hub_at - hub_low)
        if flags & 2 and (at - low < min_words or equal < similarity * longer):
            # Where gains are small, the similarity alone says how far.
            m = min(s0, h0, MARGIN)
            i, j, before, after = widest((x[s0 - m : s0] == y[h0 - m : h0])[::-1], x[ends[0] : ends[0] + n] == y[ends[1] : ends[1] + n], max(core[:2]), core[2], similarity)
            if core[0] + i + j >= min_words:
                low, hub_low, at, hub_at, equal = s0 - i, h0 - i, ends[0] + j, ends[1] + j, core[2] + before + after
    return low + dx, at + dx, hub_low + dy, hub_at + dy, equal


def repeated_passages(documents: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Passages that an earlier document (smaller doc_id) holds too, exactly or nearly.

    One row per passage and first holder: doc_id, start_word, end_word, other_id, other_start, other_end, n_equal,
    similarity. Words are runs of letters, digits and non-ASCII characters, A-Z folded, numbered from 0. A passage has at
    least ``min_words`` words, and n_equal / the longer side is at least ``similarity``. Rows that share a doc_id are
    one document; repeats inside one document, rows without doc_id, and null, empty or short texts give no passage.
    """
    spark = documents.sparkSession
    cleanup = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # what is written needs its exchanges no more
    try:
        return _repeated_passages(documents, min_words, similarity)
    finally:
        spark.conf.set(CLEANUP, cleanup)


def _then(first, second):
    return lambda batches: second(first(batches))


def _repeated_passages(documents: DataFrame, min_words: int, similarity: float) -> DataFrame:
    spark = documents.sparkSession
    n = partitions(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    seeds = exchanged(docs.mapInArrow(dealt(SEEDS, n, _seeds), PACKED), n)
    found = _aligned_passages(docs, seeds.mapInArrow(dealt(MATCHES, n, _long_matches), PACKED), _chain, min_words, similarity)
    covered = _covered(found)
    # Only texts that may be covered are shuffled to their spans.
    bits = id_filter(covered.select(F.col("doc_id").alias("id")))
    may = docs.mapInArrow(with_ids(bits), docs.schema).join(covered, "doc_id", "left")
    make = dealt(SEEDS, PARTS * n, _short_seeds(min_words))
    seeds = may.mapInArrow(make, PACKED).union(docs.mapInArrow(_then(with_ids(bits, False), make), PACKED))
    short = written(exchanged(seeds, PARTS * n).mapInArrow(_short_dealt(n), PACKED), "short")
    more = _aligned_passages(docs, short.where("kind = 0"), _chain_short, min_words, similarity)
    found = found.union(more).distinct()
    kept = _rarest_shared(short.where("kind = 1"), found, min_words, similarity)
    discard(short)
    rest = _rest_pairs(docs, kept, min_words, similarity)
    others = _aligned_passages(docs, functools.reduce(DataFrame.union, rest), _chain_rest, min_words, similarity)
    discard(kept, *rest)
    # A passage with many holders is given once: not again where it lies within a span that is given.
    wider = Window.partitionBy("doc_id").orderBy("start_word", F.desc("end_word"), "other_id", "other_start", "other_end").rowsBetween(Window.unboundedPreceding, -1)
    others = others.withColumn("reach", F.max("end_word").over(wider)).where("reach IS NULL OR end_word > reach").drop("reach")
    return found.union(others).distinct()


def _covered(found: DataFrame) -> DataFrame:
    span = F.struct("start_word", "end_word", (F.col("similarity") >= ALIKE).alias("alike"))
    return written(found.groupBy("doc_id").agg(F.collect_list(span).alias("spans")), "covered")


def _rarest_shared(shared: DataFrame, found: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """Places of what no passage covers yet (seeks), and of all that they are to be compared with (holds).

    Of the runs of three in a window only those that several documents hold can be shared, and of these only the rarest
    need be compared: the least frequent one that two similar windows share is among them on both sides.
    """
    n = partitions(shared.sparkSession)
    spans = found.selectExpr("doc_id", "start_word << 32 | end_word AS seed", "-1 AS pos", f"IF(similarity >= {ALIKE}, -2, -1) AS n")
    both = exchanged(shared.union(spans.mapInArrow(dealt(SHARED, n), PACKED)), n)
    return written(both.mapInArrow(_rarest_uncovered(min_words, similarity), "doc_id long, seed long, pos int, n int, seeks int, holds int"), "rarest")


def _rest_pairs(docs: DataFrame, kept: DataFrame, min_words: int, similarity: float) -> list[DataFrame]:
    """Matches of these places with every earlier holder of their seed, whatever their number: all pairs of its places, a
    large seed's in cells of parts of its rows, whose words around may be similar."""
    spark = docs.sparkSession
    n = partitions(spark)
    # A place needs the words around it only if an earlier one holds its seed for it, or a later one seeks what it holds.
    kept = kept.select(*[k for k, _ in _KEPT])
    sought = exchanged(kept.mapInArrow(dealt(KEPT, n), PACKED), n).mapInArrow(dealt(WANTED, n, _paired), PACKED)
    both = exchanged(sought.union(docs.mapInArrow(_codes(n), PACKED)), n)
    coded = written(both.mapInArrow(_coded, "doc_id long, codes binary, wanted array<struct<seed: long, pos: int, seeks: int, holds: int, n: int>>"), "coded")
    # Cells take turns, so that disks hold an exchange of a few times the words at a time.
    places = F.expr(f"aggregate(wanted, 0L, (sum, w) -> sum + IF(w.n <= {CELL}, 1, (w.seeks + w.holds) * ceil(w.n / {CELL})))")
    size, rows = coded.agg(F.sum(F.length("codes")), F.sum(places)).first()
    turns = max(1, -(-int(rows or 0) * (2 * _around(min_words)[1] + 32) // max(PASS, TEXTS * int(size or 0))))
    out = []
    for turn in range(turns):
        cells = coded.mapInArrow(_contexts(min_words, turn, turns), "seed long, a int, b int, doc_id long, side int, pos int, words binary")
        cells = cells.repartition(n, "seed", "a", "b").sortWithinPartitions("seed", "a", "b", "doc_id")
        out.append(written(cells.mapInArrow(dealt(MATCHES, n, _rest_matches(min_words, similarity)), PACKED), "rest"))
    discard(coded)
    return out


def _aligned_passages(docs: DataFrame, matches: DataFrame, chain, min_words: int, similarity: float) -> DataFrame:
    """The passages of these packed matches, written; what they were made from goes."""
    n = partitions(docs.sparkSession)
    pieces = written(exchanged(matches, n).mapInArrow(lambda batches: chain(in_order(MATCHES, batches)), _PIECES), "pieces")
    wanted = pieces.select("doc_id", "block").union(pieces.select("hub", "hub_block")).distinct()
    blocks = made_with_ids(docs, wanted.select(F.col("doc_id").alias("id")), _blocks, "doc_id long, block int, words binary")
    # The first of the rows of a document stands for it.
    blocks = written(blocks.join(wanted, ["doc_id", "block"], "left_semi").dropDuplicates(["doc_id", "block"]), "blocks")
    theirs = blocks.select(F.col("doc_id").alias("hub"), F.col("block").alias("hub_block"), F.col("words").alias("hub_words"))

    # Of a block only the words of the pieces and their margins go on.
    def part(words: str, block: str, low: str, high: str) -> Column:
        return F.substring(words, (F.col(low) - F.col(block) * BLOCK) * 8 + 1, (F.col(high) - F.col(low)) * 8)

    mine = pieces.join(blocks, ["doc_id", "block"]).withColumn("words", part("words", "block", "low", "high"))
    both = mine.join(theirs, ["hub", "hub_block"]).withColumn("hub_words", part("hub_words", "hub_block", "hub_low", "hub_high"))
    both = both.drop("block", "hub_block", "high", "hub_high")
    aligned = both.mapInArrow(_align(min_words, similarity), "doc_id long, hub long, chain long, start long, end long, hub_start long, hub_end long, equal long")
    spans = aligned.groupBy("doc_id", "hub", "chain").agg(
        F.min("start").alias("start_word"),
        F.max("end").alias("end_word"),
        F.min("hub_start").alias("other_start"),
        F.max("hub_end").alias("other_end"),
        F.sum("equal").alias("n_equal"),
    )
    longest = F.greatest(F.col("end_word") - F.col("start_word"), F.col("other_end") - F.col("other_start"))
    spans = spans.withColumn("similarity", F.col("n_equal") / longest).where((F.col("similarity") >= similarity) & (F.col("end_word") - F.col("start_word") >= min_words))
    found = spans.select("doc_id", "start_word", "end_word", F.col("hub").alias("other_id"), "other_start", "other_end", "n_equal", "similarity")
    passages = written(found.distinct(), "passages")
    discard(pieces, blocks)
    return passages


@query("op7_collinear_chaining")
def op7_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def _cut(batches):
    for batch in batches:
        words, (data, rows) = words_of(batch["text"], alphanumeric()), text_bytes(batch["text"])
        texts = []
        for row, spans in enumerate(batch["spans"].to_pylist()):
            base, at, kept = int(words.offsets[row]), int(rows[row]), []
            total = int(words.offsets[row + 1]) - base
            for span in spans:
                low, high = min(span["start_word"], total), min(span["end_word"], total)
                if low >= high or words.end[base + high - 1] <= at:
                    continue
                kept.append(data[at : max(at, int(words.start[base + low]))].tobytes())
                at = int(words.end[base + high - 1])
            kept.append(data[at : int(rows[row + 1])].tobytes())
            texts.append(b"".join(kept).decode())
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.string())], names=["row", "text"])


def without_repeats(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` less the passages that an earlier document holds; n_chars, if there, is renewed.

    A document of which nothing but punctuation remains goes; one without repeated passages stays as it is.
    """
    spans = repeated_passages(documents).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start_word", "end_word"))).alias("spans"))
    spans = written(spans.withColumnRenamed("doc_id", "id"), "repeats")
    mine = documents["doc_id"].cast("long") == spans["id"]
    kept = documents.join(spans, mine, "left_anti")
    # Whole rows travel as one struct, so that no column of theirs can clash with these.
    named = documents.join(spans, mine).select(F.struct(*[documents[c] for c in documents.columns]).alias("row"), documents["text"].alias("text"), spans["spans"].alias("spans"))
    row = T.StructType([T.StructField("row", documents.schema), T.StructField("text", T.StringType())])
    cut = named.mapInArrow(_cut, row).where(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    renewed = {"text": F.col("text"), "n_chars": F.length("text")}
    columns = [renewed[f.name].cast(f.dataType).alias(f.name) if f.name in renewed else F.col("row").getField(f.name).alias(f.name) for f in documents.schema]
    return kept.unionByName(cut.select(columns))
