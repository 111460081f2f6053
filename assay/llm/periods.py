"""Periodic runs of words: maximal stretches that repeat a shorter one, found by longest common extensions.

Suffixes whose place falls into a difference cover (residues of which any two places reach two by the same shift) are sorted
as sequences of blocks of ``COVER`` words, by prefix doubling. A longest common extension of two places compares the few
words up to the shift that brings both into the cover, takes the least common prefix of the sorted samples between (a sparse
table answers it), and compares the words of one last block. Runs are found on harmonic grids: one of period q holds some
i = 0, q, 2q, ... with i, i + q and i + 2q inside, so for each q only n / q places are extended, to the right by one
extension, to the left by halving.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.registry import query, table
from assay.llm.words import mix, shingles, unspaced, words_of

# A perfect difference set: every residue modulo 31 is the difference of two of these (fixed values).
COVER = 31
RESIDUES = np.array([1, 5, 11, 24, 25, 27])
MIN_WORDS = 24
MIN_PERIODS = 3
GRID = 1 << 19  # places of grids that are looked at at a time; bounds the temporaries


def _shifts() -> np.ndarray:
    """For two residues, the least shift that brings both into the cover."""
    inside = np.isin(np.arange(2 * COVER) % COVER, RESIDUES)
    places = np.arange(COVER)
    out = np.full((COVER, COVER), -1, np.int64)
    for shift in range(COVER - 1, -1, -1):
        out[np.ix_(inside[places + shift], inside[places + shift])] = shift
    return out


SHIFTS = _shifts()


class Extensions:
    """Longest common extensions to the right in ``words``, a sequence of 64-bit words without equal suffixes."""

    def __init__(self, words: np.ndarray, longest: int):
        """``longest`` bounds every extension that will be asked for."""
        n = len(words)
        rows = n // COVER + 2
        # Beyond the end stand words of their own.
        self.words = np.concatenate([words, mix(np.arange(1, (rows + 2) * COVER - n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))])
        places = (np.arange(rows)[:, None] * COVER + RESIDUES).ravel()
        d = len(RESIDUES)
        # The rank of a sample among all by its first 1, 2, 4, ... blocks; the next block is a row of the grid further.
        self.rank = [np.unique(shingles(self.words, COVER)[places], return_inverse=True)[1].astype(np.int64)]
        while int(self.rank[-1].max()) + 1 < len(places) and (COVER << len(self.rank) - 1) <= longest:
            step, now = d << len(self.rank) - 1, self.rank[-1]
            then = np.zeros(len(now), np.int64)
            then[:-step] = now[step:] + 1
            self.rank.append(np.unique(now * (len(now) + 1) + then, return_inverse=True)[1].astype(np.int64))
        order = np.argsort(self.rank[-1], kind="stable")
        self.place = np.empty(len(order), np.int32)
        self.place[order] = np.arange(len(order), dtype=np.int32)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int32)
        for level in range(len(self.rank) - 1, -1, -1):
            step, rank = d << level, self.rank[level]
            fits = np.flatnonzero((a < len(rank)) & (b < len(rank)))
            fits = fits[rank[a[fits]] == rank[b[fits]]]
            a[fits] += step
            b[fits] += step
            common[fits] += 1 << level
        self.rank = []
        self.least = [common]
        while 2 << len(self.least) - 1 <= len(common):
            half = 1 << len(self.least) - 1
            last = self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))
        self.column = np.full(COVER, -1)
        self.column[RESIDUES] = np.arange(d)

    def _direct(self, i: np.ndarray, j: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, of ``upto`` at most."""
        out = np.zeros(len(i), np.int64)
        alive = np.flatnonzero(upto > 0)
        t = 0
        while len(alive):
            alive = alive[self.words[i[alive] + t] == self.words[j[alive] + t]]
            t += 1
            out[alive] = t
            alive = alive[upto[alive] > t]
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from each place of i and of j (different ones) on."""
        shift = SHIFTS[i % COVER, j % COVER]
        out = self._direct(i, j, shift)
        on = np.flatnonzero(out == shift)
        if not len(on):
            return out
        a, b = i[on] + shift[on], j[on] + shift[on]
        x = self.place[a // COVER * len(RESIDUES) + self.column[a % COVER]]
        y = self.place[b // COVER * len(RESIDUES) + self.column[b % COVER]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp(high - low)[1] - 1
        blocks = np.empty(len(on), np.int64)
        for k in np.unique(level):
            at = level == k
            blocks[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << k)])
        # What is left differs within one block.
        rest = self._direct(a + blocks * COVER, b + blocks * COVER, np.full(len(on), COVER))
        out[on] += blocks * COVER + rest
        return out


def _grid(words: np.ndarray, base: np.ndarray, size: np.ndarray):
    """Places i and periods q with words i, i + q and i + 2q of one text equal, i a multiple of q from its start; in slices."""
    periods = size // MIN_PERIODS
    text = np.repeat(np.arange(len(size)), periods)
    q = np.arange(1, len(text) + 1) - np.repeat(np.cumsum(periods) - periods, periods)
    steps = (size[text] - 1) // q - 1
    ends = np.cumsum(steps)
    done = 0
    while done < len(text):
        before = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, before + GRID, "right")))
        count = steps[done:upto]
        pair = np.repeat(np.arange(done, upto), count)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
        period = q[pair]
        i = base[text[pair]] + k * period
        same = np.flatnonzero(words[i] == words[i + period])
        same = same[words[i[same]] == words[i[same] + 2 * period[same]]]
        yield text[pair[same]], i[same], period[same]
        done = upto


def runs(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start (from the start of the text), length and period of all runs, by text, start and period.

    Text t is ``words[offsets[t]:offsets[t + 1]]``. A run has its smallest period q, ``max(MIN_WORDS, MIN_PERIODS * q)`` words
    at least, and no neighbouring word that keeps the period.
    """
    base, size = offsets[:-1], np.diff(offsets)
    long = np.flatnonzero(size >= MIN_WORDS)
    found = []
    for t, i, q in _grid(words, base[long], size[long]):
        t = long[t]
        # The first place of the grid in a run has at least so many equal words ahead; the first few are compared at once.
        need = np.maximum(MIN_WORDS, MIN_PERIODS * q) - 2 * q + 1
        for ahead in range(1, 8):
            on = i + q + ahead < offsets[t + 1]
            on[on] = words[i[on] + ahead] == words[i[on] + q[on] + ahead]
            keep = on | (need <= ahead)
            t, i, q, need = t[keep], i[keep], q[keep], need[keep]
        found.append((t, i, q, need))
    t, i, q, need = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else [()] * 4))
    if not len(t):
        return (np.zeros(0, np.int64),) * 4
    # Only texts with candidates are sorted; a word of its own after each ends every extension there.
    chosen, at = np.unique(t, return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size[chosen] + 1)])
    joined = np.empty(int(start[-1]), np.uint64)
    ends = mix(np.arange(1, len(chosen) + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
    for k, c in enumerate(chosen):
        joined[start[k] : start[k + 1] - 1] = words[offsets[c] : offsets[c + 1]]
    joined[start[1:] - 1] = ends
    lce = Extensions(joined, int(size[chosen].max()))
    first = start[at]
    i = i - base[t] + first
    ahead = lce.common(i, i + q)
    keep = ahead >= need
    at, first, i, q, ahead = at[keep], first[keep], i[keep], q[keep], ahead[keep]
    # Not the first place of the grid in its run: the one before reaches this one.
    back = np.flatnonzero(i - q >= first)
    keep = np.ones(len(i), bool)
    keep[back] = lce.common(i[back] - q[back], i[back]) < q[back]
    at, first, i, q, ahead = at[keep], first[keep], i[keep], q[keep], ahead[keep]
    # How far back the period holds: between low and high words.
    low, high = np.zeros(len(i), np.int64), np.minimum(q - 1, i - first)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        half = (low[open_] + high[open_] + 1) // 2
        holds = lce.common(i[open_] - half, i[open_] - half + q[open_]) >= half
        low[open_[holds]] = half[holds]
        high[open_[~holds]] = half[~holds] - 1
        open_ = open_[low[open_] < high[open_]]
    begin, length = i - low, low + q + ahead
    keep = length >= np.maximum(MIN_WORDS, MIN_PERIODS * q)
    at, begin, length, q, first = at[keep], begin[keep], length[keep], q[keep], first[keep]
    # Multiples of a period give the same stretch: the smallest is its period.
    order = np.lexsort((q, length, begin))
    at, begin, length, q, first = at[order], begin[order], length[order], q[order], first[order]
    keep = np.ones(len(q), bool)
    keep[1:] = (np.diff(begin) != 0) | (np.diff(length) != 0)
    order = np.flatnonzero(keep)
    order = order[np.lexsort((q[order], begin[order]))]
    return chosen[at[order]], begin[order] - first[order], length[order], q[order]


def strongest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """The run with the greatest length / period, exactly; then the smallest start, then period. Runs stand in that order."""
    ratio = length / period
    near = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-9))
    return int(max(near, key=lambda r: (Fraction(int(length[r]), int(period[r])), -r)))


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int]:
    """Place and period from which the words of a document are made to repeat; (n, 1) for none."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return n, 1
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def with_repeated_tails(ids: list[int | None], offsets: np.ndarray) -> np.ndarray:
    """For each word of a batch, the word that stands in its place once the tails repeat."""
    which = np.arange(offsets[-1])
    for row, doc_id in enumerate(ids):
        low, high = int(offsets[row]), int(offsets[row + 1])
        a, p = repeated_tail(doc_id, high - low)
        which[low + a : high] = low + a + np.arange(high - low - a) % p
    return which


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with a space after each, as bytes, and where each begins."""
    size = end - start + 1
    at = np.concatenate([[0], np.cumsum(size)])
    if not len(start):
        return np.zeros(0, np.uint8), at
    source = np.arange(at[-1]) + np.repeat(start - at[:-1], size)
    out = data[np.minimum(source, len(data) - 1)]
    out[at[1:] - 1] = 0x20
    return out, at


_RUN = "struct<start:bigint,length:bigint,period:bigint>"
_FOUND = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _run_batches(tails: bool):
    def find(batches):
        for batch in batches:
            words = words_of(batch["text"], unspaced(), fold=False)
            offsets, n = words.offsets, batch.num_rows
            which = with_repeated_tails(batch["doc_id"].to_pylist(), offsets) if tails else np.arange(offsets[-1])
            text, start, length, period = runs(words.hash[which], offsets)
            bounds = np.searchsorted(text, np.arange(n + 1))
            # A word goes where more runs have begun (after their first period) than ended.
            change = np.zeros(int(offsets[-1]) + 1, np.int64)
            np.add.at(change, offsets[text] + start + period, 1)
            np.add.at(change, offsets[text] + start + length, -1)
            kept = np.flatnonzero(np.cumsum(change)[:-1] == 0)
            data, at = _joined(words.data, words.start[which[kept]], words.end[which[kept]])
            of_text = at[np.searchsorted(kept, offsets)]
            best, digests = [], []
            for row in range(n):
                low, high = bounds[row], bounds[row + 1]
                best.append(None if low == high else int(low) + strongest(start[low:high], length[low:high], period[low:high]))
                digests.append(hashlib.sha256(data[of_text[row] : max(of_text[row], of_text[row + 1] - 1)]).hexdigest())
            found = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], fields=list(_FOUND))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), found)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(offsets[1:] - offsets[:-1]), lists, found.take(pa.array(best, pa.int64())), pa.array(digests)],
                names=["doc_id", "n_words", "runs", "strongest", "collapsed_sha256"],
            )

    return find


def periodic_runs(documents: DataFrame, tails: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_words, runs (start, length, period of each, by start, then period), strongest (the
    run with the greatest length / period) and collapsed_sha256, the digest of the words that are left when each run keeps
    its first period only, joined by one space.

    Words are what white space parts, as they are written. ``tails`` first lets a tenth of the documents repeat themselves,
    as ``repeated_tail`` says. A null text has no words; texts of fewer than ``MIN_WORDS`` words have no runs; one of any
    length is taken whole, in one task. Rows may repeat, doc_id may be null, an empty table gives an empty result; other
    columns are not looked at.
    """
    kind = f"doc_id long, n_words long, runs array<{_RUN}>, strongest {_RUN}, collapsed_sha256 string"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_run_batches(tails), kind)


@query("op13_difference_cover_runs")
def op13_difference_cover_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), tails=True)
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )
