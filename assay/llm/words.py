"""Words of whole text columns as numpy arrays: one pass over the bytes of an Arrow batch, no loop over rows.

Words are maximal runs of word bytes in UTF-8, A-Z folded to a-z unless told not to. A word is known by a 64-bit hash of its bytes, a
shingle by a 64-bit hash of its words. Every hash is a fixed function, so all tasks and retries agree on it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 15  # bytes hashed at a time, so that the 64-bit temporaries stay in the cache
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _codes(fold: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    if fold:
        codes[65:91] = codes[97:123]
    return codes


def alphanumeric() -> np.ndarray:
    """Word bytes: digits, letters, and everything beyond ASCII."""
    keep = np.ones(256, bool)
    keep[:0x30] = keep[0x3A:0x41] = keep[0x5B:0x61] = keep[0x7B:0x80] = False
    return keep


def unspaced() -> np.ndarray:
    """Word bytes: all but the space and the five ASCII line and tab controls."""
    keep = np.ones(256, bool)
    keep[0x20] = keep[0x09:0x0E] = False
    return keep


@dataclass
class Words:
    """Words of a column: ``hash``, byte ``start`` and ``end`` in ``data``; row i has words ``offsets[i]:offsets[i+1]``."""

    data: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def text(self, first: int, last: int) -> str:
        """The words first..last-1 with single spaces, A-Z folded."""
        folded = (bytes(self.data[self.start[i] : self.end[i]]).lower() for i in range(first, last))
        return b" ".join(folded).decode("utf-8", "replace")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; a null row is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def words_of(column: pa.Array, word_bytes: np.ndarray, fold: bool = True) -> Words:
    data, rows = text_bytes(column)
    inside = np.frombuffer(data.tobytes().translate(word_bytes.tobytes()), bool)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = rows[(rows > 0) & (rows < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(start), np.uint64)
    codes, inverse = _codes(fold), pow(int(_BASE), -1, 1 << 64)
    done = 0
    power = back = np.zeros(0, np.uint64)
    while done < len(start):
        # The words of this block, at least one, however long.
        low = start[done]
        upto = max(done + 1, int(np.searchsorted(end, low + BLOCK, "right")))
        size = int(end[upto - 1] - low)
        if len(power) < size:
            power, back = powers(int(_BASE), size), powers(inverse, size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(np.take(codes, data[low : low + size]) * power[:size], out=sums[1:])
        s, e = start[done:upto] - low, end[done:upto] - low
        hashes[done:upto] = mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64))
        done = upto
    return Words(data, hashes, start, end, np.searchsorted(start, rows).astype(np.int64))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from every position on; the last k-1 positions are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += hashes[j : j + n]
    return mix(out + np.uint64(k))


def window_starts(offsets: np.ndarray, k: int) -> np.ndarray:
    """Positions from which k words lie in one row."""
    n = int(offsets[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    whole = np.ones(n, bool)
    for j in range(1, k):
        at = offsets[1:-1] - j
        whole[at[(at >= 0) & (at < n)]] = False
    return np.flatnonzero(whole)
