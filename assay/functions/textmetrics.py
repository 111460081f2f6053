"""BLEU and token-overlap scores as Column expressions.

Each score needs one text pair only: no explode and no shuffle. Tokens and n-grams are compared as 64-bit hashes. Texts
are tokenised for BLEU, and n-grams counted, over whole Arrow batches; token multisets are compared inside the row, by hash set, and by one
merge of their sorted repeats only where both sides have repeats.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions import fixed_values as V
from assay.functions.arrays import let
from assay.functions.text import as_col, language_parts, strip

MAX_ORDER = 4


def _split_spaces(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{V.SPACE_CLASS}+"), "")


def _one_of(chars: str) -> str:
    """Character class that lists its members: a plain bit set, many times faster in Java than a union of ranges."""
    return "[" + "".join(f"\\{c}" if not c.isalnum() else c for c in chars) + "]"


# Separation rules of the 13a tokeniser (public; fixed values). Its first class also holds the space, which only
# multiplies spaces and is left out.
SYMBOLS_13A = "{|}~[\\]^_`!\"#$%&()*+:;<=>?@/"
RULES_13A = [
    (f"({_one_of(SYMBOLS_13A)})", " $1 "),
    (r"([^0123456789])([.,])", "$1 $2 "),
    (r"([.,])([^0123456789])", " $1 $2"),
    (r"([0123456789])(-)", "$1 $2 "),
]
ENTITIES_13A = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def _separate(text: Column) -> Column:
    for pattern, replacement in RULES_13A:
        text = F.regexp_replace(text, pattern, replacement)
    return _split_spaces(text)


def _plain_13a(text: Column | str) -> Column:
    out = F.rtrim(as_col(text), F.lit(V.SPACES))
    for old, new in [("<skipped>", ""), ("-\n", ""), ("\n", " "), *ENTITIES_13A]:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.concat(F.lit(" "), out, F.lit(" "))


def tokenize_13a(text: Column | str) -> Column:
    return _separate(_plain_13a(text))


def tokenize_zh(text: Column | str) -> Column:
    """Put every CJK character on its own, then separate like 13a."""
    return _separate(F.regexp_replace(strip(text), f"({V.CJK_CLASS})", " $1 "))


def bleu_text(text: Column | str, base_code: str = "en") -> Column:
    """The text as the tokeniser of a target language prepares it; Japanese needs a dictionary that is not bundled."""
    if base_code == "ja":
        raise ValueError("Japanese BLEU needs a morphological tokeniser; none is bundled")
    return strip(text) if base_code == "zh" else _plain_13a(text)


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays.

    Common distinct entries count once each, by a hash set. Without repeats on either side that is all; else the overlap
    of the repeats, the entries of either sorted array that equal the one before them, is added.
    """
    def repeats(s: Column) -> Column:
        return F.filter(s, lambda t, i: t == F.get(s, i - 1))

    def of_repeats(pair: Column) -> Column:
        sorted_ = F.struct(F.sort_array(pair["a"]).alias("a"), F.sort_array(pair["b"]).alias("b"))
        return let(let(sorted_, lambda s: F.struct(repeats(s["a"]).alias("a"), repeats(s["b"]).alias("b"))), _merge_overlap)

    def count(pair: Column) -> Column:
        common = F.size(F.array_intersect(pair["a"], pair["b"]))
        plain = [F.size(F.array_distinct(pair[k])) == F.size(pair[k]) for k in ("a", "b")]
        return common + F.when(plain[1] | plain[0], F.lit(0)).otherwise(of_repeats(pair))

    return let(F.struct(a.alias("a"), b.alias("b")), count)


def hashed(tokens: Column) -> Column:
    """Tokens as 64-bit hashes, which compare and sort as numbers."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _merge_overlap(pair: Column) -> Column:
    """Overlap of the sorted arrays ``a`` and ``b``: one merge step per entry."""
    x, y = pair["a"], pair["b"]
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("hits"))

    def move(s: Column, i: int, j: int) -> Column:
        return F.struct((s["i"] + i).alias("i"), (s["j"] + j).alias("j"), (s["hits"] + i * j).alias("hits"))

    def step(s: Column, _: Column) -> Column:
        u, v = F.get(x, s["i"]), F.get(y, s["j"])
        # Past the end of either array the comparison is null and the state stays.
        return F.when(u == v, move(s, 1, 1)).when(u < v, move(s, 1, 0)).when(u > v, move(s, 0, 1)).otherwise(s)

    steps = F.sequence(F.lit(1), F.size(x) + F.size(y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.aggregate(steps, start, step, lambda s: s["hits"])).otherwise(0)


SLICE_TOKENS = 1 << 20  # tokens, or characters of untokenised texts, of either side that are compared at a time; bounds the temporaries
SLICE_ROWS = 1 << 10  # and rows, whose number takes up bits of a key


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _gram_keys(tokens: np.ndarray, row: np.ndarray, ends: np.ndarray, bits: int):
    """For every order, a key of each (row, n-gram): the row in so many high bits, below them a rolling hash, which takes in
    one token more each time."""
    left = ends[row] - np.arange(len(tokens))
    grams = _mixed(tokens + np.uint64(1))
    high = row.astype(np.uint64) << np.uint64(64 - bits) if bits else np.zeros(len(row), np.uint64)
    for order in range(1, MAX_ORDER + 1):
        if order > 1:
            grams = _mixed(grams[:-1] * np.uint64(0x9E3779B97F4A7C15) + tokens[order - 1 :])
            left, high = left[:-1], high[:-1]
        whole = left >= order
        yield grams[whole] >> np.uint64(bits) | high[whole]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and how often each is there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


SPACE, CJK, SYMBOL, DIGIT, POINT = 1, 2, 4, 8, 16


@functools.cache
def _char_classes() -> np.ndarray:
    """The classes of each code point up to 0xFFFF; the entry after them stands for all others, which have none."""
    known = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    out = np.zeros(0x10001, np.uint8)
    spelled = lambda pattern: re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern)
    for kind, pattern in ((SPACE, spelled(V.SPACE_CLASS)), (CJK, spelled(V.CJK_CLASS)), (SYMBOL, _one_of(SYMBOLS_13A)), (DIGIT, "[0-9]"), (POINT, "[.,]")):
        out[[ord(c) for c in re.findall(pattern, known)]] |= kind
    return out


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts (null: none), and the offsets of the texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    try:
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        starts = np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])
        return points, starts[at - at[0]]
    except UnicodeDecodeError:  # bytes that are no UTF-8 are replaced, text by text
        parts = [np.frombuffer(raw[a:b].tobytes().decode(errors="replace").encode("utf-32-le"), np.uint32) for a, b in zip(at[:-1] - at[0], at[1:] - at[0])]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def token_hashes(texts: pa.Array, cjk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens that the rules above make of prepared texts, and the offsets of the texts; characters of ``cjk``
    rows stand alone where they are Chinese.

    The rules in closed form: symbols stand alone; so does a hyphen after a digit; so do points and commas, but for the last
    one of a row of them that the second rule did not take (the second, fourth, ... after another character, the first, third,
    ... after a digit or at the start) and that stands before a digit or at the end.
    """
    points, offsets = _code_points(texts)
    n = len(points)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    kind = _char_classes()[np.minimum(points, 0x10000)]
    lead = np.zeros(n + 1, bool)  # first characters of texts; the end counts as one
    lead[offsets] = True
    lead[n] = True
    alone = kind & SYMBOL > 0
    if cjk.any():
        alone |= (kind & CJK > 0) & np.repeat(cjk, np.diff(offsets))
    digit = kind & DIGIT > 0
    dash = np.flatnonzero(points == ord("-"))
    alone[dash] = ~lead[dash] & digit[dash - 1]
    at = np.flatnonzero(kind & POINT)
    if len(at):
        first = np.append(True, np.diff(at) != 1) | lead[at]
        run = np.flatnonzero(first)[np.cumsum(first) - 1]
        odd = (np.arange(len(at)) - run) % 2 == 0
        head = at[run]
        after_other = ~lead[head] & ~digit[head - 1]
        last = np.append(first[1:], True)
        before_digit = lead[at + 1] | digit[np.minimum(at + 1, n - 1)]
        alone[at] = ~(last & (odd != after_other) & before_digit)
    shown = kind & SPACE == 0
    start = shown.copy()
    start[1:] &= ~shown[:-1] | alone[1:] | alone[:-1] | lead[1:n]
    starts = np.flatnonzero(start)
    sizes = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), sizes
    # A token's hash is the sum over its characters and their places in it.
    which = np.cumsum(start) - 1
    place = np.arange(n) - starts[np.maximum(which, 0)]
    values = _mixed(points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(1))
    values[~shown] = 0
    return _mixed(np.add.reduceat(values, starts)), sizes


def _hashes_of_lists(hyp: pa.Array, ref: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the tokens of two arrays of token lists, equal ones the same, and the offsets of the lists."""
    flat = [side.flatten() for side in (hyp, ref)]
    codes = pa.concat_arrays(flat).dictionary_encode().indices.to_numpy().astype(np.uint64)
    sizes = [pc.fill_null(pc.list_value_length(side), 0).to_numpy(zero_copy_only=False) for side in (hyp, ref)]
    return list(zip((codes[: len(flat[0])], codes[len(flat[0]) :]), (np.concatenate([[0], np.cumsum(s, dtype=np.int64)]) for s in sizes)))


def matches_of_rows(hyp: pa.Array, ref: pa.Array, cjk: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clipped n-gram matches (rows x orders) and lengths in tokens of each row: of token lists, or with ``cjk`` of prepared texts."""
    hits = np.zeros((len(hyp), MAX_ORDER), np.int64)
    sizes = np.zeros((2, len(hyp)), np.int64)
    length = pc.list_value_length if cjk is None else pc.utf8_length
    bounds = [np.concatenate([[0], np.cumsum(pc.fill_null(length(side), 0).to_numpy(zero_copy_only=False), dtype=np.int64)]) for side in (hyp, ref)]
    low = 0
    while low < len(hyp):
        # As many rows as fit, at least one.
        far = min(int(np.searchsorted(b, b[low] + SLICE_TOKENS, "right")) - 1 for b in bounds)
        high = min(len(hyp), low + SLICE_ROWS, max(low + 1, far))
        bits = (high - low - 1).bit_length()
        parts = [side.slice(low, high - low) for side in (hyp, ref)]
        tokenised = _hashes_of_lists(*parts) if cjk is None else [token_hashes(part, cjk[low:high]) for part in parts]
        sides = []
        for k, (tokens, ends) in enumerate(tokenised):
            sizes[k, low:high] = np.diff(ends)
            sides.append(_gram_keys(tokens, np.repeat(np.arange(high - low), np.diff(ends)), ends[1:], bits))
        for order, (a, b) in enumerate(zip(*sides)):
            (a, n), (b, m) = _counted(a), _counted(b)
            if not len(a) or not len(b):
                continue
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            both = np.flatnonzero(b[at] == a)
            rows = (a[both] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(both), np.int64)
            hits[low:high, order] = np.bincount(rows, np.minimum(n[both], m[at[both]]), high - low)
        low = high
    return hits, sizes[0], sizes[1]


def bleu_of_matches(hits: np.ndarray, hyp_len: np.ndarray, ref_len: np.ndarray) -> np.ndarray:
    """Exponentially smoothed BLEU (0..100) of each row from its clipped matches per order."""
    totals = np.maximum(hyp_len[:, None] - np.arange(MAX_ORDER), 0)
    halvings = 2.0 ** np.cumsum(hits == 0, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(hits == 0, 100.0 / (halvings * totals), 100.0 * hits / totals)
        brevity = np.where(hyp_len >= ref_len, 1.0, np.exp(1.0 - ref_len / hyp_len))
        score = brevity * np.exp(np.log(share).sum(axis=1) / MAX_ORDER)
    return np.where((hyp_len >= MAX_ORDER) & (hits > 0).any(axis=1), score, 0.0)


def _scores(hyp: pa.Array, ref: pa.Array, cjk: np.ndarray | None) -> pa.Array:
    missing = pc.or_(pc.is_null(hyp), pc.is_null(ref)).to_numpy(zero_copy_only=False)
    return pa.array(bleu_of_matches(*matches_of_rows(hyp, ref, cjk)), pa.float64(), mask=missing)


def _bleu(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    return _scores(hyp, ref, None)


def _bleu_of_texts(hyp: pa.Array, ref: pa.Array, cjk: pa.Array) -> pa.Array:
    return _scores(hyp, ref, pc.fill_null(cjk, False).to_numpy(zero_copy_only=False).astype(bool))


def bleu_of_tokens(hyp_tokens: Column, ref_tokens: Column) -> Column:
    """BLEU of two token arrays, over Arrow batches: one vectorised pass for each order."""
    return F.arrow_udf(_bleu, T.DoubleType())(hyp_tokens, ref_tokens)


def bleu_of_texts(hyp: Column, ref: Column, cjk: Column) -> Column:
    """BLEU of two prepared texts, which are tokenised over Arrow batches too."""
    return F.arrow_udf(_bleu_of_texts, T.DoubleType())(hyp, ref, cjk)


def sentence_bleu(hyp: Column | str, ref: Column | str, base_code: str = "en") -> Column:
    """BLEU (0..100) of one pair taken as a corpus of one sentence; null if either text is null."""
    return bleu_of_texts(bleu_text(hyp, base_code), bleu_text(ref, base_code), F.lit(base_code == "zh"))


def pair_bleu(hyp: Column | str, ref: Column | str, pair: Column | str) -> Column:
    """BLEU with the tokeniser of each row's pair code (``en_zh-CN``): Chinese for zh targets, else 13a.

    A Japanese target fails the job: its tokeniser needs a dictionary that is not bundled.
    """
    base = language_parts(pair)[2]
    refuse = F.raise_error(F.lit("Japanese BLEU needs a morphological tokeniser; none is bundled")).cast("string")
    text = lambda t: F.when(base == "ja", refuse).when(base == "zh", bleu_text(t, "zh")).otherwise(bleu_text(t))
    return bleu_of_texts(text(hyp), text(ref), base == "zh")


def answer_tokens(text: Column | str) -> Column:
    """Lower-cased words without ASCII punctuation."""
    return _split_spaces(F.regexp_replace(F.lower(as_col(text)), _one_of(V.PUNCTUATION), ""))


def f1_of_tokens(a: Column, b: Column) -> Column:
    sizes = F.size(a) + F.size(b)
    return F.when(sizes == 0, F.lit(1.0)).otherwise(F.lit(2.0) * multiset_overlap(hashed(a), hashed(b)) / F.nullif(sizes, F.lit(0)))


def token_f1(hyp: Column | str, ref: Column | str) -> Column:
    """Token-overlap F1 of a candidate and one reference; two empty answers agree."""
    hyp, ref = as_col(hyp), as_col(ref)
    pair = F.struct(answer_tokens(hyp).alias("h"), answer_tokens(ref).alias("r"))
    return F.when(hyp.isNotNull() & ref.isNotNull(), let(pair, lambda p: f1_of_tokens(p["h"], p["r"])))


Scorer = Callable[[Column, Column], Column]


def best_over_references(refs: Column | str, hyp: Column | str, scorer: Scorer = token_f1) -> Column:
    """Highest score of a candidate over all its references; null without references."""
    hyp = as_col(hyp)
    return F.array_max(F.transform(as_col(refs), lambda r: scorer(hyp, r)))
