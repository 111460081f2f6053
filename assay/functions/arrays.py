"""Column functions over numeric arrays: one row in, one row out, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions import fixed_values as V
from assay.functions.text import as_col


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(arr: Column | str) -> Column:
    return as_col(arr).cast("array<double>")


def peak_normalize(arr: Column | str) -> Column:
    """Divide by the largest magnitude; an all-zero array gives null."""
    def scale(y: Column) -> Column:
        peak = F.array_max(F.transform(y, F.abs))
        return let(F.nullif(peak, F.lit(0.0)), lambda p: F.when(p.isNotNull(), F.transform(y, lambda v: v / p)))

    return let(doubles(arr), scale)


def squared_norm(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, v: s + v * v)


def l2_normalize(arr: Column | str) -> Column:
    def scale(x: Column) -> Column:
        norm = F.greatest(F.sqrt(squared_norm(x)), F.lit(1e-12))
        return let(norm, lambda n: F.transform(x, lambda v: v / n))

    return let(doubles(arr), scale)


def clip_length(arr: Column | str, rate: int, seconds: int = V.CLIP_SECONDS) -> Column:
    return F.slice(as_col(arr), 1, rate * seconds)


def first_channel(frames: Column | str) -> Column:
    """First entry of every frame of a multi-channel array."""
    return F.transform(as_col(frames), lambda frame: F.get(frame, F.lit(0)))


def frame_size(length: Column, seconds: float, span: float = 30.0) -> Column:
    """``round(length * seconds / span)`` with halves going to the even number."""
    return F.bround(length * F.lit(seconds) / F.lit(span), 0).cast("int")


def frames(arr: Column | str, kernel: Column | int, stride: Column | int) -> Column:
    """Overlapping windows; an incomplete tail is dropped, short input gives an empty array."""
    kernel = F.lit(kernel) if isinstance(kernel, int) else kernel
    stride = F.lit(stride) if isinstance(stride, int) else stride

    def cut(x: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(x) - kernel + 1, stride)
        return F.when(F.size(x) >= kernel, F.transform(starts, lambda i: F.slice(x, i, kernel))).otherwise(
            F.filter(F.array(x), lambda _: F.lit(False))
        )

    return let(as_col(arr), cut)


def standardize(arr: Column | str, mean: Column | float = V.FBANK_MEAN, std: Column | float = V.FBANK_STD) -> Column:
    mean = F.lit(mean) if isinstance(mean, float) else mean
    std = F.lit(std) if isinstance(std, float) else std
    return F.transform(doubles(arr), lambda x: (x - mean) / (F.lit(2.0) * std))


def pad_to(arr: Column | str, length: Column | int) -> Column:
    """Append zeros up to ``length``; longer arrays stay whole."""
    length = F.lit(length) if isinstance(length, int) else length
    return let(
        doubles(arr),
        lambda x: F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(length - F.size(x), F.lit(0)))),
    )


def concat_features(a: Column | str, b: Column | str) -> Column:
    return F.concat(as_col(a), as_col(b))


def chunk_all(mask: Column | str, steps: int) -> Column:
    """Shrink a boolean mask to ``steps`` entries, each true only if its whole run is true.

    The trailing ``len % steps`` entries are dropped first; a mask shorter than ``steps`` gives null.
    """
    def shrink(m: Column) -> Column:
        run = (F.size(m) / F.lit(steps)).cast("int")
        return F.when(
            F.size(m) >= steps,
            F.transform(
                F.sequence(F.lit(0), F.lit(steps - 1)),
                lambda i: F.forall(F.slice(m, i * run + 1, run), lambda x: x),
            ),
        )

    return let(as_col(mask), shrink)


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def softmax(scores: Column | str, temperature: float = 1.0) -> Column:
    """``exp((s - max) / t)`` over its sum, per array."""
    def weigh(s: Column) -> Column:
        raised = let(
            F.array_max(s), lambda top: F.transform(s, lambda v: F.exp((v - top) / F.lit(float(temperature))))
        )
        return let(raised, lambda e: let(total(e), lambda z: F.transform(e, lambda v: v / z)))

    return let(doubles(scores), weigh)


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)


def draw(probabilities: Column | str, uniform: Column) -> Column:
    """0-based index of the first entry whose running sum reaches ``uniform``; the last if none does."""
    state = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("passed"))

    def step(s: Column, p: Column) -> Column:
        mass = s["mass"] + p
        return F.struct(mass.alias("mass"), (s["passed"] + (mass < uniform).cast("int")).alias("passed"))

    probabilities = doubles(probabilities)
    return F.least(F.aggregate(probabilities, state, step, lambda s: s["passed"]), F.size(probabilities) - 1)
