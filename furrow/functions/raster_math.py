"""Pixel and band arithmetic as Column expressions over arrays of band values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.functions.rings import let


def normalise(values: Column, divisor: Column | float = 3000.0) -> Column:
    d = divisor if isinstance(divisor, Column) else F.lit(float(divisor))
    return F.transform(values, lambda v: v / d)


def rgb_unit(values: Column, divisor: float = 3000.0) -> Column:
    """First three bands scaled and clipped to [0, 1]."""
    return F.transform(
        F.slice(values, 1, 3),
        lambda v: F.least(F.greatest(v / F.lit(divisor), F.lit(0.0)), F.lit(1.0)),
    )


def baseline_rescale(values: Column, version: Column, offset: int = 1000) -> Column:
    """Take the radiometric offset of processing version 4 and later out again."""
    return F.when(
        version >= 4, F.transform(values, lambda v: F.greatest(v - F.lit(offset), F.lit(0)))
    ).otherwise(values)


def processing_version(*candidates: Column) -> Column:
    """First parsable version number of the candidates, else 0."""
    return F.coalesce(*[c.try_cast("double") for c in candidates], F.lit(0.0))


def version_status(first: Column, second: Column) -> Column:
    """Warnings a two-scene stack deserves, in one word."""
    used = F.when(second > 0, second).otherwise(first)
    return (
        F.when((first > 0) & (second > 0) & (first != second), F.lit("differs"))
        .when((used < 3) | (used >= 4), F.lit("untested"))
        .otherwise(F.lit("ok"))
    )


# Fixed value: the largest finite single-precision number.
FLOAT_MAX = 3.4028234663852886e38


def fill_nan(v: Column, fill: float = 0.0) -> Column:
    """NaN -> fill, infinities -> the finite extremes."""
    return (
        F.when(F.isnan(v), F.lit(fill))
        .when(v == F.lit(float("inf")), F.lit(FLOAT_MAX))
        .when(v == F.lit(float("-inf")), F.lit(-FLOAT_MAX))
        .otherwise(v)
    )


def softmax(logits: Column) -> Column:
    """Class probabilities of one pixel; shifted by the maximum for stability."""
    def shifted(a: Column) -> Column:
        return let(F.array_max(a), lambda m: F.transform(a, lambda v: F.exp(v - m)))

    return let(
        let(logits, shifted),
        lambda e: let(
            F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v),
            lambda total: F.transform(e, lambda v: v / total),
        ),
    )


def quantise(p: Column) -> Column:
    """Probability -> 0..255, truncated."""
    return F.floor(F.least(F.greatest(p * 255, F.lit(0.0)), F.lit(255.0))).cast("int")


def argmax(scores: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def median_of_two(a: Column, b: Column) -> Column:
    """Two-date median, truncated toward zero."""
    return F.zip_with(a, b, lambda x, y: ((x + y) / 2).cast("int"))


def pixel_to_map(a, b, c, d, e, f, x: Column, y: Column) -> tuple[Column, Column]:
    return a * x + b * y + c, d * x + e * y + f


def map_to_pixel(a, b, c, d, e, f, mx: Column, my: Column) -> tuple[Column, Column]:
    """Inverse affine, not rounded."""
    det = a * e - b * d
    return (e * (mx - c) - b * (my - f)) / det, (a * (my - f) - d * (mx - c)) / det


def nearest_pixel(v: Column) -> Column:
    """Half-to-even rounding to an index."""
    return F.rint(v).cast("int")


def affine_from_bounds(west, south, east, north, width, height) -> dict[str, Column]:
    return {
        "a": (east - west) / width, "b": F.lit(0.0), "c": west * 1.0,
        "d": F.lit(0.0), "e": (south - north) / height, "f": north * 1.0,
    }


def shift_affine(a, b, c, d, e, f, x: Column, y: Column) -> dict[str, Column]:
    """Affine of the sub-window that starts at pixel (x, y)."""
    return {"a": a, "b": b, "c": a * x + b * y + c, "d": d, "e": e, "f": d * x + e * y + f}


def minmax_byte(v: Column, low: Column, high: Column) -> Column:
    """Stretch to 0..255, truncated; a constant band gives 0."""
    return F.when(high > low, ((v - low) / (high - low) * 255).cast("int")).otherwise(F.lit(0))


# Patch sides tried, largest first.
PATCH_SIDES = [1024, 512, 256, 128]


def patch_size(height: Column, width: Column) -> Column:
    """Largest listed side that fits, else null."""
    small = F.least(height, width)
    return F.coalesce(*[F.when(small >= s, F.lit(s)) for s in PATCH_SIDES])


def patch_padding(size: Column) -> Column:
    return F.ceil(F.least(size, F.lit(1024)) / 16).cast("int")


def patch_stride(size: Column, padding: Column, check: bool = True) -> Column:
    """Step between patches; raises when the geometry is unusable."""
    stride = size - padding * 2
    if not check:
        return stride
    return (
        F.when(size.isNull(), F.raise_error(F.lit("raster is smaller than every patch size")))
        .when(size % 32 != 0, F.raise_error(F.lit("patch size must be a multiple of 32")))
        .when(stride <= 64, F.raise_error(F.lit("patch size minus padding must exceed 64")))
        .otherwise(stride)
    )


def window_pair(values: Column, bands: int = 4) -> Column:
    """Flat (time x band) channels -> one array per date."""
    return F.array(F.slice(values, 1, bands), F.slice(values, bands + 1, bands))


def select_windows(window_a: Column, window_b: Column, option: str, swap: bool = False,
                   pick_a: Column | None = None) -> Column:
    """Channels of one sample under a temporal option; B comes before A."""
    pair = [window_b, window_a]
    if option in ("rgb", "window_a_rgb", "window_b_rgb"):
        pair = [F.slice(w, 1, 3) for w in pair]
    b, a = pair
    if option in ("windowA", "window_a_rgb"):
        return a
    if option in ("windowB", "window_b_rgb"):
        return b
    if option == "random_window":
        if pick_a is None:
            raise ValueError("random_window needs a boolean pick_a column")
        return F.when(pick_a, a).otherwise(b)
    if option == "median":
        return median_of_two(a, b)
    if option in ("stacked", "rgb"):
        return F.concat(a, b) if swap else F.concat(b, a)
    raise ValueError(f"unknown temporal option {option!r}")


def shuffle_windows(values: Column, keep: Column, bands: int = 4) -> Column:
    """Swap the two dates' channels unless ``keep``."""
    return F.when(keep, values).otherwise(
        F.concat(F.slice(values, bands + 1, bands), F.slice(values, 1, bands))
    )


def gaussian_kernel(size: int, sigma: float) -> list[float]:
    half = size // 2
    raw = [math.exp(-((i - half) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [r / sum(raw) for r in raw]


def mean_pool(values: Column, size: int) -> Column:
    """Mean of each ``size`` consecutive values (of a channel's cells); a shorter rest is pooled too."""
    def pooled(start: Column) -> Column:
        part = F.slice(values, start + 1, F.lit(size))
        return F.aggregate(part, F.lit(0.0), lambda acc, v: acc + v) / F.size(part)

    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.size(values) - 1, F.lit(size)), pooled)).otherwise(F.slice(values, 1, 0))
