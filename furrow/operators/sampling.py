"""Subsampling and augmentation. Draws come from key hashes, so reruns give the same rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.text import hash_unit
from furrow.operators.graph import dense_index


def subsample(samples: DataFrame, key: list[str], split: str = "train", num_samples: int = -1,
              percent: float = -1.0, seed: int = 42) -> DataFrame:
    """Seeded subset without replacement, of the training split only; other splits stay whole.

    The sample is the first n rows in hash order, numbered without a single-task sort.
    """
    whole = samples.filter(F.col("split") == split)
    if split != "train" or (num_samples == -1 and percent == -1.0):
        return whole
    # the digest orders; the key breaks ties
    order = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    ranked = dense_index(whole.withColumn("_h", order), [F.col("_h"), *[F.col(k) for k in key]], "_rank")
    if percent != -1.0:
        total = ranked.select(F.count(F.lit(1))).scalar()
        wanted = F.greatest(F.lit(1), F.floor(total * F.lit(percent) / 100))
    else:
        wanted = F.lit(num_samples)
    return ranked.filter(F.col("_rank") < wanted).drop("_h", "_rank")


def coin(*keys: Column, seed: int) -> Column:
    """Fair coin per key."""
    return hash_unit(*keys, seed=seed) < 0.5


def flip_cells(cells: DataFrame, horizontal: Column, vertical: Column, height: Column, width: Column) -> DataFrame:
    """Mirror image and mask together by index arithmetic."""
    return cells.withColumns({
        "x": F.when(horizontal, width - 1 - F.col("x")).otherwise(F.col("x")),
        "y": F.when(vertical, height - 1 - F.col("y")).otherwise(F.col("y")),
    })


def random_divisor(key: Column, seed: int = 42) -> Column:
    """Per image, uniform in [1500, 4500)."""
    return F.lit(1500.0) + F.lit(3000.0) * hash_unit(key, seed=seed)


def brightness(values: Column, key: Column, seed: int = 42) -> Column:
    """Scale by U[0.5, 1.5) for half of the images; results stay in [0, 1]."""
    factor = F.lit(0.5) + hash_unit(key, seed=seed + 1)
    scaled = F.transform(values, lambda v: F.least(F.greatest(v * factor, F.lit(0.0)), F.lit(1.0)))
    return F.when(coin(key, seed=seed), scaled).otherwise(values)


def _sample_grid(img: np.ndarray, y: np.ndarray, x: np.ndarray, nearest: bool) -> np.ndarray:
    """Values of (bands, h, w) at fractional positions; outside is 0."""
    _, h, w = img.shape
    if nearest:
        yi, xi = np.rint(y).astype(int), np.rint(x).astype(int)
        ok = (yi >= 0) & (yi < h) & (xi >= 0) & (xi < w)
        return np.where(ok, img[:, yi.clip(0, h - 1), xi.clip(0, w - 1)], 0)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    total = np.zeros((img.shape[0], *y.shape))
    for dy in (0, 1):
        for dx in (0, 1):
            yi, xi = y0 + dy, x0 + dx
            weight = (1 - np.abs(y - yi)) * (1 - np.abs(x - xi))
            ok = (yi >= 0) & (yi < h) & (xi >= 0) & (xi < w)
            total += np.where(ok, weight * img[:, yi.clip(0, h - 1), xi.clip(0, w - 1)], 0)
    return total


def rotate(img: np.ndarray, degrees: float, nearest: bool = False) -> np.ndarray:
    _, h, w = img.shape
    t = np.deg2rad(degrees)
    yy, xx = np.mgrid[0:h, 0:w].astype(float)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    dy, dx = yy - cy, xx - cx
    return _sample_grid(img, cy + dx * np.sin(t) + dy * np.cos(t), cx + dx * np.cos(t) - dy * np.sin(t), nearest)


def sharpen(img: np.ndarray, factor: float) -> np.ndarray:
    """Blend with a 3x3 smoothed copy; the outermost cells stay."""
    k = np.array([[1, 1, 1], [1, 5, 1], [1, 1, 1]]) / 13
    _, h, w = img.shape
    smooth = img.astype(float).copy()
    smooth[:, 1:-1, 1:-1] = sum(
        k[dy, dx] * img[:, dy:h - 2 + dy, dx:w - 2 + dx] for dy in range(3) for dx in range(3)
    )
    return smooth + factor * (img - smooth)


def resized_crop(img: np.ndarray, rng: np.random.Generator, nearest: bool = False) -> np.ndarray:
    _, h, w = img.shape
    area = h * w * rng.uniform(0.3, 0.9)
    aspect = np.exp(rng.uniform(np.log(0.75), np.log(1.33)))
    ch, cw = min(h, max(1, round(np.sqrt(area / aspect)))), min(w, max(1, round(np.sqrt(area * aspect))))
    top, left = rng.integers(0, h - ch + 1), rng.integers(0, w - cw + 1)
    y = (top + (np.arange(h) + 0.5) * ch / h - 0.5).clip(0, h - 1)
    x = (left + (np.arange(w) + 0.5) * cw / w - 0.5).clip(0, w - 1)
    yy, xx = np.meshgrid(y, x, indexing="ij")
    return _sample_grid(img, yy, xx, nearest)


def augment_chips(chips: DataFrame, key: str, image: str, bands: int, height: int, width: int,
                  mask: str | None = None, crop: bool = False, seed: int = 42) -> DataFrame:
    """Rotation, sharpness and resized crop, each for half of the chips, seeded by chip key.

    ``image`` is a flattened (band, row, column) array; image and mask move together.
    """
    key_type = chips.schema[key].dataType.simpleString()
    cols = [key, image] + ([mask] if mask else [])
    schema = f"`{key}` {key_type}, `{image}` array<double>" + (f", `{mask}` array<int>" if mask else "")

    def run(batches):
        for pdf in batches:
            images, masks = [], []
            for i in range(len(pdf)):
                img = np.asarray(pdf[image].iloc[i], dtype=float).reshape(bands, height, width)
                lab = np.asarray(pdf[mask].iloc[i]).reshape(1, height, width) if mask else None
                rng = np.random.default_rng([seed, int(pdf[key].iloc[i])])
                if rng.random() < 0.5:
                    angle = rng.uniform(-90, 90)
                    img = rotate(img, angle)
                    lab = rotate(lab, angle, nearest=True) if mask else None
                if rng.random() < 0.5:
                    img = sharpen(img, rng.uniform(0, 0.5))
                if crop and rng.random() < 0.5:
                    state = int(rng.integers(1 << 31))
                    img = resized_crop(img, np.random.default_rng(state))
                    lab = resized_crop(lab, np.random.default_rng(state), nearest=True) if mask else None
                images.append(img.ravel())
                if mask:
                    masks.append(lab.ravel().astype(int))
            out = pd.DataFrame({key: pdf[key], image: images})
            if mask:
                out[mask] = masks
            yield out

    return chips.select(*cols).mapInPandas(run, schema)
