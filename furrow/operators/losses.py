"""Loss values as evaluation aggregates over scored pixels.

``pixels``: a batch key, ``logits ARRAY<DOUBLE>`` and a label. One aggregation per batch yields
every sum the losses need; each loss is then arithmetic on that one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.constants import UNKNOWN
from furrow.functions.raster_math import softmax
from furrow.operators.stencil import gaussian_blur

EPS = 1e-7


def scored(pixels: DataFrame, n_classes: int, logits: str = "logits", label: str = "cls") -> DataFrame:
    """Add class probabilities ``p0..`` and one-hot labels ``t0..``."""
    df = pixels.withColumn("_p", softmax(F.col(logits)))
    return df.withColumns({
        **{f"p{k}": F.get("_p", F.lit(k)) for k in range(n_classes)},
        **{f"t{k}": (F.col(label) == k).cast("double") for k in range(n_classes)},
    }).drop("_p")


def _weight(label: Column, weights: list[float] | None, n_classes: int) -> Column:
    if weights is None:
        return F.lit(1.0)
    w = F.lit(0.0)
    for k in range(n_classes):
        w = F.when(label == k, F.lit(float(weights[k]))).otherwise(w)
    return w


def _cross_entropy(label: str, n_classes: int, weights: list[float] | None, valid: Column) -> Column:
    """Weighted mean of -log p of the true class over the valid pixels."""
    y = F.col(label)
    true_p = F.lit(None).cast("double")
    for k in range(n_classes):
        true_p = F.when(y == k, F.col(f"p{k}")).otherwise(true_p)
    w = F.when(valid, _weight(y, weights, n_classes))
    return F.sum(-F.log(true_p) * w) / F.sum(w)


def cross_entropy_sums(df: DataFrame, batch: str, n_classes: int, weights: list[float] | None = None,
                       label: str = "cls", ignore: int | None = UNKNOWN) -> DataFrame:
    """``ce`` alone; batches without a valid pixel are left out."""
    valid = df if ignore is None else df.filter(F.col(label) != ignore)
    return valid.groupBy(batch).agg(_cross_entropy(label, n_classes, weights, F.lit(True)).alias("ce"))


def overlap_sums(df: DataFrame, batch: str, n_classes: int, label: str = "cls",
                 ignore: int | None = UNKNOWN, mode: str = "skip", ce_weights: list[float] | None = None) -> DataFrame:
    """Per class sums of p, t, p*t, p*p over a batch, and ``ce``, all in one aggregation.

    What happens to an ignored pixel: ``skip`` leaves it out, ``flatten`` counts it as class 0
    with equal probabilities (logits and label zeroed), ``keep`` counts it with no true class.
    ``ce`` is the cross-entropy, weighted by class, of the pixels that are not ignored.
    """
    valid = F.lit(True) if ignore is None else F.col(label) != ignore
    ce = _cross_entropy(label, n_classes, ce_weights, valid)
    if mode == "skip":
        df = df.filter(valid)
    elif mode == "flatten":
        df = df.withColumns({
            **{f"p{k}": F.when(valid, F.col(f"p{k}")).otherwise(1.0 / n_classes) for k in range(n_classes)},
            **{f"t{k}": F.when(valid, F.col(f"t{k}")).otherwise(1.0 if k == 0 else 0.0) for k in range(n_classes)},
        })
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("n_valid"), ce.alias("ce")]
    for k in range(n_classes):
        p, t = F.col(f"p{k}"), F.col(f"t{k}")
        aggs += [F.sum(p).alias(f"sp{k}"), F.sum(t).alias(f"st{k}"),
                 F.sum(p * t).alias(f"pt{k}"), F.sum(p * p).alias(f"pp{k}")]
    return df.groupBy(batch).agg(*aggs)


def _present(k: int, loss: Column) -> Column:
    """A class without true pixels does not count."""
    return F.when(F.col(f"st{k}") > 0, loss).otherwise(F.lit(0.0))


def _mean(terms: list[Column]) -> Column:
    return sum(terms[1:], terms[0]) / len(terms)


def dice_terms(n_classes: int) -> list[Column]:
    return [
        _present(k, 1 - 2 * F.col(f"pt{k}") / F.greatest(F.col(f"sp{k}") + F.col(f"st{k}"), F.lit(EPS)))
        for k in range(n_classes)
    ]


def dice(n_classes: int) -> Column:
    return _mean(dice_terms(n_classes))


def jaccard(n_classes: int) -> Column:
    return _mean([
        _present(k, 1 - F.col(f"pt{k}") / F.greatest(
            F.col(f"sp{k}") + F.col(f"st{k}") - F.col(f"pt{k}"), F.lit(EPS)))
        for k in range(n_classes)
    ])


def _no_pixels(loss: Column) -> Column:
    """Masked losses are 0 when every label is ignored."""
    return F.when(F.col("n_valid") > 0, loss).otherwise(F.lit(0.0))


masked = _no_pixels


def tversky(n_classes: int, alpha: float = 0.5, beta: float = 0.5, gamma: float = 1.0) -> Column:
    terms = []
    for k in range(n_classes):
        hit = F.col(f"pt{k}")
        den = hit + alpha * (F.col(f"sp{k}") - hit) + beta * (F.col(f"st{k}") - hit)
        terms.append(_present(k, 1 - hit / F.greatest(den, F.lit(EPS))))
    return F.pow(_mean(terms), F.lit(gamma))


def log_cosh_dice(n_classes: int, weights: list[float] | None = None) -> Column:
    terms = dice_terms(n_classes)
    if weights is not None:
        terms = [t * (w / sum(weights)) for t, w in zip(terms, weights)]
    return F.log(F.cosh(_mean(terms)))


def focal(df: DataFrame, batch: str, n_classes: int, gamma: float = 2.0, label: str = "cls",
          logits: str = "logits", ignore: int | None = UNKNOWN) -> DataFrame:
    """Normalised focal loss, one-vs-rest on logits: mean of each class's normalised terms, summed."""
    valid = df if ignore is None else df.filter(F.col(label) != ignore)
    aggs = [F.count(F.lit(1)).alias("n")]
    for k in range(n_classes):
        z, t = F.get(logits, F.lit(k)), F.col(f"t{k}")
        bce = F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))
        f = F.pow(1 - F.exp(-bce), F.lit(gamma))
        aggs += [F.sum(f * bce).alias(f"num{k}"), F.sum(f).alias(f"den{k}")]
    loss = [F.col(f"num{k}") / F.greatest(f"den{k}", F.lit(1e-6)) / F.col("n") for k in range(n_classes)]
    return valid.groupBy(batch).agg(*aggs).select(batch, sum(loss[1:], loss[0]).alias("focal"))


def _tanimoto(pl: Column, pp: Column, ll: Column, depth: int, smooth: float) -> Column:
    total = F.lit(0.0)
    for d in range(depth):
        scale = 2.0**d
        total = total + 1 / (scale * (pp + ll) - (2 * scale - 1) * pl + smooth)
    return (pl + smooth) * total / depth


def fractal_tanimoto(n_classes: int, weights: list[float] | None = None, depth: int = 5,
                     smooth: float = 1e-5, ignore: int | None = UNKNOWN) -> Column:
    """Fractal Tanimoto with its complement; complement sums follow from the same four sums."""
    total = F.lit(0.0)
    for k in range(n_classes):
        if k == ignore:
            continue
        n, sp, st = F.col("n"), F.col(f"sp{k}"), F.col(f"st{k}")
        pt, pp = F.col(f"pt{k}"), F.col(f"pp{k}")
        direct = _tanimoto(pt, pp, st, depth, smooth)
        dual = _tanimoto(n - sp - st + pt, n - 2 * sp + pp, n - st, depth, smooth)
        w = 1.0 if weights is None else float(weights[k])
        total = total + w * (1 - 0.5 * (direct + dual))
    return total / n_classes


def tversky_focal_terms(n_classes: int, smooth: float = 1.0, alpha: float = 0.7, gamma: float = 1.33) -> list[Column]:
    terms = []
    for k in range(n_classes):
        hit = F.col(f"pt{k}")
        den = hit + alpha * (F.col(f"st{k}") - hit) + (1 - alpha) * (F.col(f"sp{k}") - hit) + smooth
        terms.append(F.pow(1 - (hit + smooth) / den, F.lit(1 / gamma)))
    return terms


def tversky_focal(n_classes: int, weights: list[float] | Column | None = None, **kwargs) -> Column:
    """Weighted sum over classes; ``weights`` may be an array column (locally derived weights)."""
    terms = tversky_focal_terms(n_classes, **kwargs)
    if weights is None:
        weights = [1.0 / n_classes] * n_classes
    w = [F.get(weights, F.lit(k)) if isinstance(weights, Column) else F.lit(float(weights[k])) for k in range(n_classes)]
    parts = [a * b for a, b in zip(w, terms)]
    return sum(parts[1:], parts[0])


def local_weights(n_classes: int) -> Column:
    """Inverse label frequencies of the batch from its own sums, normalised; absent classes get 1e-5."""
    inverse = [F.when(F.col(f"st{k}") > 0, F.col("n_valid") / F.col(f"st{k}")) for k in range(n_classes)]
    total = sum((F.coalesce(i, F.lit(0.0)) for i in inverse[1:]), F.coalesce(inverse[0], F.lit(0.0)))
    return F.array(*[F.coalesce(i / total, F.lit(1e-5)) for i in inverse])


def binary_tversky_focal(target: int = 1, **kwargs) -> Column:
    """Loss of one class against the rest."""
    return tversky_focal_terms(target + 1, **kwargs)[target]


def combined(first: Column, second: Column, w1: float = 0.5, w2: float = 0.5) -> Column:
    return w1 * first + w2 * second


def boundary_weights(pixels: DataFrame, keys: list[str], label: str = "cls", target: int = 2,
                     scale: float = 1.0, ignore: int | None = UNKNOWN) -> DataFrame:
    """Pixel weight: blurred boundary map times ``scale`` plus 1; 0 where ignored."""
    marked = pixels.withColumn("_b", (F.col(label) == target).cast("double"))
    w = F.col("_b") * scale + 1
    if ignore is not None:
        w = F.when(F.col(label) == ignore, 0.0).otherwise(w)
    return gaussian_blur(marked, keys, "_b").withColumn("weight", w).drop("_b")


def pixel_weighted_ce(df: DataFrame, batch: str, n_classes: int, weights: list[float] | None = None,
                      label: str = "cls", ignore: int | None = UNKNOWN) -> DataFrame:
    """Mean of class-weighted cross-entropy under pixel weights (column ``weight``)."""
    y = F.col(label)
    true_p = F.lit(None).cast("double")
    for k in range(n_classes):
        true_p = F.when(y == k, F.col(f"p{k}")).otherwise(true_p)
    ce = -F.log(true_p) * _weight(y, weights, n_classes)
    valid = df if ignore is None else df.filter(y != ignore)
    return valid.groupBy(batch).agg(
        (F.sum(F.col("weight") * ce) / F.greatest(F.sum("weight"), F.lit(1e-8))).alias("pixel_weighted_ce")
    )
