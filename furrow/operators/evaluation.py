"""Evaluation: pixel and object metrics, bootstrap intervals, consensus.

Everything rests on one row of counts per chip.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.constants import FIELD, UNKNOWN
from furrow.functions.text import hash_unit
from furrow.operators import labelling
from furrow.operators.graph import dense_index
from furrow.session import cut

COUNTS = ["p_tp", "p_fp", "p_fn", "o_tp", "o_fp", "o_fn"]
METRICS = ["pixel_iou", "pixel_precision", "pixel_recall", "object_precision", "object_recall", "object_f1"]


def confusion(pixels: DataFrame, keys: list[str], label: str = "cls", pred: str = "pred") -> DataFrame:
    """Counts per (label, prediction); unknown labels are left out."""
    return (
        pixels.filter(F.col(label) != UNKNOWN)
        .groupBy(*keys, F.col(label).alias("label"), F.col(pred).alias("pred"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def class_counts(matrix: DataFrame, keys: list[str], n_classes: int) -> DataFrame:
    """Confusion matrix -> tp, fp, fn per class, absent classes included."""
    classes = F.array(*[F.lit(c) for c in range(n_classes)])
    row = matrix.withColumn("k", F.explode(classes))
    is_l, is_p = F.col("label") == F.col("k"), F.col("pred") == F.col("k")
    n = F.col("n")
    return row.groupBy(*keys, "k").agg(
        F.sum(F.when(is_l & is_p, n).otherwise(0)).alias("tp"),
        F.sum(F.when(~is_l & is_p, n).otherwise(0)).alias("fp"),
        F.sum(F.when(is_l & ~is_p, n).otherwise(0)).alias("fn"),
    )


def ratio(num: Column, den: Column, empty: float) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(empty))


def class_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and IoU per class; 0/0 is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "precision": ratio(tp, tp + fp, 0.0),
        "recall": ratio(tp, tp + fn, 0.0),
        "iou": ratio(tp, tp + fp + fn, 0.0),
    })


def macro_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over the classes that occur in label or prediction."""
    present = scores.filter(F.col("tp") + F.col("fp") + F.col("fn") > 0)
    return present.groupBy(*keys).agg(
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("iou").alias("iou_macro"),
    )


def _overlap_tile(runs: pa.Table) -> pa.Table:
    """Cells that truth and predicted runs of a block of tiles share, and those that only one of them has."""
    layer, comp = runs["layer"].to_numpy(zero_copy_only=False), runs["comp"].to_numpy()
    start = runs["y"].to_numpy().astype(np.int64) * labelling.ROW_STEP + runs["x0"].to_numpy()
    end = start + (runs["x1"].to_numpy() - runs["x0"].to_numpy())

    def side(name: str) -> tuple[np.ndarray, ...]:
        at = np.flatnonzero(layer == name)
        at = at[np.argsort(start[at])]
        return comp[at], start[at], end[at]

    (t, t_start, t_end), (p, p_start, p_end) = side("t"), side("p")
    # the truth runs that one predicted run meets follow each other
    first = np.searchsorted(t_end, p_start, side="left")
    n = np.maximum(np.searchsorted(t_start, p_end, side="right") - first, 0)
    of_p = np.repeat(np.arange(len(p)), n)
    of_t = np.repeat(first, n) + np.arange(len(of_p)) - np.repeat(np.cumsum(n) - n, n)
    both = np.minimum(t_end[of_t], p_end[of_p]) - np.maximum(t_start[of_t], p_start[of_p]) + 1
    t_rest = t_end - t_start + 1 - np.bincount(of_t, weights=both, minlength=len(t)).astype(np.int64)
    p_rest = p_end - p_start + 1 - np.bincount(of_p, weights=both, minlength=len(p)).astype(np.int64)
    none = np.int64(-1)  # codes of cells are not negative
    pairs = np.stack([np.concatenate([t[of_t], t, np.full(len(p), none)]), np.concatenate([p[of_p], np.full(len(t), none), p])], axis=1)
    cells = np.concatenate([both, t_rest, p_rest]).astype(np.int64)
    found, which = np.unique(pairs[cells > 0], axis=0, return_inverse=True)
    total = np.bincount(which.ravel(), weights=cells[cells > 0], minlength=len(found)).astype(np.int64)
    columns = [pa.array(found[:, k], pa.int64(), mask=found[:, k] == none) for k in (0, 1)]
    return pa.table([*columns, pa.array(total, pa.int64())], names=["t", "p", "both"])


def tile_overlaps(runs: DataFrame, keys: list[str], stride: int = labelling.DEFAULT_STRIDE) -> DataFrame:
    """``keys, t, p, both``: shared cells of runs of the layers ``t`` and ``p``, without a row per cell.

    Runs are compared block by block of whole tiles of side ``stride``. Null stands for no object. A pair has one
    row for each block it meets in.
    """
    types = {f.name: f.dataType.simpleString() for f in runs.schema.fields}

    def run(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        found = _overlap_tile(block)
        held = [pa.repeat(k, len(found)) for k in key[:len(keys)]]
        return pa.table([*held, *found.columns], names=[*keys, *found.column_names])

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", t bigint, p bigint, both bigint"
    side = labelling.block_side(stride) // stride
    block = {"_by": F.floor(F.col("ty") / side), "_bx": F.floor(F.col("tx") / side)}
    placed = runs.select(*keys, "layer", "comp", "y", "x0", "x1", *[c.alias(n) for n, c in block.items()])
    return placed.groupBy(*keys, *block).applyInArrow(run, schema)


def object_overlaps(
    pixels: DataFrame, keys: list[str], iou_threshold: float = 0.5,
    stride: int = labelling.DEFAULT_STRIDE, label: str = "cls", pred: str = "pred",
) -> DataFrame:
    """Truth and predicted objects of each chip with their overlaps, one row per pair that meets.

    ``t, p`` name the objects (null on the side where an object meets nothing there), ``both``
    counts shared cells, ``iou`` and ``match`` follow. ``t_first`` and ``p_first`` mark one row
    per object, ``p_matched`` tells whether the prediction has a match. At a threshold of 0.5 or
    more an object matches at most one other, so counts decide everything. Both masks are
    labelled in one pass as two layers. An object that crosses tiles of a chip is one object.
    """
    if iou_threshold < 0.5:
        raise ValueError("a threshold below 0.5 would allow several matches per object")
    layers = F.array_compact(F.array(
        F.when(F.col(label) == FIELD, F.lit("t")), F.when(F.col(pred) == FIELD, F.lit("p"))
    ))
    masks = pixels.select(*keys, "y", "x", F.explode(layers).alias("layer"))
    runs = labelling.label_fields(masks, [*keys, "layer"], stride)
    at_edge = (F.col("x") % stride == stride - 1) | (F.col("y") % stride == stride - 1)
    if not pixels.filter(at_edge).isEmpty():
        # objects can only meet another tile where there are cells on a tile's last row or column
        runs = cut(runs)
        runs = labelling.stitched(runs, [*keys, "layer"], stride).drop("comp").withColumnRenamed("label", "comp")

    met = tile_overlaps(runs, keys, stride).groupBy(*keys, "t", "p").agg(F.sum("both").alias("both"))
    # rows without the object stay apart, so they never form one large group
    by_t = Window.partitionBy(*keys, "t", F.when(F.col("t").isNull(), F.col("p")))
    by_p = Window.partitionBy(*keys, "p", F.when(F.col("p").isNull(), F.col("t")))
    return (
        met.withColumn("t_cells", F.sum("both").over(by_t))
        .withColumn("t_first", F.col("t").isNotNull() & (F.row_number().over(by_t.orderBy("p")) == 1))
        .withColumn("p_cells", F.sum("both").over(by_p))
        .withColumn("p_first", F.col("p").isNotNull() & (F.row_number().over(by_p.orderBy("t")) == 1))
        .withColumn("iou", F.when(
            F.col("t").isNotNull() & F.col("p").isNotNull(),
            F.col("both") / (F.col("t_cells") + F.col("p_cells") - F.col("both"))))
        .withColumn("match", F.coalesce(F.col("iou") > iou_threshold, F.lit(False)))
        .withColumn("p_matched", F.max("match").over(by_p))
    )


def chip_stats(
    pixels: DataFrame, keys: list[str], iou_threshold: float = 0.5,
    stride: int = labelling.DEFAULT_STRIDE, label: str = "cls", pred: str = "pred",
) -> DataFrame:
    """Six integers per chip from which every metric follows."""
    known = F.col(label) != UNKNOWN
    is_l, is_p = F.col(label) == FIELD, F.col(pred) == FIELD
    px = pixels.groupBy(*keys).agg(
        F.count_if(known & is_l & is_p).alias("p_tp"),
        F.count_if(known & ~is_l & is_p).alias("p_fp"),
        F.count_if(known & is_l & ~is_p).alias("p_fn"),
    )
    obj = object_overlaps(pixels, keys, iou_threshold, stride, label, pred).groupBy(*keys).agg(
        F.count_if("t_first").alias("t"), F.count_if("p_first").alias("p"), F.count_if("match").alias("m")
    )
    zero = F.lit(0).cast("bigint")
    return px.join(obj, keys, "left").select(
        *keys, "p_tp", "p_fp", "p_fn",
        F.coalesce("m", zero).alias("o_tp"),
        F.coalesce(F.col("p") - F.col("m"), zero).alias("o_fp"),
        F.coalesce(F.col("t") - F.col("m"), zero).alias("o_fn"),
    )


def metrics_from_counts(counts: DataFrame, empty: float = float("nan")) -> DataFrame:
    """Pixel IoU, precision, recall and object precision, recall, F1 of summed counts.

    Object scores of nothing are ``empty`` (NaN in evaluation, 0 in training validation).
    """
    c = {k: F.col(k) for k in COUNTS}
    op = ratio(c["o_tp"], c["o_tp"] + c["o_fp"], empty)
    orc = ratio(c["o_tp"], c["o_tp"] + c["o_fn"], empty)
    out = counts.withColumns({
        "pixel_iou": ratio(c["p_tp"], c["p_tp"] + c["p_fp"] + c["p_fn"], 0.0),
        "pixel_precision": ratio(c["p_tp"], c["p_tp"] + c["p_fp"], 0.0),
        "pixel_recall": ratio(c["p_tp"], c["p_tp"] + c["p_fn"], 0.0),
        "object_precision": op, "object_recall": orc,
    })
    p, r = F.col("object_precision"), F.col("object_recall")
    usable = ~F.isnan(p) & ~F.isnan(r) & (p + r > 0)
    return out.withColumn("object_f1", F.when(usable, 2 * p * r / (p + r)).otherwise(F.lit(empty)))


def sum_counts() -> list[Column]:
    return [F.sum(k).alias(k) for k in COUNTS]


def country_metrics(stats: DataFrame, country: str = "country") -> DataFrame:
    """Metrics over everything and per country, from one rollup of the chip counts."""
    summed = stats.rollup(country).agg(F.grouping(country).alias("_all"), *sum_counts(), F.count(F.lit(1)).alias("chips"))
    named = summed.withColumn(country, F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col(country)))
    return metrics_from_counts(named.drop("_all"))


def _intervals(replicates: DataFrame, confidence: float) -> DataFrame:
    """Percentile interval of each metric over the replicates; NaN replicates are dropped."""
    low, high = (1 - confidence) / 2, 1 - (1 - confidence) / 2
    long = replicates.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS
    ])).alias("e")).select("e.*").withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return long.groupBy("metric").agg(
        F.get(F.percentile("v", [low, high]), F.lit(0)).alias("lower"),
        F.get(F.percentile("v", [low, high]), F.lit(1)).alias("upper"),
    )


def bootstrap_by_draws(stats: DataFrame, key: str, n_bootstrap: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Bootstrap over chips with draws hashed from (replicate, draw): repeatable anywhere.

    Draws meet their chip one by one; only the sums per replicate are held.
    """
    placed = dense_index(stats.select(key, *COUNTS), [F.col(key)])
    total = placed.select(F.count(F.lit(1))).scalar()
    draws = (
        placed.select(F.col("idx").alias("draw"), total.alias("total"))
        .withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap - 1))))
        .select("rep", F.floor(hash_unit(F.col("rep"), F.col("draw"), seed=seed) * F.col("total")).alias("idx"))
    )
    sums = draws.hint("merge").join(placed, "idx").groupBy("rep").agg(*sum_counts())
    return _intervals(metrics_from_counts(sums), confidence)


def bootstrap_by_blocks(
    stats: DataFrame, key: str, n_bootstrap: int = 1000, confidence: float = 0.95, seed: int = 42, blocks: int = 256,
) -> DataFrame:
    """The same law without shuffling draws.

    A multinomial over chips is a multinomial over blocks of chips followed by one inside each
    block. Chips go to ``blocks`` blocks by a hash of their key and are taken in order of key, so
    the result depends on the rows and the seed alone. The totals per block and replicate are drawn
    once (``blocks`` x ``n_bootstrap`` numbers); each block sends one row per replicate.
    """
    placed = stats.select(key, *COUNTS, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    sizes = np.zeros(blocks)
    for r in placed.groupBy("block").count().collect():  # at most `blocks` rows
        sizes[r["block"]] = r["count"]
    totals = np.random.default_rng([seed]).multinomial(int(sizes.sum()), sizes / max(sizes.sum(), 1), size=n_bootstrap)

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        b, n = int(pdf["block"].iloc[0]), len(pdf)
        counts = pdf.sort_values([key, *COUNTS])[COUNTS].to_numpy(float)
        rng = np.random.default_rng([seed, b + 1])
        step = max(1, (1 << 22) // n)
        here = totals[:, b]
        parts = [rng.multinomial(here[r:r + step], np.full(n, 1 / n)) @ counts for r in range(0, n_bootstrap, step)]
        frame = pd.DataFrame(np.concatenate(parts), columns=COUNTS)
        frame.insert(0, "rep", np.arange(n_bootstrap))
        return frame

    schema = "rep bigint, " + ", ".join(f"{k} double" for k in COUNTS)
    sums = placed.groupBy("block").applyInPandas(resample, schema).groupBy("rep").agg(*sum_counts())
    return _intervals(metrics_from_counts(sums), confidence)


def overlap_consistency(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Per pixel seen by several patches: agreements with the first-placed value.

    ``placed``: ``keys, y, x, patch_order, pred``. One aggregation: how often each value occurs
    equals agreement counting once the first value is known.
    """
    per_value = placed.groupBy(*keys, "y", "x", "pred").agg(
        F.count(F.lit(1)).alias("n"), F.min("patch_order").alias("o")
    )
    per_pixel = per_value.groupBy(*keys, "y", "x").agg(
        F.sum("n").alias("seen"), F.min_by("n", "o").alias("same"), F.min_by("pred", "o").alias("first_pred"),
        F.count(F.lit(1)).alias("values"),
    )
    return per_pixel.select(
        *keys, "y", "x", "first_pred",
        (F.col("seen") - 1).alias("total"), (F.col("same") - 1).alias("agreements"),
        (F.col("values") > 1).cast("int").alias("disagreement"),
    )


def consistency_report(per_pixel: DataFrame, keys: list[str]) -> DataFrame:
    total = F.sum("total")
    return per_pixel.groupBy(*keys).agg(
        F.sum("agreements").alias("agreements"), total.alias("total"),
        F.when(total > 0, F.sum("agreements") / total).alias("fraction"),
    )


def consensus_stats(scores: DataFrame, country: str = "country", score: str = "consensus_score") -> DataFrame:
    """Count, mean and deviation per country, rounded to four places."""
    return scores.groupBy(country).agg(
        F.count(score).alias("count"), F.round(F.avg(score), 4).alias("mean"),
        F.round(F.stddev_samp(score), 4).alias("std"),
    )


def consensus_overall(scores: DataFrame, score: str = "consensus_score") -> DataFrame:
    return scores.agg(
        F.round(F.avg(score), 4).alias("mean"), F.round(F.stddev_samp(score), 4).alias("std"),
        F.round(F.min(score), 4).alias("min"), F.round(F.max(score), 4).alias("max"),
        F.round(F.median(score), 4).alias("median"),
    )


def class_weights(pixels: DataFrame, batch: str, n_classes: int, label: str = "cls", ignore: int | None = UNKNOWN) -> DataFrame:
    """Inverse class frequency per batch, normalised; absent classes get 1e-5."""
    valid = pixels if ignore is None else pixels.filter(F.col(label) != ignore)
    total = F.count(F.lit(1))
    per = pixels.select(batch).distinct().join(
        valid.groupBy(batch).agg(total.alias("n"), *[
            F.count_if(F.col(label) == k).alias(f"n{k}") for k in range(n_classes)
        ]), batch, "left",
    )
    inv = [F.when(F.col(f"n{k}") > 0, F.col("n") / F.col(f"n{k}")) for k in range(n_classes)]
    all_inv = sum((F.coalesce(i, F.lit(0.0)) for i in inv[1:]), F.coalesce(inv[0], F.lit(0.0)))
    return per.select(batch, F.array(*[
        F.coalesce(i / all_inv, F.lit(1e-5)) for i in inv
    ]).alias("class_weights"))
