"""Model scoring hooks and detection clean-up. The model is any batch function the user brings."""

from __future__ import annotations

from functools import reduce

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions import raster_math, rings
from furrow.operators.spatial import box_pair_measures, intersecting_pairs
from furrow.session import cut


def score_patches(patches: DataFrame, image: str, shape: list[int], make_predict_fn: Callable[[], Callable],
                  batch_size: int = 64, out: str = "logits") -> DataFrame:
    """Run a model over patch images in batches; the model loads once per worker.

    ``image``: flattened array column of the given shape. ``make_predict_fn`` returns a function
    from a (batch, *shape) array to a (batch, n) array.
    """
    scorer = predict_batch_udf(
        make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
        input_tensor_shapes=[shape],
    )
    return patches.withColumn(out, scorer(F.col(image)))


def detect(patches: DataFrame, columns: list[str], detect_fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Table function: each batch of patches becomes any number of detections."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield detect_fn(pdf)

    return patches.select(*columns).mapInPandas(run, schema)


def confident(detections: DataFrame, threshold: float = 0.05) -> DataFrame:
    return detections.filter(F.col("conf") > F.lit(threshold))


def top_per_patch(detections: DataFrame, k: int = 100, patch: str = "patch_id", order: str = "id") -> DataFrame:
    """Best ``k`` detections per patch. Spark prunes ranks before the shuffle (group limit)."""
    w = Window.partitionBy(patch).orderBy(F.desc("conf"), order)
    return detections.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def segment_rings(detections: DataFrame, affine: tuple) -> DataFrame:
    """Pixel segments (``xs``, ``ys``) -> closed map rings; fewer than three points are dropped."""
    kept = detections.filter((F.size("xs") >= 3) & (F.size("xs") == F.size("ys")))
    ring = rings.close_ring(F.col("xs"), F.col("ys"))
    return kept.withColumn("exterior", rings.affine_ring(ring, *affine))


def non_maximum_suppression(detections: DataFrame, iou_max: float = 0.3, patch: str = "patch_id", key: str = "id") -> DataFrame:
    """Greedy suppression inside each patch, without gathering a patch in one task.

    The greedy choice equals: repeatedly keep every box no open better box overlaps, and drop
    the boxes those overlap. Each round is three joins on the overlap edges still open, and no
    cap is set on rounds. Of exact copies only the best can survive, so copies go first.
    """
    best = detections.groupBy(patch, "x0", "y0", "x1", "y1").agg(F.min(F.struct(-F.col("conf"), key)).alias("b"))
    boxes = detections.join(best.select(F.col(f"b.{key}").alias(key)), key, "left_semi")
    info = boxes.select(F.col(key).alias("id"), "conf")
    met = intersecting_pairs(boxes.withColumnRenamed(key, "id"), keys=[patch])
    pairs = box_pair_measures(met).filter(F.col("iou") > iou_max)
    a_first = (F.col("ca") > F.col("cb")) | ((F.col("ca") == F.col("cb")) & (F.col("a_id") < F.col("b_id")))
    edges = cut(
        pairs.join(info.withColumnsRenamed({"id": "a_id", "conf": "ca"}), "a_id")
        .join(info.withColumnsRenamed({"id": "b_id", "conf": "cb"}), "b_id")
        .select(F.when(a_first, F.col("a_id")).otherwise(F.col("b_id")).alias("hi"),
                F.when(a_first, F.col("b_id")).otherwise(F.col("a_id")).alias("lo"))
    )
    dropped = edges.select(F.col("lo").alias(key)).limit(0)
    while not edges.isEmpty():
        kept = edges.select("hi").distinct().join(edges.select(F.col("lo").alias("hi")), "hi", "left_anti")
        gone = cut(edges.join(kept, "hi", "left_semi").select("lo").distinct())
        dropped = dropped.unionByName(gone.select(F.col("lo").alias(key)))
        edges = cut(
            edges.join(gone, "lo", "left_anti")
            .join(gone.select(F.col("lo").alias("hi")), "hi", "left_anti").select("hi", "lo")
        )
    return boxes.join(dropped, key, "left_anti")


def scores_to_bytes(logits: Column) -> Column:
    """Class logits of a pixel -> quantised probabilities."""
    return F.transform(raster_math.softmax(logits), raster_math.quantise)


def masks_of_interest(labels: Column) -> tuple[Column, Column]:
    """Field and boundary flags from class labels."""
    return (labels == 1).cast("int"), (labels == 2).cast("int")


def masks_from_scores(scores: Column, threshold: float) -> tuple[Column, Column]:
    """Field and boundary flags from quantised scores (background, field, boundary)."""
    t = F.lit(threshold * 255)
    return (F.get(scores, F.lit(1)) >= t).cast("int"), (F.get(scores, F.lit(2)) >= t).cast("int")


def edge_agreement(label: Column, edge: Column) -> Column:
    """Labels without a supporting edge become unknown."""
    return F.when(edge > 0, label).otherwise(F.lit(3))


def to_two_classes(label: Column) -> Column:
    return F.when(label == 1, 1).otherwise(0)


def union_frames(frames: list[DataFrame], fill: dict | None = None) -> DataFrame:
    """Frames of patches put together by name; a column that some lack is null there, or filled."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return whole.na.fill(fill) if fill else whole
