"""Merging polygons of any shape: pair rules on grid runs and common sides, unions as rings.

Polygons are ``id, exterior, interiors``. ``step`` is the grid on which overlaps are measured, ``grid`` the one
that a union is drawn on; what holds no cell centre of that grid has no union there and falls away. ``hook`` maps
coordinates for the measures only (for example to an equal-area plane), so that degrees can stay in the rings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import rings
from furrow.operators import boundary, scanline, spatial
from furrow.operators.graph import with_components
from furrow.operators.merging import merged_id
from furrow.session import cut


def measured(polygons: DataFrame, hook: rings.XY | None = None) -> DataFrame:
    """Set ``area`` and ``perimeter`` from the rings, or from their image under ``hook``."""
    def seen(ring):
        return ring if hook is None else rings.map_ring(ring, hook)

    outer, inner = seen(F.col("exterior")), F.transform("interiors", seen)
    return polygons.withColumns({"area": rings.polygon_area(outer, inner), "perimeter": rings.polygon_length(outer, inner)})


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))


def union_components(polygons: DataFrame, components: DataFrame, grid: float, hook: rings.XY | None = None,
                     tile: int = 1024) -> DataFrame:
    """Union of the polygons of each ``comp``, one row per part: ``comp, ids, members`` and rings with measures.

    ``tile`` is the side in cells of the squares whose sides are linked in one task.
    """
    # runs are exploded from few rows, so their size is underestimated: both sides are shuffled
    runs = scanline.polygon_runs(polygons, grid).hint("merge").join(components.select("id", "comp"), "id")
    boxes = boundary.run_boxes(scanline.merged_runs(runs, "comp"), [], "comp")
    shapes = boundary.outlines_of(boxes, [], "comp", float(tile), (grid, 0, 0, 0, grid, 0))
    names = components.groupBy("comp").agg(merged_id(F.col("id"), F.col("id")).alias("ids"), F.count(F.lit(1)).alias("members"))
    found = shapes.join(names, "comp").drop("ring")
    return found if hook is None else measured(found, hook)


def duplicate_components(polygons: DataFrame, iou_min: float, contain_min: float, step: float) -> DataFrame:
    """``id, comp``: polygons linked by IoU or by how much of the smaller one lies in the other."""
    accept = spatial.merges_duplicates(F.col("iou"), F.col("containment"), iou_min, contain_min)
    pairs = scanline.pair_measures(polygons, step).filter(accept)
    return with_components(polygons.select("id"), _edges(pairs), "id")


def merge_duplicate_polygons(polygons: DataFrame, iou_min: float = 0.2, contain_min: float = 0.8, step: float = 2.5,
                             grid: float = 10.0, hook: rings.XY | None = None) -> DataFrame:
    """Detections of one object -> its union on the snap grid."""
    found = cut(duplicate_components(polygons, iou_min, contain_min, step))
    return union_components(polygons, found, grid, hook)


def adjacent_components(polygons: DataFrame, ratio: float, step: float) -> DataFrame:
    """``id, comp``: polygons linked by overlap, or by a common outline of at least ``ratio`` of the shorter one."""
    candidates = cut(spatial.intersecting_pairs(scanline.polygon_boxes(polygons)).select("a_id", "b_id"))
    overlap = scanline.pair_overlaps(scanline.polygon_runs(polygons, step), candidates, step)
    shared = scanline.shared_sides(polygons, candidates)
    length = polygons.select("id", rings.polygon_length(F.col("exterior"), F.col("interiors")).alias("length"))
    for s in ("a", "b"):
        shared = shared.join(length.select(F.col("id").alias(f"{s}_id"), F.col("length").alias(f"{s}_length")), f"{s}_id")
    touching = shared.filter(spatial.merges_adjacent(F.lit(0.0), F.col("shared"), F.least("a_length", "b_length"), ratio))
    edges = _edges(overlap.filter("inter > 0")).unionByName(_edges(touching)).distinct()
    return with_components(polygons.select("id"), edges, "id")


def merge_adjacent_polygons(polygons: DataFrame, ratio: float, step: float = 1.0, grid: float = 1.0,
                            hook: rings.XY | None = None) -> DataFrame:
    """Polygons that overlap or share enough outline -> their union. Polygons without points fall away."""
    some = polygons.filter(F.size("exterior") > 3)
    return union_components(some, cut(adjacent_components(some, ratio, step)), grid, hook)
