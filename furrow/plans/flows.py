"""End-to-end jobs composed of the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import rings
from furrow.operators import evaluation, labelling, merging, outlines, scoring, stencil, unions
from furrow.session import cut
from furrow.sinks import writers
from furrow.sources import rasters


def field_mask(cells: DataFrame, keys: list[str], thin_boundaries: bool = False, opening: int = 0,
               closing: int = 0, height: Column | None = None, width: Column | None = None) -> DataFrame:
    """Label cells -> cells of the field mask, after optional thinning and morphology."""
    if thin_boundaries:
        cells = stencil.fill_thinned_boundaries(cells, keys, height, width)
    else:
        cells = cells.withColumn("field", (F.col("cls") == 1).cast("int"))
    if opening or closing:
        cells = stencil.open_close(cells, keys, "field", opening, closing)
    return cells.filter(F.col("field") == 1).select(*keys, "y", "x")


def polygonize(
    cells: DataFrame, keys: list[str], stride: int = labelling.DEFAULT_STRIDE, min_size: float | None = 500,
    max_size: float | None = None, pixel_w: float = 10.0, pixel_h: float = 10.0,
    merge_ratio: float | None = None, **mask_options,
) -> DataFrame:
    """Class raster -> fields with ids, area and perimeter.

    Size limits apply before merging, as fields cut at a tile edge count piece by piece.
    """
    mask = field_mask(cells, keys, **mask_options)
    runs = labelling.label_fields(mask, keys, stride)
    stats = labelling.cell_metrics(labelling.field_stats(runs, keys), pixel_w, pixel_h)
    kept = labelling.running_id(labelling.size_filter(stats, min_size, max_size), keys)
    if merge_ratio is None:
        return kept
    return merging.merge_adjacent_fields(runs, kept, keys, stride, merge_ratio, pixel_w, pixel_h)


def field_outlines(cells: DataFrame, keys: list[str], stride: int = labelling.DEFAULT_STRIDE,
                   affine: tuple[float, ...] = (10.0, 0.0, 0.0, 0.0, -10.0, 0.0), tolerance: float = 0,
                   close_interiors: bool = False, **size) -> DataFrame:
    """Class raster -> polygons with rings, measured on the final rings."""
    mask = field_mask(cells, keys)
    runs = labelling.label_fields(mask, keys, stride)
    shapes = outlines.field_polygons(runs, [*keys, "ty", "tx"], affine=affine)
    if close_interiors:
        shapes = shapes.withColumn("interiors", rings.drop_interiors(F.col("interiors")))
    shapes = outlines.simplify(shapes, tolerance).withColumns({
        "area": rings.polygon_area(F.col("exterior"), F.col("interiors")),
        "perimeter": rings.polygon_length(F.col("exterior"), F.col("interiors")),
    })
    return labelling.running_id(labelling.size_filter(shapes, **size), keys)


def postprocess_instances(
    boxes: DataFrame, conf: float = 0.05, nms_iou: float | None = None, max_detections: int = 100,
    padding: int = 1, min_size: float | None = 500, max_size: float | None = 100000,
    iou_min: float = 0.2, contain_min: float = 0.8,
) -> DataFrame:
    """Boxed detections -> merged fields: confidence, suppression, top-k, size, duplicates.

    Merging only happens when patches overlap (``padding``) and a threshold is set.
    """
    kept = scoring.confident(boxes, conf)
    if nms_iou is not None:
        kept = scoring.non_maximum_suppression(kept, nms_iou)
    kept = scoring.top_per_patch(kept, max_detections)
    kept = kept.withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    kept = labelling.size_filter(kept, min_size, max_size, keep_bounds=False)
    if padding > 0 and (iou_min > 0 or contain_min > 0):
        return merging.merge_duplicate_boxes(kept, iou_min, contain_min)
    return kept.select(
        F.col("id").alias("comp"), F.col("id").cast("string").alias("ids"), F.lit(1).cast("bigint").alias("parts"),
        "area", (2 * (F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0"))).alias("perimeter"),
    )


def score_classes(cells: DataFrame, scores: str, threshold: float) -> DataFrame:
    """Quantised scores (background, field, boundary) -> ``cls``: 1 field, 2 boundary, 0 neither."""
    field, boundary = scoring.masks_from_scores(F.col(scores), threshold)
    return cells.withColumn("cls", F.when(field == 1, 1).when(boundary == 1, 2).otherwise(0))


def field_polygons(
    cells: DataFrame, keys: list[str], stride: int = labelling.DEFAULT_STRIDE,
    affine: tuple[float, ...] = (10.0, 0.0, 0.0, 0.0, -10.0, 0.0), min_size: float | None = 500, max_size: float | None = None,
    merge_ratio: float | None = None, tolerance: float = 0, close_interiors: bool = False, hook: rings.XY | None = None,
    scores: str | None = None, score_threshold: float = 0.5, **mask_options,
) -> DataFrame:
    """Class or score raster -> field polygons: ``keys, id, exterior, interiors, area, perimeter``.

    Mask (scores, thinning, morphology), labelling by tile, closing and thinning out of rings, measures, sizes and
    ids, then merging over tile edges. ``hook`` maps coordinates for the measures (an equal-area plane where
    the raster is in degrees). Merged fields are outlined anew from their cells, so simplification comes after it; where
    parts are neither closed, thinned out nor measured elsewhere, their cells give their size and they are not outlined.
    """
    if scores is not None:
        cells = score_classes(cells, scores, score_threshold)
    runs = labelling.label_fields(field_mask(cells, keys, **mask_options), keys, stride)
    if merge_ratio is not None:
        runs = cut(runs)

    def finished(shapes: DataFrame) -> DataFrame:
        if close_interiors:
            shapes = shapes.withColumn("interiors", rings.drop_interiors(F.col("interiors")))
        return unions.measured(outlines.simplify(shapes, tolerance), hook)

    as_traced = not close_interiors and tolerance <= 0 and hook is None

    def shapes() -> DataFrame:
        return finished(outlines.field_polygons(runs, [*keys, "ty", "tx"], affine=affine))

    if merge_ratio is None:
        kept = labelling.running_id(labelling.size_filter(shapes(), min_size, max_size), keys)
        return kept.select(*keys, F.col("id").cast("string").alias("id"), "exterior", "interiors", "area", "perimeter")
    a, b, _, d, e, _ = affine
    stats = labelling.cell_metrics(labelling.field_stats(runs, keys), math.hypot(a, d), math.hypot(b, e))
    if not as_traced:
        ref = [*keys, "ty", "tx", "comp"]
        sized = cut(labelling.size_filter(shapes(), min_size, max_size).select(*ref))
        named = cut(stats.join(labelling.running_id(sized, keys), ref))
    else:
        sized = stats.withColumn("area", F.col("cells") * abs(a * e - b * d))
        named = cut(labelling.running_id(labelling.size_filter(sized, min_size, max_size), keys))
    merged = merging.merged_field_polygons(runs, named, keys, stride, merge_ratio, affine)
    merged = merged if as_traced else finished(merged)
    return merged.select(*keys, F.col("ids").alias("id"), "exterior", "interiors", "area", "perimeter")


def write_field_polygons(polygons: DataFrame, path: str, kind: str = "geoparquet", srid: int = 4326, overwrite: bool = False,
                         time_tag: Column | None = None, to_degrees: rings.XY | None = None) -> None:
    """Field polygons -> GeoParquet parts, one GeoJSON document or JSON lines; the latter two in degrees if a map to them is given."""
    if kind == "geoparquet":
        writers.write_fields(writers.field_table(polygons, time_tag), path, srid, overwrite)
        return
    if kind not in ("geojson", "ndjson"):
        raise ValueError(f"unknown kind of file {kind!r}")
    features = writers.field_features(writers.reproject(polygons, to_degrees) if to_degrees else polygons)
    (writers.write_geojson if kind == "geojson" else writers.write_ndjson)(features, path, overwrite)


def postprocess_polygons(
    polygons: DataFrame, simplify: float = 0, padding: int = 1, min_size: float | None = 500, max_size: float | None = 100000,
    close_interiors: bool = True, iou_min: float = 0.2, contain_min: float = 0.8, step: float = 2.5, grid: float = 10.0,
    hook: rings.XY | None = None,
) -> DataFrame:
    """Detections as polygons of any shape (``id, exterior, interiors``, in metres) -> merged fields with rings.

    Holes are closed, rings thinned out, sizes checked (both bounds drop out), duplicates merged where patches overlap,
    and the final rings measured, through ``hook`` if given. Invalid and empty polygons fall away.
    """
    if close_interiors:
        polygons = polygons.withColumn("interiors", rings.drop_interiors(F.col("interiors")))
    shapes = outlines.simplify(polygons, simplify)
    sized = labelling.size_filter(unions.measured(outlines.valid_polygons(shapes)), min_size, max_size, keep_bounds=False)
    if padding > 0 and (iou_min > 0 or contain_min > 0):
        return unions.merge_duplicate_polygons(cut(sized.select("id", "exterior", "interiors")), iou_min, contain_min, step, grid, hook)
    return unions.measured(sized, hook).select(
        F.col("id").alias("comp"), F.col("id").cast("string").alias("ids"), F.lit(1).cast("bigint").alias("members"),
        "exterior", "interiors", "area", "perimeter")


def evaluate(pixels: DataFrame, keys: list[str], country: str = "country", iou_threshold: float = 0.5,
             stride: int = labelling.DEFAULT_STRIDE) -> DataFrame:
    """Predictions against labels: one metrics row for all and one per country."""
    stats = evaluation.chip_stats(pixels, [*keys, country], iou_threshold, stride)
    return evaluation.country_metrics(stats, country)


def filter_tiles_by_landcover(tiles: DataFrame, landcover: DataFrame, keys: list[str], cropland: int, affine: list[Column],
                              source_affine: list[Column], to_source: rings.XY | None = None, side: int = rasters.TILE_SIDE, keep: str | None = None) -> DataFrame:
    """Zero predictions off cropland on stored tiles; the land cover lies on a grid and in a projection of its own.

    ``keep`` names a column for the land cover that was looked up.
    """
    aligned = rasters.align_tiles(tiles, landcover, keys, affine, source_affine, to_source, side, name="_lc")
    crop = F.coalesce("_lc", F.transform("values", lambda v: F.lit(None).cast("int")))
    masked = aligned.withColumn("cropland_mask", F.transform(crop, lambda v: F.coalesce((v == cropland).cast("int"), F.lit(0))))
    masked = masked.withColumn("values", F.zip_with("values", "cropland_mask", lambda v, m: F.when(v.isNotNull(), v * m)))
    return masked.withColumnRenamed("_lc", keep) if keep else masked.drop("_lc")


def filter_by_landcover(cells: DataFrame, landcover: DataFrame, keys: list[str], cropland: Column,
                        scale_y: Column, scale_x: Column) -> DataFrame:
    """Zero predictions off cropland."""
    return rasters.mask_cropland(rasters.align_landcover(cells, landcover, keys, scale_y, scale_x), cropland)
