"""Rings of any slant on a grid: scanline crossings, runs, and measures of polygon pairs.

Every side of a ring crosses the centre lines of the grid rows it spans. The crossings of a polygon on one row,
outer ring and holes together, are sorted and taken two by two: what lies between is inside. So a polygon is
its runs of cells whose centres are inside (even-odd rule, so rings that cross themselves have a defined
inside too), and areas, overlaps and unions are counts over runs, as for fields traced from a raster. Work grows with
the length of the outline over the step, not with the area.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import rings
from furrow.operators import spatial
from furrow.operators.skew import bucket_join


def _first(value: Column, step: float) -> Column:
    """First grid index whose centre is at or after a coordinate."""
    return F.ceil(value / step - 0.5).cast("bigint")


def polygon_sides(polygons: DataFrame, key: str = "id") -> DataFrame:
    """``key, a, b``: the sides of all rings, from point to point."""
    all_rings = F.concat(F.array("exterior"), F.coalesce("interiors", F.slice(F.array("exterior"), 1, 0)))
    pair = F.transform(
        F.sequence(F.lit(1), F.size("ring") - 1), lambda i: F.struct(F.get("ring", i - 1).alias("a"), F.get("ring", i).alias("b")))
    ringed = polygons.select(key, F.explode(all_rings).alias("ring")).filter(F.size("ring") > 1)
    return ringed.select(key, F.explode(pair).alias("s")).select(key, "s.a", "s.b")


def crossings(sides: DataFrame, step: float, key: str = "id") -> DataFrame:
    """``key, y, x``: where sides cross the centre lines of grid rows; a row's lower end counts, the upper does not."""
    up = sides.filter(F.col("a.y") != F.col("b.y"))
    first, last = _first(F.least("a.y", "b.y"), step), _first(F.greatest("a.y", "b.y"), step) - 1
    rows = up.withColumns({"_lo": first, "_hi": last}).filter("_lo <= _hi").withColumn("y", F.explode(F.sequence("_lo", "_hi")))
    line = (F.col("y") + 0.5) * step
    return rows.select(key, "y", (F.col("a.x") + (line - F.col("a.y")) * (F.col("b.x") - F.col("a.x")) / (F.col("b.y") - F.col("a.y"))).alias("x"))


def polygon_runs(polygons: DataFrame, step: float, key: str = "id") -> DataFrame:
    """``key, y, x0, x1``: runs of grid cells whose centres are inside each polygon."""
    row = Window.partitionBy(key, "y").orderBy("x")
    found = crossings(polygon_sides(polygons, key), step, key)
    paired = found.withColumns({"nth": F.row_number().over(row), "out": F.lead("x").over(row)}).filter("nth % 2 = 1 AND out IS NOT NULL")
    return paired.select(key, "y", _first(F.col("x"), step).alias("x0"), (_first(F.col("out"), step) - 1).alias("x1")).filter("x0 <= x1")


def run_areas(runs: DataFrame, step: float, key: str = "id") -> DataFrame:
    return runs.groupBy(key).agg((F.sum(F.col("x1") - F.col("x0") + 1) * (step * step)).alias("area"))


def polygon_boxes(polygons: DataFrame, key: str = "id") -> DataFrame:
    """``id, x0, y0, x1, y1``: bounds of the outer rings."""
    return polygons.select(F.col(key).alias("id"), rings.ring_bbox(F.col("exterior")).alias("b")).select(
        "id", F.col("b.xmin").alias("x0"), F.col("b.ymin").alias("y0"), F.col("b.xmax").alias("x1"), F.col("b.ymax").alias("y1"))


def pair_overlaps(runs: DataFrame, pairs: DataFrame, step: float) -> DataFrame:
    """``a_id, b_id, inter`` of candidate pairs whose runs share cells."""
    def side(s: str) -> DataFrame:
        return runs.select(F.col("id").alias(f"{s}_id"), "y", F.col("x0").alias(f"{s}_x0"), F.col("x1").alias(f"{s}_x1"))

    near = bucket_join(pairs.select("a_id", "b_id"), side("a"), ["a_id"])
    met = bucket_join(near, side("b"), ["b_id", "y"]).withColumn(
        "n", F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0") + 1).filter("n > 0")
    return met.groupBy("a_id", "b_id").agg((F.sum("n") * (step * step)).alias("inter"))


def pair_measures(polygons: DataFrame, step: float, base: float = 16.0) -> DataFrame:
    """``a_id, b_id, inter, iou, containment`` of all pairs that overlap on the grid, ``a_id`` < ``b_id``."""
    runs = polygon_runs(polygons, step)
    areas = run_areas(runs, step)
    candidates = spatial.intersecting_pairs(polygon_boxes(polygons), base)
    met = pair_overlaps(runs, candidates, step)
    for s in ("a", "b"):
        met = met.join(areas.select(F.col("id").alias(f"{s}_id"), F.col("area").alias(f"{s}_area")), f"{s}_id")
    inter = F.col("inter")
    return met.select(
        "a_id", "b_id", "inter", (inter / (F.col("a_area") + F.col("b_area") - inter)).alias("iou"),
        (inter / F.least("a_area", "b_area")).alias("containment"))


def merged_runs(runs: DataFrame, key: str) -> DataFrame:
    """Runs that overlap or follow each other in a row of one ``key`` -> one run."""
    row = Window.partitionBy(key, "y").orderBy("x0", "x1")
    seen = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(seen.isNull() | (F.col("x0") > seen + 1), 1).otherwise(0)
    placed = runs.withColumn("_o", opens).withColumn("_p", F.sum("_o").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.groupBy(key, "y", "_p").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_p")


def shared_sides(polygons: DataFrame, pairs: DataFrame, digits: int = 6) -> DataFrame:
    """``a_id, b_id, shared``: length of outline that both polygons of a pair have in common.

    Sides on one line share its key: direction and distance from the origin, to ``digits`` places. Each key is
    looked up in two grids of places, half a place apart, so rounding never parts two sides of one line.
    """
    d = polygon_sides(polygons).withColumns({"dx": F.col("b.x") - F.col("a.x"), "dy": F.col("b.y") - F.col("a.y")})
    d = d.withColumn("n", F.hypot("dx", "dy")).filter("n > 0")
    back = (F.col("dx") < 0) | ((F.col("dx") == 0) & (F.col("dy") < 0))
    way = F.when(back, -1.0).otherwise(1.0) / F.col("n")
    d = d.withColumns({"ux": F.col("dx") * way, "uy": F.col("dy") * way})
    along = {c: F.col("ux") * F.col(f"{c}.x") + F.col("uy") * F.col(f"{c}.y") for c in "ab"}
    d = d.select("id", "ux", "uy", (F.col("ux") * F.col("a.y") - F.col("uy") * F.col("a.x")).alias("off"),
                 F.least(along["a"], along["b"]).alias("t0"), F.greatest(along["a"], along["b"]).alias("t1"))
    grain = 10.0 ** digits

    def places(c: str) -> Column:
        return F.array(F.floor(F.col(c) * grain), F.floor(F.col(c) * grain + 0.5) + F.lit(1 << 60))

    keyed = d.withColumn("ku", F.explode(places("uy"))).withColumn("ko", F.explode(places("off")))

    def side(s: str) -> DataFrame:
        return keyed.select("ku", "ko", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "uy", "off", "t0", "t1")])

    near = 1.0 / grain
    met = bucket_join(bucket_join(pairs.select("a_id", "b_id"), side("a"), ["a_id"]), side("b"), ["b_id", "ku", "ko"]).filter(
        (F.abs(F.col("a_off") - F.col("b_off")) <= near) & (F.abs(F.col("a_uy") - F.col("b_uy")) <= near)
        & (F.least("a_t1", "b_t1") > F.greatest("a_t0", "b_t0"))
    ).drop("ku", "ko").distinct()
    return met.groupBy("a_id", "b_id").agg(F.sum(F.least("a_t1", "b_t1") - F.greatest("a_t0", "b_t0")).alias("shared"))
