"""Patch grids, halo trimming, stitching, corner crops and resizing by index arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _starts(extent: Column, size: Column, stride: Column) -> Column:
    last = F.greatest(F.ceil((extent - size) / stride), F.lit(0))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda i: i * stride)


def patch_grid(rasters: DataFrame, size: Column, padding: Column) -> DataFrame:
    """Overlapping windows over each raster (``height``, ``width``): one row per patch.

    The step is the size less twice the padding; the last row and column may overhang.
    ``patch_order`` is row-major.
    """
    stride = size - padding * 2
    rows, cols = _starts(F.col("height"), size, stride), _starts(F.col("width"), size, stride)
    return (
        rasters.withColumns({"size": size, "pad": padding})
        .withColumn("n_cols", F.size(cols))
        .select("*", F.posexplode(rows).alias("pr", "top"))
        .select("*", F.posexplode(cols).alias("pc", "left"))
        .withColumn("patch_order", F.col("pr") * F.col("n_cols") + F.col("pc"))
        .withColumns({"bottom": F.col("top") + F.col("size"), "right": F.col("left") + F.col("size")})
        .drop("n_cols", "pr", "pc")
    )


def trimmed(patches: DataFrame) -> DataFrame:
    """Destination window (padding off on inner sides only, clamped) and its source offset."""
    def side(inner: Column) -> Column:
        return F.when(inner, F.col("pad")).otherwise(F.lit(0))

    left, top = side(F.col("left") > 0), side(F.col("top") > 0)
    right, bottom = side(F.col("right") < F.col("width")), side(F.col("bottom") < F.col("height"))
    out = patches.withColumns({
        "dst_left": F.greatest(F.col("left") + left, F.lit(0)),
        "dst_top": F.greatest(F.col("top") + top, F.lit(0)),
        "dst_right": F.least(F.col("right") - right, F.col("width")),
        "dst_bottom": F.least(F.col("bottom") - bottom, F.col("height")),
    })
    return out.withColumns({
        "src_left": F.col("dst_left") - F.col("left"), "src_top": F.col("dst_top") - F.col("top"),
    }).filter((F.col("dst_right") > F.col("dst_left")) & (F.col("dst_bottom") > F.col("dst_top")))


def patch_cells(patches: DataFrame, cells: DataFrame, keys: list[str], stride: int) -> DataFrame:
    """Cells of every patch window: patches and cells meet on square blocks of side ``stride``."""
    p = patches.withColumn(
        "by", F.explode(F.sequence(F.floor(F.col("top") / stride),
                                   F.floor((F.least("bottom", "height") - 1) / stride)))
    ).withColumn(
        "bx", F.explode(F.sequence(F.floor(F.col("left") / stride),
                                   F.floor((F.least("right", "width") - 1) / stride)))
    )
    c = cells.withColumns({"by": F.floor(F.col("y") / stride), "bx": F.floor(F.col("x") / stride)})
    return c.join(p, [*keys, "by", "bx"]).filter(
        (F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom"))
        & (F.col("x") >= F.col("left")) & (F.col("x") < F.col("right"))
    ).drop("by", "bx")


def in_destination() -> Column:
    """True for a patch cell inside the patch's trimmed window."""
    return (
        (F.col("y") >= F.col("dst_top")) & (F.col("y") < F.col("dst_bottom"))
        & (F.col("x") >= F.col("dst_left")) & (F.col("x") < F.col("dst_right"))
    )


def stitch(placed: DataFrame, keys: list[str], value: str, order: str = "patch_order") -> DataFrame:
    """The last patch to write a pixel wins."""
    return placed.groupBy(*keys, "y", "x").agg(F.max_by(value, order).alias(value))


def first_placed(placed: DataFrame, keys: list[str], value: str, order: str = "patch_order") -> DataFrame:
    return placed.groupBy(*keys, "y", "x").agg(F.min_by(value, order).alias(value))


def check_overlap(side: int, overlap: int) -> tuple[int, int]:
    """Corner crop side and padding for a central overlap; raises on impossible sizes."""
    if not 0 < overlap < side:
        raise ValueError(f"overlap must be between 1 and {side - 1}, got {overlap}")
    if (side - overlap) % 2:
        raise ValueError("image side and overlap must have the same parity")
    crop = (side + overlap) // 2
    return crop, side - crop


def corner_crops(cells: DataFrame, side: int, overlap: int) -> DataFrame:
    """Each cell in every corner crop that holds it: ``corner`` and crop coordinates ``cy, cx``.

    Corners: 0 top-left, 1 top-right, 2 bottom-left, 3 bottom-right.
    """
    crop, pad = check_overlap(side, overlap)
    corners = F.array(*[
        F.struct(F.lit(i).alias("corner"), F.lit(pad * (i // 2)).alias("oy"), F.lit(pad * (i % 2)).alias("ox"))
        for i in range(4)
    ])
    out = cells.withColumn("_c", F.explode(corners)).withColumns({
        "corner": F.col("_c.corner"), "cy": F.col("y") - F.col("_c.oy"), "cx": F.col("x") - F.col("_c.ox"),
    }).drop("_c")
    return out.filter(F.col("cy").between(0, crop - 1) & F.col("cx").between(0, crop - 1))


def overlap_region(crops: DataFrame, side: int, overlap: int) -> DataFrame:
    """Cells of the central overlap, seen by all four crops, in overlap coordinates ``ry, rx``."""
    _, pad = check_overlap(side, overlap)
    bottom, right = F.floor(F.col("corner") / 2), F.col("corner") % 2
    out = crops.withColumns({
        "ry": F.col("cy") - pad * (1 - bottom), "rx": F.col("cx") - pad * (1 - right),
    })
    return out.filter(F.col("ry").between(0, overlap - 1) & F.col("rx").between(0, overlap - 1))


def corner_consensus(region: DataFrame, key: str, pred: str) -> DataFrame:
    """Share of overlap pixels on which the four crops agree."""
    per_pixel = region.groupBy(key, "ry", "rx").agg(
        (F.min(pred) == F.max(pred)).cast("double").alias("agree"), F.count(F.lit(1)).alias("n")
    )
    return per_pixel.groupBy(key).agg(
        F.when(F.min("n") == 4, F.avg("agree")).alias("consensus_score")
    )


def resize_nearest(flat: Column, height: int, width: int, new_height: int, new_width: int) -> Column:
    """Flattened chip -> flattened resized chip, floor of the scaled index."""
    def at(i: Column) -> Column:
        y = F.floor(F.floor(i / new_width) * height / new_height)
        x = F.floor((i % new_width) * width / new_width)
        return F.get(flat, (y * width + x).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(new_height * new_width - 1)), at)


def resize_bilinear(flat: Column, height: int, width: int, new_height: int, new_width: int) -> Column:
    """Flattened chip -> flattened resized chip, pixel centres aligned, borders clamped."""
    def axis(i: Column, n: int, m: int) -> tuple[Column, Column, Column]:
        s = F.greatest((i + 0.5) * (n / m) - 0.5, F.lit(0.0))
        low = F.least(F.floor(s), F.lit(n - 1))
        return low, F.least(low + 1, F.lit(n - 1)), s - low

    def at(i: Column) -> Column:
        y0, y1, fy = axis(F.floor(i / new_width), height, new_height)
        x0, x1, fx = axis(i % new_width, width, new_width)

        def v(y: Column, x: Column) -> Column:
            return F.get(flat, (y * width + x).cast("int"))

        top = v(y0, x0) * (1 - fx) + v(y0, x1) * fx
        low = v(y1, x0) * (1 - fx) + v(y1, x1) * fx
        return top * (1 - fy) + low * fy

    return F.transform(F.sequence(F.lit(0), F.lit(new_height * new_width - 1)), at)
