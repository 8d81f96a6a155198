"""Raster -> fields: runs, 4-connected labelling per tile, stitching, cell geometry.

Working form of a field: its runs ``(keys, ty, tx, comp, y, x0, x1)``, the maximal horizontal
stretches of its cells. Area, perimeter and contacts are counts over runs, exact for any field
traced from a grid. ``comp`` names a field inside its tile by its first cell in row-major order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.graph import root_labels, with_components
from furrow.operators.skew import attach_group
from furrow.session import cut

ROW_STEP = 1 << 31  # first-cell code = y * ROW_STEP + x
DEFAULT_STRIDE = 2048
BLOCK = 256  # small tiles are handed to a task as blocks of about this side
LINK_BLOCK = 2048  # side of the blocks whose contacts are linked in one task


def cell_code(y: Column, x: Column) -> Column:
    return y.cast("bigint") * F.lit(ROW_STEP) + x


def tile_keys(stride: int) -> dict[str, Column]:
    return {"ty": F.floor(F.col("y") / stride).cast("int"), "tx": F.floor(F.col("x") / stride).cast("int")}


def block_side(stride: int) -> int:
    """Side of the blocks of whole tiles that one group holds."""
    return stride * max(1, BLOCK // stride)


def block_keys(side: int) -> dict[str, Column]:
    return {"_by": F.floor(F.col("y") / side).cast("int"), "_bx": F.floor(F.col("x") / side).cast("int")}


def field_runs(cells: DataFrame, keys: list[str], stride: int = DEFAULT_STRIDE) -> DataFrame:
    """Cells of one class -> maximal runs inside each tile (gaps and islands)."""
    return _block_runs(cells, keys, stride).drop("_by", "_bx")


def _block_runs(cells: DataFrame, keys: list[str], stride: int) -> DataFrame:
    """Runs with the block ``_by, _bx`` of their tile.

    Rows are hashed once on (keys, block) and sorted once; the windows and the labelling that
    follows all use that partitioning. First and last cells are told by their neighbours, so no table of runs is held.
    """
    block = [*keys, "_by", "_bx"]
    tile = [*block, "ty", "tx"]
    placed = cells.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    placed = placed.withColumns({**tile_keys(stride), **block_keys(block_side(stride))}).repartition(*block)
    row = Window.partitionBy(*tile, "y").orderBy("x")
    x = F.col("x")
    ends = placed.withColumns({
        "_first": F.coalesce(F.lag("x").over(row) < x - 1, F.lit(True)), "_last": F.coalesce(F.lead("x").over(row) > x + 1, F.lit(True)),
    }).filter("_first OR _last")
    # the row after a first cell is its last one
    return ends.withColumn("x1", F.when(F.col("_last"), x).otherwise(F.lead("x").over(row))).filter("_first").select(
        *tile, "y", x.alias("x0"), "x1")


def _places(runs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Order of runs by tile, row and column, their first and last cells as places on one line, and the step to the row below.

    Rows that do not follow each other in one tile lie two steps apart, so no run of one meets a run of the other.
    """
    y, x0 = runs["y"].to_numpy().astype(np.int64), runs["x0"].to_numpy().astype(np.int64)
    if "ty" in runs.column_names:
        ty, tx = runs["ty"].to_numpy(), runs["tx"].to_numpy()
    else:
        ty = tx = np.zeros(len(y), np.int64)
    order = np.lexsort((x0, y, tx, ty))
    y, x0, ty, tx = y[order], x0[order], ty[order], tx[order]
    length = runs["x1"].to_numpy().astype(np.int64)[order] - x0
    down = np.diff(y)
    apart = (np.diff(ty) != 0) | (np.diff(tx) != 0) | (down > 1)
    row = np.concatenate(([0], np.cumsum(np.where(apart, 2, down))))
    low = x0.min()
    step = int((x0 + length).max() - low) + 2
    start = row * step + (x0 - low)
    return order, start, start + length, step


def _label_tile(runs: pa.Table) -> pa.Table:
    """Join runs of neighbouring rows of a tile that overlap; report cells shared with the row above.

    The runs may be those of several tiles.
    """
    order, start, end, step = _places(runs)
    # overlapping runs of the row above form one contiguous stretch of the sorted runs
    first = np.searchsorted(end, start - step, side="left")
    last = np.searchsorted(start, end - step, side="right")
    n_up = np.maximum(last - first, 0)
    below = np.repeat(np.arange(len(start)), n_up)
    above = np.repeat(first, n_up) + np.arange(len(below)) - np.repeat(np.cumsum(n_up) - n_up, n_up)
    shared = np.minimum(end[below] - step, end[above]) - np.maximum(start[below] - step, start[above]) + 1
    code = (runs["y"].to_numpy().astype(np.int64) * ROW_STEP + runs["x0"].to_numpy())[order]
    comp = code[root_labels(len(start), below, above)]
    up = np.bincount(below, weights=shared, minlength=len(start)).astype(np.int64)
    return runs.take(pa.array(order)).append_column("comp", pa.array(comp)).append_column("up", pa.array(up))


def label_runs(runs: DataFrame, keys: list[str], group: list[str] | None = None) -> DataFrame:
    """4-connected labelling inside each tile; ``group`` names columns that hold several tiles together."""
    types = {f.name: f.dataType.simpleString() for f in runs.schema.fields}
    out = ", ".join(f"`{c}` {types[c]}" for c in runs.columns) + ", comp bigint, up bigint"
    return runs.groupBy(*keys, *(group or ["ty", "tx"])).applyInArrow(_label_tile, out)


def label_fields(cells: DataFrame, keys: list[str], stride: int = DEFAULT_STRIDE) -> DataFrame:
    """Labelled runs of the fields of each tile; regions are cut at tile edges.

    Small tiles are labelled block by block, so a group has at most as many cells as a tile or a block.
    """
    return label_runs(_block_runs(cells, keys, stride), keys, ["_by", "_bx"]).drop("_by", "_bx")


def run_cells(runs: DataFrame) -> DataFrame:
    """Runs -> one row per cell."""
    return runs.withColumn("x", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1", "up")


def field_stats(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Cells, exposed cell sides and cell box of each field of each tile."""
    length = F.col("x1") - F.col("x0") + 1
    return runs.groupBy(*keys, "ty", "tx", "comp").agg(
        F.sum(length).cast("bigint").alias("cells"),
        (2 * F.sum(length) - 2 * F.sum("up")).cast("bigint").alias("sides_h"),
        (2 * F.count(F.lit(1))).cast("bigint").alias("sides_v"),
        F.min("y").alias("y_min"), F.min("x0").alias("x_min"),
        F.max("y").alias("y_max"), F.max("x1").alias("x_max"),
    )


def cell_metrics(stats: DataFrame, pixel_w: Column | float = 10.0, pixel_h: Column | float = 10.0) -> DataFrame:
    """Area and perimeter from counts and the pixel size."""
    w = pixel_w if isinstance(pixel_w, Column) else F.lit(pixel_w)
    h = pixel_h if isinstance(pixel_h, Column) else F.lit(pixel_h)
    return stats.withColumn("area", F.col("cells") * w * h).withColumn(
        "perimeter", F.col("sides_h") * w + F.col("sides_v") * h
    )


def size_filter(polygons: DataFrame, min_size: float | None = 500, max_size: float | None = None,
                keep_bounds: bool = True) -> DataFrame:
    """Drop small and large polygons; the bounds themselves stay only if ``keep_bounds``."""
    area = F.col("area")
    if min_size is not None:
        polygons = polygons.filter(area >= min_size if keep_bounds else area > min_size)
    if max_size is not None:
        polygons = polygons.filter(area <= max_size if keep_bounds else area < max_size)
    return polygons


def running_id(fields: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """1-based id per raster in tile-row-major, then first-cell order.

    Ranks inside a tile plus an offset from the counts of earlier tiles, so the only
    per-raster window runs over one row per tile.
    """
    tile = [*keys, "ty", "tx"]
    inner = Window.partitionBy(*tile).orderBy("comp")
    earlier = Window.partitionBy(*keys).orderBy("ty", "tx").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        fields.groupBy(*tile).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("off", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    )
    return (
        fields.withColumn("_r", F.row_number().over(inner)).join(offsets, tile)
        .withColumn(name, (F.col("_r") + F.col("off")).cast("bigint")).drop("_r", "off")
    )


def tile_contacts(runs: DataFrame, keys: list[str], stride: int) -> DataFrame:
    """Cell sides shared by fields of neighbouring tiles: ``keys, a, b, sides_v, sides_h``.

    Only cells on tile edges take part. ``a`` and ``b`` are first-cell codes, unique per raster
    because tiles do not share cells.
    """
    ref = [*keys, "comp"]
    right = runs.filter((F.col("x1") + 1) % stride == 0).select(
        *ref, "y", (F.col("x1") + 1).alias("x"), F.lit("v").alias("side")
    )
    left = runs.filter(F.col("x0") % stride == 0).select(
        *ref, "y", F.col("x0").alias("x"), F.lit("v").alias("side")
    )
    down = run_cells(runs.filter((F.col("y") + 1) % stride == 0)).select(
        *ref, (F.col("y") + 1).alias("y"), "x", F.lit("h").alias("side")
    )
    up = run_cells(runs.filter(F.col("y") % stride == 0)).select(*ref, "y", "x", F.lit("h").alias("side"))
    one = right.unionByName(down).withColumnRenamed("comp", "a")
    two = left.unionByName(up).withColumnRenamed("comp", "b")
    return (
        one.join(two, [*keys, "side", "y", "x"])
        .groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg(
            F.count_if(F.col("side") == "v").alias("sides_v"),
            F.count_if(F.col("side") == "h").alias("sides_h"),
        )
    )


def stitched(runs: DataFrame, keys: list[str], stride: int) -> DataFrame:
    """Undo the tile cuts: add ``label``, the smallest first-cell code of the whole region."""
    return _with_labels(runs, moved_labels(tile_contacts(runs, keys, stride), keys), keys)


def merge_labels(fields: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Component label per field from accepted pairs: ``keys, comp, label``.

    Labels are the smallest first-cell code of the group.
    """
    return _with_labels(fields.select(*keys, "comp"), moved_labels(pairs, keys), keys)


def _with_labels(rows: DataFrame, moved: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(moved, [*keys, "comp"], "left").withColumn("label", F.coalesce("label", "comp"))


def _contracted(pairs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Fields that pairs link to a smaller one, and the smallest one they reach."""
    codes, flat = np.unique(np.concatenate((pairs["a"].to_numpy(), pairs["b"].to_numpy())), return_inverse=True)
    root = codes[root_labels(len(codes), *flat.reshape(2, -1))]
    moved = root != codes
    return codes[moved], root[moved]


def moved_labels(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, comp, label`` of the fields that pairs ``keys, a, b`` link to a smaller one.

    Pairs are contracted block by block of the place of ``a``. A raster whose pairs lie in one block is
    done with that; only rasters of several blocks go through the rounds on the whole graph.
    """
    types = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    place = {"_by": F.floor(F.shiftright("a", 31) / LINK_BLOCK), "_bx": F.floor(F.col("a").bitwiseAND(F.lit(ROW_STEP - 1)) / LINK_BLOCK)}
    block = [*keys, *place]

    def run(key: tuple[pa.Scalar, ...], links: pa.Table) -> pa.Table:
        comp, label = _contracted(links)
        return pa.table([*[pa.repeat(k, len(comp)) for k in key], pa.array(comp), pa.array(label)], names=[*block, "comp", "label"])

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", _by bigint, _bx bigint, comp bigint, label bigint"
    placed = pairs.filter("a <> b").select(*keys, F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    stars = cut(placed.withColumns(place).groupBy(*block).applyInArrow(run, schema))
    several = stars.groupBy(*keys).agg(
        F.min(F.struct(*place)).alias("_low"), F.max(F.struct(*place)).alias("_high")).filter("_low <> _high").select(*keys)
    if several.isEmpty():
        return stars.select(*keys, "comp", "label")
    several = cut(several)
    linked = _linked_labels(stars.join(several, keys, "left_semi"), keys)
    return stars.join(several, keys, "left_anti").select(*keys, "comp", "label").unionByName(linked)


def _linked_labels(stars: DataFrame, keys: list[str]) -> DataFrame:
    """The same from links of ``comp`` and ``label`` that cross blocks."""
    ends = F.explode(F.array("comp", "label")).alias("comp")
    nodes = cut(stars.select(*keys, ends).distinct().withColumn("node", F.monotonically_increasing_id()))
    src = nodes.withColumnRenamed("node", "src")
    dst = nodes.withColumnsRenamed({"comp": "label", "node": "dst"})
    edges = stars.join(src, [*keys, "comp"]).join(dst, [*keys, "label"]).select("src", "dst")
    grouped = with_components(nodes, edges, "node", "_group")
    return attach_group(grouped, [*keys, "_group"], label=F.min("comp")).select(*keys, "comp", "label")
