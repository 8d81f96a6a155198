"""Neighbourhood operators on cell tables: morphology, thinning, smoothing, edges.

Two forms. Window form: ``lag``/``lead`` along rows and columns, all built-in. Tile form: each
tile gets a margin of neighbouring cells once, then a short array function runs any number of
steps, so n steps cost one shuffle instead of 2n.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.raster_math import gaussian_kernel
from furrow.session import cut


def _axes(keys: list[str]):
    return Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")


def morph_step(cells: DataFrame, keys: list[str], value: str, grow: bool) -> DataFrame:
    """One cross-shaped dilation (grow) or erosion of dense cells; a border cell stands in for
    its missing neighbours."""
    pick = F.greatest if grow else F.least
    v = F.col(value)
    along, across = _axes(keys)
    side = pick(F.coalesce(F.lag(v).over(along), v), F.coalesce(F.lead(v).over(along), v), v)
    updown = pick(F.coalesce(F.lag(v).over(across), v), F.coalesce(F.lead(v).over(across), v), v)
    return cells.withColumn("_h", side).withColumn("_v", updown).withColumn(
        value, pick("_h", "_v")
    ).drop("_h", "_v")


def with_margin(cells: DataFrame, stride: int, halo: int) -> DataFrame:
    """Send each cell to its tile and to every tile whose margin reaches it."""
    def span(axis: str) -> Column:
        return F.explode(F.sequence(
            F.floor((F.col(axis) - halo) / stride).cast("int"), F.floor((F.col(axis) + halo) / stride).cast("int")
        ))

    return cells.withColumn("ty", span("y")).withColumn("tx", span("x"))


def tile_apply(
    cells: DataFrame, keys: list[str], value: str, stride: int, halo: int,
    fn: Callable[[np.ndarray, np.ndarray], np.ndarray], out_type: str = "int", keep_zero: bool = True,
) -> DataFrame:
    """Run ``fn(values, present)`` on every tile with its margin; gives ``keys, y, x, value``.

    ``present`` marks cells that exist, which shows ``fn`` the raster border. A group is one tile
    of at most (stride + 2 halo)^2 cells.
    """
    schema = cells.select(*keys).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    side = stride + 2 * halo

    def run(key: tuple[pa.Scalar, ...], tile: pa.Table) -> pa.Table:
        ys, xs = tile["y"].to_numpy(), tile["x"].to_numpy()
        rows, cols = ys - (key[-2].as_py() * stride - halo), xs - (key[-1].as_py() * stride - halo)
        grid = np.zeros((side, side), dtype=np.float64 if out_type == "double" else np.int64)
        present = np.zeros((side, side), dtype=bool)
        grid[rows, cols] = tile[value].to_numpy()
        present[rows, cols] = True
        result = fn(grid, present)[rows, cols]
        inner = (rows >= halo) & (rows < halo + stride) & (cols >= halo) & (cols < halo + stride)
        if not keep_zero:
            inner &= result != 0
        out = tile.select([*keys, "y", "x"]).filter(pa.array(inner))
        return out.append_column(value, pa.array(result[inner], pa.float64() if out_type == "double" else pa.int32()))

    placed = with_margin(cells.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), value), stride, halo)
    return placed.groupBy(*keys, "ty", "tx").applyInArrow(run, f"{fields}, y int, x int, `{value}` {out_type}")


def _cross(values: np.ndarray, present: np.ndarray, grow: bool, times: int) -> np.ndarray:
    pick = np.maximum if grow else np.minimum
    for _ in range(times):
        result = values.copy()
        for axis in (0, 1):
            for step in (1, -1):
                moved = np.roll(values, step, axis)
                seen = np.roll(present, step, axis)
                edge = [slice(None)] * 2
                edge[axis] = 0 if step == 1 else -1
                seen[tuple(edge)] = False
                result = np.where(seen, pick(result, moved), result)
        values = result
    return values


def open_close(cells: DataFrame, keys: list[str], value: str, opening: int = 0, closing: int = 0,
               stride: int = 1024) -> DataFrame:
    """Raster opening (erode, dilate) or closing; opening wins when both are asked."""
    n = opening or closing
    if n <= 0:
        return cells.select(*keys, "y", "x", value)
    first_grows = opening <= 0

    def both(values: np.ndarray, present: np.ndarray) -> np.ndarray:
        return _cross(_cross(values, present, first_grows, n), present, not first_grows, n)

    return tile_apply(cells, keys, value, stride, 2 * n, both)


def _thin_half(img: np.ndarray, second: bool) -> np.ndarray:
    """Cells one half-step of the parallel thinning removes (zero outside)."""
    p = np.pad(img, 1)
    h, w = img.shape
    # neighbours clockwise from north
    ring = [p[1 + dy:1 + dy + h, 1 + dx:1 + dx + w] for dy, dx in
            ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
    count = sum(ring)
    rises = sum((a == 0) & (b == 1) for a, b in zip(ring, ring[1:] + ring[:1]))
    n, e, s, w_ = ring[0], ring[2], ring[4], ring[6]
    if second:
        free = (n * e * w_ == 0) & (n * s * w_ == 0)
    else:
        free = (n * e * s == 0) & (e * s * w_ == 0)
    return (img == 1) & (count >= 2) & (count <= 6) & (rises == 1) & free


def thin_once(img: np.ndarray) -> np.ndarray:
    out = img.copy()
    for second in (False, True):
        out[_thin_half(out, second)] = 0
    return out


def thin(cells: DataFrame, keys: list[str], stride: int = 1024, per_round: int = 8, max_iters: int = 0) -> DataFrame:
    """Thin the given foreground cells (``keys, y, x``) to a skeleton.

    Each full iteration looks two cells far, so a margin of twice the iterations makes a tile's
    result equal to the whole raster's. Rounds go on until the last iteration of a round removed
    nothing anywhere; each round's result is written, so the plan stays short.
    """
    live = cells.select(*keys, "y", "x").withColumn("v", F.lit(1))
    done = 0
    while True:
        steps = per_round if max_iters == 0 else min(per_round, max_iters - done)
        if steps <= 0:
            break

        def run(values: np.ndarray, present: np.ndarray, steps: int = steps) -> np.ndarray:
            img = values
            for _ in range(steps - 1):
                img = thin_once(img)
            last = thin_once(img)
            return last + 2 * (img - last)  # 2 marks a cell the last iteration removed

        marked = cut(tile_apply(live, keys, "v", stride, 2 * steps, run, keep_zero=False))
        done += steps
        live = marked.filter(F.col("v") == 1)
        if marked.agg(F.count_if(F.col("v") == 2)).first()[0] == 0:
            break
    return live.drop("v")


def thin_step_window(cells: DataFrame, keys: list[str], value: str, second: bool) -> DataFrame:
    """One thinning half-step in window form on dense 0/1 cells."""
    along, across = _axes(keys)
    v = F.col(value)

    def at(c, k: int, w) -> Column:
        return F.coalesce(F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w), F.lit(0))

    # column triple packed as up + 2 centre + 4 down, then three triples side by side
    packed = cells.withColumn("_t", at(v, 1, across) + 2 * v + 4 * at(v, -1, across))
    packed = packed.withColumn("_w", at("_t", 1, along)).withColumn("_e", at("_t", -1, along))

    def bit(c: str, b: int) -> Column:
        return F.shiftright(F.col(c), b).bitwiseAND(F.lit(1))

    ring = [bit("_t", 0), bit("_e", 0), bit("_e", 1), bit("_e", 2), bit("_t", 2), bit("_w", 2), bit("_w", 1), bit("_w", 0)]
    names = [f"_p{i}" for i in range(8)]
    packed = packed.withColumns(dict(zip(names, ring)))
    p = [F.col(n) for n in names]
    count = sum(p[1:], p[0])
    rises = [F.when((a == 0) & (b == 1), 1).otherwise(0) for a, b in zip(p, p[1:] + p[:1])]
    n, e, s, w = p[0], p[2], p[4], p[6]
    free = ((n * e * w == 0) & (n * s * w == 0)) if second else ((n * e * s == 0) & (e * s * w == 0))
    gone = (v == 1) & count.between(2, 6) & (sum(rises[1:], rises[0]) == 1) & free
    return packed.withColumn(value, F.when(gone, 0).otherwise(v)).drop("_t", "_w", "_e", *names)


def fill_thinned_boundaries(cells: DataFrame, keys: list[str], height: Column, width: Column,
                            stride: int = 1024, max_iters: int = 0) -> DataFrame:
    """Give boundary cells to fields, all but a one-cell skeleton.

    ``cells``: dense ``keys, y, x, cls``. The frame of the raster never counts as boundary.
    Adds ``field`` (0/1).
    """
    framed = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == height - 1) | (F.col("x") == width - 1)
    inner = cells.withColumn("_b", (F.col("cls") == 2) & ~framed)
    skeleton = thin(inner.filter("_b"), keys, stride, max_iters=max_iters).withColumn("_s", F.lit(True))
    joined = inner.join(skeleton, [*keys, "y", "x"], "left")
    field = F.when(F.col("_s"), 0).when(F.col("_b"), 1).when(F.col("cls") == 1, 1).otherwise(0)
    return joined.withColumn("field", field).drop("_b", "_s")


def gaussian_blur(cells: DataFrame, keys: list[str], value: str, size: int = 7, sigma: float = 3.0) -> DataFrame:
    """Separable Gaussian over dense cells, mirrored at the border without repeating it."""
    kernel = gaussian_kernel(size, sigma)
    half = size // 2
    out = cells
    for axis, w in zip(("x", "y"), _axes(keys)):
        fwd, v = F.col("_before"), F.col(value)
        line = Window.partitionBy(*keys, "y" if axis == "x" else "x")
        out = out.withColumn("_before", F.row_number().over(w) - 1).withColumn(
            "_after", F.count(F.lit(1)).over(line) - F.col("_before") - 1
        )
        near = {0: v}
        for k in range(1, half + 1):
            near[-k], near[k] = F.lag(v, k).over(w), F.lead(v, k).over(w)
        near = {k: c.cast("double") for k, c in near.items()}
        picked = near[0] * kernel[half]
        for k in range(1, half + 1):
            # k steps past the border at distance d lands on the mirrored cell k - 2d away
            low, high = near[-k], near[k]
            for d in range(k):
                low = F.when(fwd == d, near[k - 2 * d]).otherwise(low)
                high = F.when(F.col("_after") == d, near[2 * d - k]).otherwise(high)
            picked = picked + (low + high) * kernel[half - k]
        out = out.withColumn("_new", picked).drop(value, "_before", "_after").withColumnRenamed("_new", value)
    return out


def canny(band: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """0/1 edges of one byte band: gradient, thinning along the gradient, hysteresis."""
    p = np.pad(band.astype(np.int64), 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    mag = np.abs(gx) + np.abs(gy)
    m = np.pad(mag, 1)
    h, w = band.shape

    def near(dy: int, dx: int) -> np.ndarray:
        return m[1 + dy:1 + dy + h, 1 + dx:1 + dx + w]

    ax, ay = np.abs(gx), np.abs(gy)
    flat, steep = ay < ax * np.tan(np.pi / 8), ay > ax * np.tan(3 * np.pi / 8)
    same = (gx ^ gy) >= 0
    peak = np.where(
        flat, (mag > near(0, -1)) & (mag >= near(0, 1)),
        np.where(
            steep, (mag > near(-1, 0)) & (mag >= near(1, 0)),
            np.where(same, (mag > near(-1, -1)) & (mag > near(1, 1)), (mag > near(-1, 1)) & (mag > near(1, -1))),
        ),
    )
    weak = peak & (mag > low)
    edge = weak & (mag > high)
    while True:
        q = np.pad(edge, 1)
        reach = np.zeros_like(edge)
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                reach |= q[dy:dy + h, dx:dx + w]
        grown = edge | (weak & reach)
        if (grown == edge).all():
            return edge.astype(np.int64)
        edge = grown


def edge_sum(chips: DataFrame, key: str, bands: str, height: int, width: int, low: float = 50, high: float = 150) -> DataFrame:
    """Chip table (``bands``: array of 8 flattened bands) -> summed edge map per chip.

    Chips are independent rows, so this is one pass without a shuffle.
    """
    key_type = chips.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            maps = []
            for stack in pdf[bands]:
                if len(stack) != 8:
                    raise ValueError(f"expected 8 bands, got {len(stack)}")
                total = np.zeros((height, width), dtype=np.int64)
                for flat in stack:
                    b = np.asarray(flat, dtype=np.float64).reshape(height, width)
                    lo, hi = b.min(), b.max()
                    scaled = ((b - lo) / (hi - lo) * 255).astype(np.uint8) if hi > lo else np.zeros_like(b, np.uint8)
                    total += canny(scaled, low, high)
                maps.append(total.ravel())
            yield pd.DataFrame({key: pdf[key], "edges": maps})

    return chips.select(key, bands).mapInPandas(run, f"`{key}` {key_type}, edges array<int>")
