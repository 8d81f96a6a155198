"""Neighbourhood work on stored tiles: edge strips go to the eight neighbours, tile rows stay whole.

Tiles are rows of ``pack_tiles``: ``keys, tile_y, tile_x, y0, x0, h, w, values`` (row-major, absent cells null). What is
exchanged is one row per tile and, for a margin of m cells, at most eight strips of it, so a stencil over a raster of
n x n tiles moves 4 m / n of the cells besides the tiles, and never one row per cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.labelling import _label_tile
from furrow.operators.stencil import _cross

AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _rows(values: Column, width: Column, r0: Column, rows: Column, c0: Column, columns: Column) -> Column:
    """The rectangle of a row-major array, row by row."""
    picked = F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.slice(values, (r0 + r) * width + c0 + 1, columns))
    return F.when((rows > 0) & (columns > 0), F.flatten(picked)).otherwise(F.slice(values, 1, 0))


def edge_strips(tiles: DataFrame, keys: list[str], margin: int) -> DataFrame:
    """``keys, tile_y, tile_x`` of the neighbour, and the strip for it with its place in the raster."""
    def part(d: int, size: Column) -> tuple[Column, Column]:
        wide = F.least(F.lit(margin), size)
        if d == 0:
            return F.lit(0), size
        return (F.lit(0), wide) if d < 0 else (size - wide, wide)

    made = []
    for dy, dx in AROUND:
        (r0, rows), (c0, columns) = part(dy, F.col("h")), part(dx, F.col("w"))
        made.append(F.struct(
            (F.col("tile_y") + dy).alias("tile_y"), (F.col("tile_x") + dx).alias("tile_x"),
            F.struct((F.col("y0") + r0).cast("int").alias("y0"), (F.col("x0") + c0).cast("int").alias("x0"), rows.cast("int").alias("h"),
                     columns.cast("int").alias("w"), _rows(F.col("values"), F.col("w"), r0, rows, c0, columns).alias("values")).alias("strip"),
        ))
    return tiles.select(*keys, F.explode(F.array(*made)).alias("s")).select(*keys, "s.*")


def with_strips(tiles: DataFrame, keys: list[str], margin: int) -> DataFrame:
    """Tiles with ``strips``: what their neighbours, at most eight, have along the common edge."""
    held = edge_strips(tiles, keys, margin).groupBy(*keys, "tile_y", "tile_x").agg(F.collect_list("strip").alias("strips"))
    return tiles.join(held, [*keys, "tile_y", "tile_x"], "left")


def _placed(grid: np.ndarray, present: np.ndarray, top: int, left: int, y0: int, x0: int, h: int, w: int, values: pa.Array) -> None:
    """Put a rectangle of values into a grid whose first cell is ``top, left``; what lies outside is cut off."""
    if not h or not w:
        return
    there = np.asarray(values.is_valid().to_numpy(zero_copy_only=False), bool).reshape(h, w)
    own = values.fill_null(0).to_numpy(zero_copy_only=False).reshape(h, w)
    r0, r1 = max(y0, top), min(y0 + h, top + grid.shape[0])
    c0, c1 = max(x0, left), min(x0 + w, left + grid.shape[1])
    if r0 < r1 and c0 < c1:
        grid[r0 - top:r1 - top, c0 - left:c1 - left] = own[r0 - y0:r1 - y0, c0 - x0:c1 - x0]
        present[r0 - top:r1 - top, c0 - left:c1 - left] = there[r0 - y0:r1 - y0, c0 - x0:c1 - x0]


def apply_tiles(tiles: DataFrame, keys: list[str], margin: int, fn: Kernel) -> DataFrame:
    """Run ``fn(values, present)`` on each tile with its margin; the tiles keep their place and their gaps.

    ``values`` must be of a whole-number type; ``present`` shows ``fn`` the gaps and the border of the raster.
    """
    names = [*keys, "tile_y", "tile_x", "y0", "x0", "h", "w"]
    schema = tiles.select(*names, F.col("values").cast("array<int>").alias("values")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                y0, x0, h, w = (batch.column(c)[i].as_py() for c in ("y0", "x0", "h", "w"))
                grid = np.zeros((h + 2 * margin, w + 2 * margin), np.int64)
                present = np.zeros(grid.shape, bool)
                own = batch.column("values")[i].values
                _placed(grid, present, y0 - margin, x0 - margin, y0, x0, h, w, own)
                strips = batch.column("strips")[i]
                for s in strips if strips.is_valid else ():
                    _placed(grid, present, y0 - margin, x0 - margin, *(s[c].as_py() for c in ("y0", "x0", "h", "w")), s["values"].values)
                inner = (slice(margin, margin + h), slice(margin, margin + w))
                made = fn(grid, present)[inner]
                out.append(pa.array(made.ravel().astype(np.int32), pa.int32(), mask=~present[inner].ravel()))
            offsets = np.concatenate(([0], np.cumsum([len(o) for o in out]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(out) if out else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], names=[*names, "values"])

    asked = with_strips(tiles, keys, margin).select(*names, F.col("values").cast("array<int>").alias("values"), F.transform(
        "strips", lambda s: F.struct(s["y0"].alias("y0"), s["x0"].alias("x0"), s["h"].alias("h"), s["w"].alias("w"), s["values"].cast("array<int>").alias("values"))).alias("strips"))
    return asked.mapInArrow(run, schema)


def open_close_tiles(tiles: DataFrame, keys: list[str], opening: int = 0, closing: int = 0) -> DataFrame:
    """Raster opening or closing of stored tiles whose sides are at least the margin; opening wins when both are asked."""
    n = opening or closing
    if n <= 0:
        return tiles
    grows = opening <= 0
    return apply_tiles(tiles, keys, 2 * n, lambda v, p: _cross(_cross(v, p, grows, n), p, not grows, n))


def tile_runs(tiles: DataFrame, keys: list[str], wanted: int = 1) -> DataFrame:
    """Labelled runs of each stored tile, as ``label_fields`` gives them, without any exchange.

    ``keys, ty, tx, y, x0, x1, comp, up`` of the cells whose value is ``wanted``.
    """
    types = {f.name: f.dataType.simpleString() for f in tiles.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", ty int, tx int, y int, x0 int, x1 int, comp bigint, up bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                y0, x0, h, w = (batch.column(c)[i].as_py() for c in ("y0", "x0", "h", "w"))
                grid = batch.column("values")[i].values.fill_null(wanted - 1).to_numpy(zero_copy_only=False).reshape(h, w) == wanted
                edges = np.diff(np.pad(grid.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                (rows, starts), (_, ends) = np.nonzero(edges == 1), np.nonzero(edges == -1)
                if not len(rows):
                    continue
                runs = pa.table({
                    "y": pa.array(rows + y0, pa.int32()), "x0": pa.array(starts + x0, pa.int32()), "x1": pa.array(ends - 1 + x0, pa.int32())})
                made = _label_tile(runs)
                n = made.num_rows
                own = [batch.column(k).take(pa.array(np.full(n, i))) for k in keys]
                place = [pa.array(np.full(n, batch.column(c)[i].as_py()), pa.int32()) for c in ("tile_y", "tile_x")]
                yield pa.RecordBatch.from_arrays([*own, *place, *(made[c].combine_chunks() for c in made.column_names)],
                                                 names=[*keys, "ty", "tx", *made.column_names])

    return tiles.select(*keys, "tile_y", "tile_x", "y0", "x0", "h", "w", F.col("values").cast("array<int>").alias("values")).mapInArrow(run, schema)
