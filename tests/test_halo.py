"""Stored tiles with exchanged edge strips against the cell form."""

import random

import pytest
from pyspark.sql import functions as F

from furrow.operators import halo, labelling, stencil
from furrow.sources import rasters


def raster(spark, height, width, seed, gaps=0.0):
    rng = random.Random(seed)
    return spark.createDataFrame([(r, y, x, int(rng.random() < 0.55)) for r in (1, 2) for y in range(height) for x in range(width) if rng.random() >= gaps],
                                 "r int, y int, x int, v int")


@pytest.mark.parametrize(("height", "width", "side", "gaps"), [(20, 26, 6, 0.0), (9, 9, 8, 0.0), (18, 18, 6, 0.1), (5, 5, 16, 0.0)])
@pytest.mark.parametrize("closing", [True, False])
def test_open_and_close(spark, height, width, side, gaps, closing):
    cells = raster(spark, height, width, height + width, gaps)
    tiles = rasters.pack_tiles(cells, ["r"], "v", side)
    steps = {"closing": 1} if closing else {"opening": 1}
    got = rasters.unpack_tiles(halo.open_close_tiles(tiles, ["r"], **steps), side, "v")
    want = stencil.open_close(cells, ["r"], "v", stride=32, **steps)
    assert sorted(map(tuple, got.select("r", "y", "x", "v").collect())) == sorted(map(tuple, want.select("r", "y", "x", "v").collect()))


def test_labels_of_stored_tiles(spark):
    cells = raster(spark, 30, 22, 5)
    tiles = rasters.pack_tiles(cells, ["r"], "v", 8)
    columns = ["r", "ty", "tx", "y", "x0", "x1", "comp", "up"]
    got = halo.tile_runs(tiles, ["r"]).select(*columns)
    want = labelling.label_fields(cells.filter("v = 1"), ["r"], 8).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Exchange" not in halo.tile_runs(spark.createDataFrame([], tiles.schema), ["r"])._jdf.queryExecution().executedPlan().toString()


def test_strips_reach_the_right_neighbours(spark):
    cells = spark.createDataFrame([(1, y, x, 10 * y + x) for y in range(6) for x in range(6)], "r int, y int, x int, v int")
    strips = {(s["tile_y"], s["tile_x"], s["strip"]["y0"], s["strip"]["x0"]): s["strip"]["values"] for s in halo.edge_strips(rasters.pack_tiles(cells, ["r"], "v", 3), ["r"], 1).collect()}
    assert strips[1, 1, 2, 2] == [22] and strips[0, 1, 0, 2] == [2, 12, 22] and strips[1, 0, 2, 0] == [20, 21, 22] and strips[0, 0, 3, 3] == [33]


def test_no_row_per_cell_is_exchanged(spark):
    tiles = spark.createDataFrame([(1, 0, 0, 0, 0, 1, 1, [1])], "r int, tile_y int, tile_x int, y0 int, x0 int, h int, w int, values array<int>")
    plan = halo.open_close_tiles(tiles, ["r"], closing=2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1  # the strips alone are rows of their own
    assert halo.open_close_tiles(tiles.filter(F.lit(False)), ["r"], closing=2).count() == 0
