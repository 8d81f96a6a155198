"""Land cover on other grids, and the flow from scores to merged polygons in a file."""

import json
import random

from pyspark.sql import functions as F

from furrow.functions import projection
from furrow.plans import flows
from furrow.sources import rasters
from test_boundary import cells_of, parts_of


def test_projection_between_grids(spark):
    """Target cells in metres of a zone, source cells in degrees: the same as looking up each cell alone."""
    rng = random.Random(4)
    target = [(1, y, x, 1) for y in range(40) for x in range(50)]
    cells = spark.createDataFrame(target, "r int, y int, x int, v int")
    source = spark.createDataFrame([(1, y, x, rng.randrange(9)) for y in range(30) for x in range(40) if (y, x) != (12, 13)], "r int, y int, x int, lc int")
    affine = [F.lit(v) for v in (10.0, 0.0, 500_100.0, 0.0, -10.0, 5_540_300.0)]
    zone = (F.lit(33), F.lit(True))

    def to_degrees(x, y):
        return projection.utm_inverse(x, y, *zone)

    corner = spark.range(1).select(*[c.alias(n) for c, n in zip(to_degrees(F.lit(500_100.0), F.lit(5_540_300.0)), "xy")]).first()
    grid = [F.lit(float(v)) for v in (0.0002, 0.0, corner["x"] - 0.001, 0.0, -0.00015, corner["y"] + 0.0003)]
    tiles = rasters.pack_tiles(cells, ["r"], "v", 16)
    got = rasters.align_tiles(tiles, rasters.pack_tiles(source, ["r"], "lc", 8), ["r"], affine, grid, to_degrees, side=8, name="lc")
    flat = rasters.unpack_tiles(got.select("r", "tile_y", "tile_x", "y0", "x0", "h", "w", F.col("lc").alias("values")), 16, "lc")
    px, py = 10.0 * (F.col("x") + 0.5) + 500_100.0, -10.0 * (F.col("y") + 0.5) + 5_540_300.0
    at = rasters.to_grid(grid, *to_degrees(px, py))
    alone = cells.withColumns({"sx": F.floor(at[0]), "sy": F.floor(at[1])}).join(
        source.select("r", F.col("y").alias("sy"), F.col("x").alias("sx"), "lc"), ["r", "sy", "sx"])
    want = {(r["y"], r["x"]): r["lc"] for r in alone.collect()}
    assert {(r["y"], r["x"]): r["lc"] for r in flat.collect()} == want and 0 < len(want) < 2000


def test_tiles_far_from_the_land_cover(spark):
    cells = spark.createDataFrame([(1, y, x, 1) for y in range(4) for x in range(4)], "r int, y int, x int, v int")
    source = spark.createDataFrame([(1, 0, 0, 5), (2, 0, 0, 5)], "r int, y int, x int, lc int")
    one = [F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0)]
    far = [F.lit(float(v)) for v in (1, 0, 900, 0, 1, 900)]
    tiles = rasters.pack_tiles(cells, ["r"], "v", 4)
    out = flows.filter_tiles_by_landcover(tiles, rasters.pack_tiles(source, ["r"], "lc", 4), ["r"], 5, one, far, side=4).first()
    assert out["values"] == [0] * 16 == out["cropland_mask"]
    near = flows.filter_tiles_by_landcover(tiles, rasters.pack_tiles(source, ["r"], "lc", 4), ["r"], 5, one, one, side=4).first()
    assert near["values"] == [1] + [0] * 15


def raster(spark, rows):
    return spark.createDataFrame([(1, y, x, int(v)) for y, row in enumerate(rows) for x, v in enumerate(row)], "r int, y int, x int, cls int")


def test_polygons_of_a_score_raster(spark, tmp_path):
    rng = random.Random(11)
    field = {(x, y) for x in range(20) for y in range(20) if rng.random() < 0.6}
    rows = [(1, y, x, [0, 200 if (x, y) in field else 20, 0]) for y in range(20) for x in range(20)]
    scores = spark.createDataFrame(rows, "r int, y int, x int, s array<int>")
    made = flows.field_polygons(scores, ["r"], 5, (1, 0, 0, 0, 1, 0), min_size=None, merge_ratio=0.0, scores="s", score_threshold=0.5)
    got = [frozenset(cells_of([[(p["x"], p["y"]) for p in r] for r in (row["exterior"], *row["interiors"])])) for row in made.collect()]
    assert sorted(map(sorted, got)) == sorted(map(sorted, parts_of(field)))
    flows.write_field_polygons(made, str(tmp_path / "doc"), "geojson")
    assert len(json.loads((tmp_path / "doc" / "fields.geojson").read_text())["features"]) == len(got)
    flows.write_field_polygons(made, str(tmp_path / "lines"), "ndjson")
    assert spark.read.json(str(tmp_path / "lines")).count() == len(got)


def test_raster_in_degrees(spark):
    """Two cells of a thousandth of a degree: measured in square metres through the equal-area plane."""
    made = flows.field_polygons(raster(spark, ["110", "000"]), ["r"], 8, (0.001, 0, 12.0, 0, -0.001, 50.0), min_size=5000, hook=projection.equal_area_point).collect()
    x0, y0 = projection.equal_area(F.lit(12.0), F.lit(49.999))
    x1, y1 = projection.equal_area(F.lit(12.002), F.lit(50.0))
    want = spark.range(1).select(((x1 - x0) * (y1 - y0)).alias("a")).first()["a"]
    assert len(made) == 1 and abs(made[0]["area"] - want) < 1e-3 and 15_000 < want < 16_500
    assert flows.field_polygons(raster(spark, ["110"]), ["r"], 8, (0.001, 0, 12.0, 0, -0.001, 50.0), min_size=20_000, hook=projection.equal_area_point).count() == 0


def test_holes_closed_and_sizes_before_merging(spark):
    image = ["11111", "10001", "11111", "00000", "10000"]
    made = flows.field_polygons(raster(spark, image), ["r"], 8, (1, 0, 0, 0, -1, 0), min_size=2, merge_ratio=0.0, close_interiors=True).collect()
    assert [(r["id"], r["area"], len(r["interiors"])) for r in made] == [("1", 15.0, 0)]
    open_ = flows.field_polygons(raster(spark, image), ["r"], 8, (1, 0, 0, 0, -1, 0), min_size=1).orderBy("id").collect()
    assert [(r["id"], r["area"], len(r["interiors"])) for r in open_] == [("1", 12.0, 1), ("2", 1.0, 0)]


def test_each_cell_is_placed_once(spark):
    """Four source tiles lie under the target tile; a cell is looked up in one of them and not in each."""
    target = spark.range(64).select(F.lit(1).alias("r"), (F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"), F.lit(1).alias("v"))
    tiles = rasters.pack_tiles(target, ["r"], "v", 8)
    source = rasters.pack_tiles(target.withColumn("v", F.col("y") * 8 + F.col("x")), ["r"], "v", 4)
    one = [F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)]
    plan = rasters.align_tiles(tiles, source, ["r"], one, one, side=4, name="lc")
    got = plan.first()
    assert got["lc"] == list(range(64))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(_found" not in text and "map_from_entries" in text
