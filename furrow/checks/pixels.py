"""Band arithmetic, masks, windows over cells, patches, augmentation and raster sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.checks import bindings as B
from furrow.checks.registry import query, with_
from furrow.functions import raster_math as M
from furrow.operators import evaluation, halo, patches, sampling, scoring, stencil
from furrow.plans import flows
from furrow.session import cut, scratch_path
from furrow.sinks import writers
from furrow.sources import rasters

V = B.VECTORS_SQL
# DuckDB form of the hashed draw
UNIT = "(('0x' || substr(md5(concat_ws('|', {keys}, {seed})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def unit(keys: str, seed: int = 42) -> str:
    return UNIT.format(keys=keys, seed=seed)


def exploded(df, key, arr, name="v"):
    return df.select(key, F.posexplode(arr).alias("i", name))


@query("M1_normalise", with_(V, body="SELECT vec_id, i, round(q / 3000.0::DOUBLE, 6) + 0.0::DOUBLE AS v FROM qcells"))
def normalise(spark, sf_dir):
    return exploded(B.vectors(spark, sf_dir), "vec_id", M.normalise(F.col("q")))


@query("M2_rgb_unit", with_(V, body="""
SELECT vec_id, i, round(least(greatest(q * 30 / 3000.0::DOUBLE, 0), 1), 6) + 0.0::DOUBLE AS v FROM qcells WHERE i < 3"""))
def rgb(spark, sf_dir):
    return exploded(B.vectors(spark, sf_dir), "vec_id", M.rgb_unit(F.transform("q", lambda v: v * 30)))


@query("M3_baseline_rescale", with_(V, body="""
SELECT c.vec_id, i, CASE WHEN label % 3 + 2 >= 4 THEN greatest(c.q + 1000 - 1000, 0) ELSE c.q + 1000 END AS v
FROM qcells c JOIN vectors USING (vec_id)"""))
def rescale(spark, sf_dir):
    v = B.vectors(spark, sf_dir)
    return exploded(v, "vec_id", M.baseline_rescale(F.transform("q", lambda x: x + 1000), F.col("label") % 3 + 2))


@query("M5_fill_nan", with_(V, body="""
SELECT vec_id, i, CASE WHEN q % 5 = 0 THEN -1.0::DOUBLE WHEN q % 7 = 0 THEN 1.0::DOUBLE ELSE round(v, 6) + 0.0::DOUBLE END AS v FROM qcells"""))
def fill_nan(spark, sf_dir):
    """Infinities show as 1 after division by the largest finite value."""
    c = B.vector_cells(spark, sf_dir)
    dirty = F.when(F.col("q") % 5 == 0, float("nan")).when(F.col("q") % 7 == 0, float("inf")).otherwise(F.col("v"))
    filled = M.fill_nan(dirty, -1.0)
    return c.select("vec_id", "i", F.when(filled > 1e30, filled / M.FLOAT_MAX).otherwise(filled).alias("v"))


# The 64 values of a vector as 16 pixels with 4 class scores each.
PIXELS_SQL = """
pixels AS (SELECT vec_id, pix, v[4 * pix + 1:4 * pix + 4] AS s, q[4 * pix + 1:4 * pix + 4] AS t FROM (SELECT *, unnest(range(16)) AS pix FROM vectors))"""
SOFTMAX_SQL = PIXELS_SQL + """,
sm AS (SELECT vec_id, pix, list_transform(s, lambda x: exp(x - m) / z) AS p
       FROM (SELECT *, list_sum(list_transform(s, lambda x: exp(x - m))) AS z FROM (SELECT *, list_max(s) AS m FROM pixels)))"""


def class_pixels(spark, sf_dir):
    """``vec_id, pix`` with scores ``s`` and quantised scores ``t``."""
    cut = [F.slice(c, 4 * F.col("pix") + 1, F.lit(4)).alias(n) for c, n in (("v", "s"), ("q", "t"))]
    pix = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("pix")
    return B.vectors(spark, sf_dir).select("vec_id", "v", "q", pix).select("vec_id", "pix", *cut)


def by_class(scores, name):
    return [F.get(scores, F.lit(k)).alias(f"{name}{k}") for k in range(4)]


@query("M6_softmax", with_(V, SOFTMAX_SQL, body="""
SELECT vec_id, pix, round(p[1], 6) AS p0, round(p[2], 6) AS p1, round(p[3], 6) AS p2, round(p[4], 6) AS p3 FROM sm"""))
def softmax(spark, sf_dir):
    p = class_pixels(spark, sf_dir).select("vec_id", "pix", M.softmax(F.col("s")).alias("p"))
    return p.select("vec_id", "pix", *by_class("p", "p"))


@query("M7_K3_score_bytes", with_(V, SOFTMAX_SQL, body="""
SELECT vec_id, pix, floor(p[1] * 255)::BIGINT AS s0, floor(p[2] * 255)::BIGINT AS s1, floor(p[3] * 255)::BIGINT AS s2, floor(p[4] * 255)::BIGINT AS s3 FROM sm"""))
def score_bytes(spark, sf_dir):
    s = class_pixels(spark, sf_dir).select("vec_id", "pix", scoring.scores_to_bytes(F.col("s")).alias("b"))
    return s.select("vec_id", "pix", *by_class("b", "s"))


@query("M8_argmax", with_(V, PIXELS_SQL, body="""
SELECT vec_id, pix, (list_position(t, list_max(t)) - 1)::BIGINT AS cls FROM pixels"""))
def argmax(spark, sf_dir):
    return class_pixels(spark, sf_dir).select("vec_id", "pix", M.argmax(F.col("t")).alias("cls"))


@query("M9_two_date_median", with_(V, body="""
SELECT vec_id, i, trunc((q[i + 1] + q[i + 33]) / 2.0::DOUBLE)::BIGINT AS v FROM vectors, range(32) t(i)"""))
def median(spark, sf_dir):
    return exploded(B.vectors(spark, sf_dir), "vec_id", M.median_of_two(F.slice("q", 1, 32), F.slice("q", 33, 32)))


def raster_affine():
    return [F.lit(10.0), F.lit(0.0), F.col("raster_id") * 1000.0, F.lit(0.0), F.lit(-10.0), F.col("raster_id") * 500.0 + 7.0]


@query("M10_affine_round_trip", with_(B.cells_sql(), body="""
SELECT raster_id, y, x, (10.0 * x + raster_id * 1000.0)::DOUBLE AS mx, (-10.0 * y + raster_id * 500.0 + 7.0)::DOUBLE AS my, x AS px, y AS py FROM cells"""))
def affine(spark, sf_dir):
    mx, my = M.pixel_to_map(*raster_affine(), F.col("x"), F.col("y"))
    c = B.cells(spark, sf_dir).select("raster_id", "y", "x", mx.alias("mx"), my.alias("my"))
    px, py = M.map_to_pixel(*raster_affine(), F.col("mx"), F.col("my"))
    return c.withColumns({"px": M.nearest_pixel(px), "py": M.nearest_pixel(py)})


@query("M11_affine_from_bounds", with_(B.BOXES_SQL, body="""
SELECT id, round((x1 - x0) / 32.0::DOUBLE, 6) AS a, x0 AS c, round((y0 - y1) / 32.0::DOUBLE, 6) AS e, y1 AS f FROM boxes"""))
def from_bounds(spark, sf_dir):
    t = M.affine_from_bounds(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit(32), F.lit(32))
    return B.boxes(spark, sf_dir).select("id", *[t[k].alias(k) for k in "acef"])


@query("M12_G9_tile_affine", with_(B.cells_sql(), body="""
SELECT DISTINCT raster_id, y // 32 AS ty, x // 32 AS tx, (10.0 * (x // 32 * 32) + raster_id * 1000.0)::DOUBLE AS c,
  (-10.0 * (y // 32 * 32) + raster_id * 500.0 + 7.0)::DOUBLE AS f FROM cells"""))
def tile_affine(spark, sf_dir):
    from furrow.operators.labelling import tile_keys

    tiles = B.cells(spark, sf_dir).select("raster_id", "y", "x").withColumns(tile_keys(32)).select("raster_id", "ty", "tx").distinct()
    t = M.shift_affine(*raster_affine(), F.col("tx") * 32, F.col("ty") * 32)
    return tiles.select("raster_id", "ty", "tx", t["c"].alias("c"), t["f"].alias("f"))


@query("M17_W13_minmax_byte", with_(V, body="""
SELECT vec_id, i, CASE WHEN hi > lo THEN trunc((q - lo) / (hi - lo)::DOUBLE * 255)::BIGINT ELSE 0 END AS v
FROM (SELECT *, min(q) OVER w AS lo, max(q) OVER w AS hi FROM qcells WINDOW w AS (PARTITION BY vec_id, i // 8))"""))
def minmax(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("vec_id", "y")
    c = B.vector_cells(spark, sf_dir)
    return c.select("vec_id", "i", M.minmax_byte(F.col("q"), F.min("q").over(w), F.max("q").over(w)).alias("v"))


@query("M18_patch_defaults", """
SELECT o_orderkey, size::BIGINT AS size, ceil(size / 16.0)::BIGINT AS padding, (size - 2 * ceil(size / 16.0))::BIGINT AS stride
FROM (SELECT o_orderkey, CASE WHEN least(h, w) >= 1024 THEN 1024 WHEN least(h, w) >= 512 THEN 512 WHEN least(h, w) >= 256 THEN 256 ELSE 128 END AS size
      FROM (SELECT o_orderkey, 128 + o_orderkey % 1500 AS h, 128 + o_custkey % 1500 AS w FROM orders))""")
def patch_defaults(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", M.patch_size(128 + F.col("o_orderkey") % 1500, 128 + F.col("o_custkey") % 1500).alias("size"))
    o = o.withColumn("padding", M.patch_padding(F.col("size")))
    return o.withColumn("stride", M.patch_stride(F.col("size"), F.col("padding")))


@query("M19_random_divisor", with_(V, body=f"SELECT vec_id, round(1500 + 3000 * {unit('vec_id')}, 6) AS divisor FROM vectors"))
def divisor(spark, sf_dir):
    return B.vectors(spark, sf_dir).select("vec_id", sampling.random_divisor(F.col("vec_id")).alias("divisor"))


@query("M20_brightness", with_(V, body=f"""
SELECT vec_id, i, round(CASE WHEN {unit('vec_id')} < 0.5 THEN least(greatest(q / 3000.0::DOUBLE * (0.5 + {unit('vec_id', 43)}), 0), 1)
  ELSE q / 3000.0::DOUBLE END, 6) + 0.0::DOUBLE AS v FROM qcells"""))
def brightness(spark, sf_dir):
    return exploded(B.vectors(spark, sf_dir), "vec_id", sampling.brightness(M.normalise(F.col("q")), F.col("vec_id")))


@query("M21_window_shuffle", with_(V, body=f"""
SELECT vec_id, i, (CASE WHEN {unit('vec_id')} < 0.5 THEN q[i + 1] ELSE q[(i + 32) % 64 + 1] END)::BIGINT AS v FROM vectors, range(64) t(i)"""))
def shuffle(spark, sf_dir):
    return exploded(B.vectors(spark, sf_dir), "vec_id", M.shuffle_windows(F.col("q"), sampling.coin(F.col("vec_id"), seed=42), 32))


@query("P12_label_masks", with_(B.cells_sql(), body="""
SELECT raster_id, sum(CASE WHEN cls = 1 THEN 1 ELSE 0 END)::BIGINT AS fields, sum(CASE WHEN cls = 2 THEN 1 ELSE 0 END)::BIGINT AS boundaries
FROM cells GROUP BY 1"""))
def label_masks(spark, sf_dir):
    f, b = scoring.masks_of_interest(F.col("cls"))
    return B.cells(spark, sf_dir).select("raster_id", f.alias("f"), b.alias("b")).groupBy("raster_id").agg(
        F.sum("f").alias("fields"), F.sum("b").alias("boundaries"))


@query("P12_score_masks", with_(V, SOFTMAX_SQL, body="""
SELECT vec_id, pix, CASE WHEN floor(p[2] * 255) >= 0.35 * 255 THEN 1 ELSE 0 END::BIGINT AS field,
  CASE WHEN floor(p[3] * 255) >= 0.35 * 255 THEN 1 ELSE 0 END::BIGINT AS boundary FROM sm"""))
def score_masks(spark, sf_dir):
    f, b = scoring.masks_from_scores(F.col("b"), 0.35)
    s = class_pixels(spark, sf_dir).select("vec_id", "pix", scoring.scores_to_bytes(F.col("s")).alias("b"))
    return s.select("vec_id", "pix", f.alias("field"), b.alias("boundary"))


LC_SQL = """
lc AS (SELECT raster_id, y // 2 AS y, x // 2 AS x, CASE WHEN (sum(s) % 3) <> 0 THEN 5 ELSE 2 END AS lc FROM cells GROUP BY 1, 2, 3)"""


def landcover(c):
    lc = F.when(F.sum("s") % 3 != 0, 5).otherwise(2)
    return c.groupBy("raster_id", B.div(F.col("y"), 2).alias("y"), B.div(F.col("x"), 2).alias("x")).agg(lc.alias("lc"))


@query("J5_P13_K10_cropland_mask", with_(B.cells_sql(), LC_SQL, body="""
SELECT c.raster_id, c.y, c.x, CASE WHEN lc = 5 THEN cls ELSE 0 END::BIGINT AS cls, CASE WHEN lc = 5 THEN 1 ELSE 0 END::BIGINT AS cropland_mask
FROM cells c JOIN lc ON lc.raster_id = c.raster_id AND lc.y = c.y // 2 AND lc.x = c.x // 2"""))
def cropland(spark, sf_dir):
    c = B.cells(spark, sf_dir)
    half = F.lit(0.5)
    out = flows.filter_by_landcover(c, landcover(c), ["raster_id"], F.lit(5), half, half)
    return out.select("raster_id", "y", "x", "cls", "cropland_mask")


# Grids that lie otherwise: shifted by part of a cell, turned by a right angle, turned by a slant. Land cover has cells of 20 m.
GRIDS = {"shifted": (20.0, 0.0, 103.3, 0.0, -20.0, 897.1), "turned": (0.0, 20.0, 102.9, -20.0, 0.0, 893.7), "slanted": (16.0, 12.0, -81.7, 12.0, -16.0, 611.3)}


def _aligned_sql() -> str:
    parts = []
    for name, (a, b, c, d, e, f) in GRIDS.items():
        det = f"({a} * {e} - {b} * {d})::DOUBLE"
        px, py = "(10.0::DOUBLE * (x + 0.5::DOUBLE) + 100.0::DOUBLE)", "(-10.0::DOUBLE * (y + 0.5::DOUBLE) + 900.0::DOUBLE)"
        parts.append(f"""SELECT raster_id, '{name}' AS grid, y, x, cls, floor(({e}::DOUBLE * ({px} - {c}::DOUBLE) - {b}::DOUBLE * ({py} - {f}::DOUBLE)) / {det})::BIGINT AS lx,
  floor(({a}::DOUBLE * ({py} - {f}::DOUBLE) - {d}::DOUBLE * ({px} - {c}::DOUBLE)) / {det})::BIGINT AS ly FROM cells""")
    return with_(B.cells_sql(), LC_SQL, "placed AS (" + " UNION ALL ".join(parts) + ")", body="""
SELECT p.raster_id, grid, p.y, p.x, coalesce(lc, -1)::BIGINT AS lc, CASE WHEN lc = 5 THEN cls ELSE 0 END::BIGINT AS cls
FROM placed p LEFT JOIN lc ON lc.raster_id = p.raster_id AND lc.y = ly AND lc.x = lx""")


@query("J5_landcover_by_affine", _aligned_sql())
def landcover_by_affine(spark, sf_dir):
    """Nearest land cover over offset, turned and slanted grids, tile against tile."""
    c = B.cells(spark, sf_dir)
    tiles = cut(rasters.pack_tiles(c.withColumn("cls", F.col("cls").cast("int")), ["raster_id"], "cls", 32))
    source = cut(rasters.pack_tiles(landcover(c), ["raster_id"], "lc", 8))
    target = [F.lit(v) for v in (10.0, 0.0, 100.0, 0.0, -10.0, 900.0)]
    out = []
    for name, affine in GRIDS.items():
        grid = [F.lit(v) for v in affine]
        kept = flows.filter_tiles_by_landcover(tiles, source, ["raster_id"], 5, target, grid, side=8, keep="lc")
        lc = F.coalesce("lc", F.transform("values", lambda v: F.lit(None).cast("int")))
        both = F.zip_with("values", lc, lambda v, n: F.when(v.isNotNull(), F.struct(F.coalesce(n, F.lit(-1)).alias("lc"), v.alias("cls"))))
        flat = rasters.unpack_tiles(kept.select("raster_id", "tile_y", "tile_x", "y0", "x0", "h", "w", both.alias("values")), 32, "v")
        out.append(flat.select("raster_id", F.lit(name).alias("grid"), "y", "x", "v.lc", "v.cls"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("P14_two_classes", with_(B.cells_sql(), body="""
SELECT raster_id, sum(CASE WHEN pred = 1 THEN 1 ELSE 0 END * (y + x))::BIGINT AS s FROM cells GROUP BY 1"""))
def two_classes(spark, sf_dir):
    return B.cells(spark, sf_dir).groupBy("raster_id").agg(F.sum(scoring.to_two_classes(F.col("pred")) * (F.col("y") + F.col("x"))).alias("s"))


@query("P15_edge_agreement", with_(B.cells_sql(), body="""
SELECT raster_id, y, x, CASE WHEN edge > 0 THEN cls ELSE 3 END::BIGINT AS cls FROM cells"""))
def edge_agreement(spark, sf_dir):
    return B.cells(spark, sf_dir).select("raster_id", "y", "x", scoring.edge_agreement(F.col("cls"), F.col("edge")).alias("cls"))


def _option_sql():
    half = lambda lo, hi, shift, opt: f"SELECT vec_id, '{opt}' AS opt, (i - {lo} + {shift}) AS i, q AS v FROM qcells WHERE i >= {lo} AND i < {hi}"
    parts = [
        half(32, 64, 32, "stacked"), half(0, 32, 0, "stacked"), half(32, 64, 0, "windowA"), half(0, 32, 0, "windowB"),
        half(0, 3, 0, "rgb"), half(32, 35, 3, "rgb"), half(32, 35, 0, "window_a_rgb"), half(0, 3, 0, "window_b_rgb"),
        "SELECT a.vec_id, 'median' AS opt, a.i, trunc((a.q + b.q) / 2.0::DOUBLE)::BIGINT AS v FROM qcells a JOIN qcells b ON b.vec_id = a.vec_id AND b.i = a.i + 32",
        f"SELECT vec_id, 'random_window' AS opt, i % 32 AS i, q AS v FROM qcells WHERE (i >= 32) = ({unit('vec_id')} < 0.5)",
        half(32, 64, 0, "swapped"), half(0, 32, 32, "swapped"),
    ]
    return " UNION ALL ".join(parts)


@query("P16_R2_temporal_options", with_(V, body=_option_sql()))
def temporal_options(spark, sf_dir):
    """Every temporal option and the swapped stack; windows are value halves (B first)."""
    from furrow.constants import TEMPORAL_OPTIONS

    v = B.vectors(spark, sf_dir)
    b, a = F.slice("q", 1, 32), F.slice("q", 33, 32)
    pick = sampling.coin(F.col("vec_id"), seed=42)
    picks = [F.struct(F.lit(o).alias("opt"), M.select_windows(a, b, o, pick_a=pick).alias("v")) for o in TEMPORAL_OPTIONS]
    picks.append(F.struct(F.lit("swapped").alias("opt"), M.select_windows(a, b, "stacked", swap=True).alias("v")))
    e = v.select("vec_id", F.explode(F.array(*picks)).alias("e"))
    return e.select("vec_id", "e.opt", F.posexplode("e.v").alias("i", "v"))


@query("T13_window_pair", with_(V, body="SELECT vec_id, i // 32 AS t, i % 32 AS i, q AS v FROM qcells"))
def window_pair(spark, sf_dir):
    p = B.vectors(spark, sf_dir).select("vec_id", F.posexplode(M.window_pair(F.col("q"), 32)).alias("t", "w"))
    return p.select("vec_id", "t", F.posexplode("w").alias("i", "v"))


@query("R3_flips", with_(B.cells_sql(), body=f"""
SELECT raster_id, CASE WHEN {unit('raster_id', 1)} < 0.5 THEN 63 - x ELSE x END AS x,
  CASE WHEN {unit('raster_id', 2)} < 0.5 THEN 63 - y ELSE y END AS y, cls::BIGINT AS cls FROM cells"""))
def flips(spark, sf_dir):
    c, k = B.cells(spark, sf_dir).select("raster_id", "y", "x", "cls"), F.col("raster_id")
    return sampling.flip_cells(c, sampling.coin(k, seed=1), sampling.coin(k, seed=2), F.lit(64), F.lit(64))


@query("R5_resize_nearest", with_(V, body="""
SELECT v.vec_id, i, v.q[(i // 12 * 8 // 12) * 8 + (i % 12) * 8 // 12 + 1]::BIGINT AS v FROM vectors v, range(144) t(i)"""))
def resize_nearest(spark, sf_dir):
    return exploded(B.vectors(spark, sf_dir), "vec_id", patches.resize_nearest(F.col("q"), 8, 8, 12, 12))


@query("R5_resize_bilinear", with_(V, """
w AS (SELECT i, greatest((i + 0.5::DOUBLE) * 0.5 - 0.5, 0) AS s FROM range(16) t(i)),
g AS (SELECT i, floor(s)::BIGINT AS lo, least(floor(s)::BIGINT + 1, 7) AS hi, s - floor(s) AS f FROM w)""", body="""
SELECT v.vec_id, gy.i * 16 + gx.i AS i, round((v.v[gy.lo * 8 + gx.lo + 1] * (1 - gx.f) + v.v[gy.lo * 8 + gx.hi + 1] * gx.f) * (1 - gy.f)
  + (v.v[gy.hi * 8 + gx.lo + 1] * (1 - gx.f) + v.v[gy.hi * 8 + gx.hi + 1] * gx.f) * gy.f, 5) + 0.0::DOUBLE AS v FROM vectors v, g gy, g gx"""), digits=5)
def resize_bilinear(spark, sf_dir):
    return exploded(B.vectors(spark, sf_dir), "vec_id", patches.resize_bilinear(F.col("v"), 8, 8, 16, 16))


@query("S5_band_scan", with_(V, body="SELECT vec_id, i // 8 AS band, i % 8 AS x, q AS v FROM qcells WHERE i // 8 IN (0, 1, 2)"))
def band_scan(spark, sf_dir):
    """Three bands of a tile table partitioned by band, written and scanned back."""
    path = scratch_path(spark, "bands")
    c = B.vector_cells(spark, sf_dir).select("vec_id", F.col("y").alias("band"), F.lit(0).alias("y"), "x", "q")
    writers.write_tiles(rasters.pack_tiles(c, ["vec_id", "band"], "q", 8), path)
    tiles = rasters.scan_bands(spark.read.parquet(path), [0, 1, 2])
    return rasters.unpack_tiles(tiles, 8).select("vec_id", "band", "x", "v")


@query("K3_sparse_tiles", with_(B.cells_sql(), body="""
SELECT raster_id, y, x, cls::BIGINT AS v FROM cells WHERE (y * 7 + x * 3 + raster_id) % 5 < 2 AND y >= 3 AND x >= 2"""))
def sparse_tiles(spark, sf_dir):
    """Offset tiles with holes come back where they were."""
    path = scratch_path(spark, "sparse")
    c = B.cells(spark, sf_dir).filter("(y * 7 + x * 3 + raster_id) % 5 < 2 AND y >= 3 AND x >= 2").withColumn("band", F.lit(0))
    writers.write_tiles(rasters.pack_tiles(c, ["raster_id", "band"], "cls", 8), path)
    return rasters.unpack_tiles(spark.read.parquet(path), 8).select("raster_id", "y", "x", "v")


@query("S6_window_scan", with_(B.cells_sql(), body="""
SELECT raster_id, y, x, cls::BIGINT AS cls FROM cells
WHERE 10.0 * (x + 0.5) BETWEEN raster_id % 7 * 25.0 AND raster_id % 7 * 25.0 + 300.0
  AND -10.0 * (y + 0.5) BETWEEN -500.0 AND raster_id % 5 * -20.0"""))
def window_scan(spark, sf_dir):
    """Every raster clipped to its own map box."""
    c = B.cells(spark, sf_dir).select("raster_id", "y", "x", "cls")
    k = F.col("raster_id")
    boxes = c.select("raster_id").distinct().withColumns({
        "bx0": k % 7 * 25.0, "bx1": k % 7 * 25.0 + 300.0, "by0": F.lit(-500.0), "by1": k % 5 * -20.0})
    unit_affine = {"a": F.lit(10.0), "b": F.lit(0.0), "c": F.lit(0.0), "d": F.lit(0.0), "e": F.lit(-10.0), "f": F.lit(0.0)}
    return rasters.clip_cells(c, boxes, ["raster_id"], unit_affine, 16).select("raster_id", "y", "x", "cls")


@query("K3_tile_sink", with_(B.cells_sql(), body="SELECT raster_id, y, x, pred::BIGINT AS v FROM cells"))
def tile_sink(spark, sf_dir):
    path = scratch_path(spark, "labels")
    c = B.cells(spark, sf_dir).withColumn("band", F.lit(1))
    writers.write_tiles(rasters.pack_tiles(c, ["raster_id", "band"], "pred", 32), path)
    return rasters.unpack_tiles(spark.read.parquet(path), 32).select("raster_id", "y", "x", "v")


@query("K9_append_missing", "SELECT vec_id, count(*) AS n FROM embeddings GROUP BY vec_id")
def append_missing(spark, sf_dir):
    """Edge tiles of labelled chips are there already; only the others are appended."""
    path = scratch_path(spark, "edges")
    v = B.vectors(spark, sf_dir).select("vec_id", "label", "q")
    v.filter(F.col("label") % 2 == 0).write.parquet(path)
    writers.append_missing(v, spark.read.parquet(path), "vec_id", path)
    return spark.read.parquet(path).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"))


@query("K8_overwrite_guard", "SELECT vec_id, label::BIGINT AS label FROM embeddings")
def overwrite_guard(spark, sf_dir):
    """A second write without overwrite leaves the first one as it is."""
    path = scratch_path(spark, "guard")
    v = B.vectors(spark, sf_dir).select("vec_id", "label")
    for shift in (0, 1000):
        v.withColumn("label", F.col("label") + shift).write.mode(writers.save_mode(False)).parquet(path)
    return spark.read.parquet(path)


def _morph_cte(name: str, src: str, op: str) -> str:
    """Minimum or maximum over a cell and its four neighbours, as five equi-joined shifts."""
    agg = "least" if op == "min" else "greatest"
    joins = "".join(
        f" LEFT JOIN {src} n{i} ON n{i}.raster_id = c.raster_id AND n{i}.y = c.y + ({dy}) AND n{i}.x = c.x + ({dx})"
        for i, (dy, dx) in enumerate(((0, 1), (0, -1), (1, 0), (-1, 0))))
    vals = ", ".join(["c.v"] + [f"coalesce(n{i}.v, c.v)" for i in range(4)])
    return f"{name} AS (SELECT c.raster_id, c.y, c.x, {agg}({vals}) AS v FROM {src} c{joins})"


MASK_SQL = "m0 AS (SELECT raster_id, y, x, CASE WHEN cls = 1 THEN 1 ELSE 0 END AS v FROM cells)"


def field_flags(spark, sf_dir):
    return B.cells(spark, sf_dir).select("raster_id", "y", "x", (F.col("cls") == 1).cast("int").alias("v"))


@query("W9_morphology_windows", with_(B.cells_sql(), MASK_SQL, _morph_cte("m1", "m0", "min"), _morph_cte("m2", "m0", "max"), body="""
SELECT a.raster_id, a.y, a.x, a.v::BIGINT AS eroded, b.v::BIGINT AS dilated FROM m1 a JOIN m2 b USING (raster_id, y, x)"""))
def morphology_windows(spark, sf_dir):
    c = field_flags(spark, sf_dir).withColumn("dilated", F.col("v")).withColumnRenamed("v", "eroded")
    c = stencil.morph_step(c, ["raster_id"], "eroded", grow=False)
    return stencil.morph_step(c, ["raster_id"], "dilated", grow=True)


@query("W9_U4_U8_opening_tiles", with_(B.cells_sql(), MASK_SQL, _morph_cte("m1", "m0", "min"), _morph_cte("m2", "m1", "max"), body="""
SELECT raster_id, y, x, v::BIGINT AS v FROM m2"""))
def opening(spark, sf_dir):
    """Opening of the field cells in tile form with a halo."""
    return stencil.open_close(field_flags(spark, sf_dir), ["raster_id"], "v", opening=1, stride=24)


@query("W9_U4_U8_closing_tiles", with_(B.cells_sql(), MASK_SQL, _morph_cte("m1", "m0", "max"), _morph_cte("m2", "m1", "max"),
       _morph_cte("m3", "m2", "min"), _morph_cte("m4", "m3", "min"), body="SELECT raster_id, y, x, v::BIGINT AS v FROM m4"))
def closing(spark, sf_dir):
    """Closing by two steps: one shuffle for all four stencils."""
    return stencil.open_close(field_flags(spark, sf_dir), ["raster_id"], "v", closing=2, stride=24)


def _thin_cte(name: str, src: str, second: bool) -> str:
    offs = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
    joins = "".join(
        f" LEFT JOIN {src} n{i} ON n{i}.raster_id = c.raster_id AND n{i}.y = c.y + ({dy}) AND n{i}.x = c.x + ({dx})"
        for i, (dy, dx) in enumerate(offs))
    cols = ", ".join(f"coalesce(n{i}.v, 0) AS p{i}" for i in range(8))
    rises = " + ".join(f"(CASE WHEN p{i} = 0 AND p{(i + 1) % 8} = 1 THEN 1 ELSE 0 END)" for i in range(8))
    free = "p0 * p2 * p6 = 0 AND p0 * p4 * p6 = 0" if second else "p0 * p2 * p4 = 0 AND p2 * p4 * p6 = 0"
    count = " + ".join(f"p{i}" for i in range(8))
    return f"""{name} AS (SELECT raster_id, y, x, CASE WHEN v = 1 AND {count} BETWEEN 2 AND 6 AND ({rises}) = 1 AND {free} THEN 0 ELSE v END AS v
      FROM (SELECT c.raster_id, c.y, c.x, c.v, {cols} FROM {src} c{joins}))"""


@query("W10_thinning_step", with_(B.cells_sql(), "m0 AS (SELECT raster_id, y, x, CASE WHEN cls = 2 OR cls = 1 THEN 1 ELSE 0 END AS v FROM cells)",
       _thin_cte("m1", "m0", False), _thin_cte("m2", "m1", True), body="SELECT raster_id, y, x, v::BIGINT AS v FROM m2"))
def thinning_step(spark, sf_dir):
    """One full thinning iteration in window form."""
    c = B.cells(spark, sf_dir).select("raster_id", "y", "x", F.col("cls").isin(1, 2).cast("int").alias("v"))
    for second in (False, True):
        c = stencil.thin_step_window(c, ["raster_id"], "v", second)
    return c


@query("W10_thinning_two_iterations", with_(B.cells_sql(), "m0 AS (SELECT raster_id, y, x, CASE WHEN cls = 2 OR cls = 1 THEN 1 ELSE 0 END AS v FROM cells)",
       _thin_cte("m1", "m0", False), _thin_cte("m2", "m1", True), _thin_cte("m3", "m2", False), _thin_cte("m4", "m3", True), body="""
SELECT raster_id, y, x FROM m4 WHERE v = 1"""))
def thinning_tiles(spark, sf_dir):
    """Two iterations in tile form."""
    c = B.cells(spark, sf_dir).filter(F.col("cls").isin(1, 2))
    return stencil.thin(c, ["raster_id"], stride=24, max_iters=2)


@query("W11_boundary_fill")
def boundary_fill(spark, sf_dir):
    """Boundaries thinned to a skeleton at the fixed point, the rest given to fields."""
    c = B.cells(spark, sf_dir).select("raster_id", "y", "x", "cls")
    return stencil.fill_thinned_boundaries(c, ["raster_id"], F.lit(64), F.lit(64), stride=32).select("raster_id", "y", "x", "field")


@query("G7_patch_grid", """
WITH r AS (SELECT o_orderkey AS raster_id, 300 + o_orderkey % 97 AS height, 260 + o_custkey % 53 AS width FROM orders),
n AS (SELECT *, ceil((height - 128) / 112.0::DOUBLE)::BIGINT AS nr, ceil((width - 128) / 112.0::DOUBLE)::BIGINT AS nc FROM r)
SELECT raster_id, i * (nc + 1) + j AS patch_order, i * 112 AS top, j * 112 AS "left"
FROM n, range(5) a(i), range(5) b(j) WHERE i <= nr AND j <= nc""")
def patch_grid(spark, sf_dir):
    return _grid(spark, sf_dir).select("raster_id", "patch_order", "top", "left")


def _grid(spark, sf_dir):
    r = B.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("raster_id"), (300 + F.col("o_orderkey") % 97).alias("height"), (260 + F.col("o_custkey") % 53).alias("width"))
    return patches.patch_grid(r, F.lit(128), F.lit(8))


@query("G8_halo_trim", """
WITH r AS (SELECT o_orderkey AS raster_id, 300 + o_orderkey % 97 AS height, 260 + o_custkey % 53 AS width FROM orders),
n AS (SELECT *, ceil((height - 128) / 112.0::DOUBLE)::BIGINT AS nr, ceil((width - 128) / 112.0::DOUBLE)::BIGINT AS nc FROM r),
p AS (SELECT raster_id, height, width, i * (nc + 1) + j AS patch_order, i * 112 AS top, j * 112 AS lft FROM n, range(5) a(i), range(5) b(j) WHERE i <= nr AND j <= nc),
d AS (SELECT raster_id, patch_order, top, lft, CASE WHEN lft <= 0 THEN 0 ELSE lft + 8 END AS dst_left, CASE WHEN top <= 0 THEN 0 ELSE top + 8 END AS dst_top,
  CASE WHEN lft + 128 >= width THEN width ELSE lft + 120 END AS dst_right, CASE WHEN top + 128 >= height THEN height ELSE top + 120 END AS dst_bottom FROM p)
SELECT raster_id, patch_order, dst_left, dst_top, dst_right, dst_bottom, dst_left - lft AS src_left, dst_top - top AS src_top FROM d
WHERE dst_right > dst_left AND dst_bottom > dst_top""")
def halo_trim(spark, sf_dir):
    return patches.trimmed(_grid(spark, sf_dir)).select(
        "raster_id", "patch_order", "dst_left", "dst_top", "dst_right", "dst_bottom", "src_left", "src_top")


# Overlapping patches of side 4, step 2 over an 8 x 8 chip; a patch's class depends on its place.
PLACED_SQL = """
p AS (SELECT i * 3 + j AS patch_order, i * 2 AS top, j * 2 AS lft FROM range(3) a(i), range(3) b(j)),
placed AS (SELECT c.vec_id, c.y, c.x, p.patch_order, (abs(c.q) + CASE WHEN c.q % 4 = 0 THEN p.patch_order ELSE 0 END) % 3 AS pred
  FROM qcells c JOIN p ON c.y >= top AND c.y < top + 4 AND c.x >= lft AND c.x < lft + 4)"""


def placed(spark, sf_dir):
    c = B.vector_cells(spark, sf_dir)
    chips = c.select("vec_id").distinct().withColumns({"height": F.lit(8), "width": F.lit(8)})
    grid = patches.patch_grid(chips, F.lit(4), F.lit(1))
    shift = F.when(F.col("q") % 4 == 0, F.col("patch_order")).otherwise(0)
    return patches.patch_cells(grid, c, ["vec_id"], 4).withColumn("pred", (F.abs("q") + shift) % 3)


@query("J13_patch_cells", with_(V, PLACED_SQL, body="SELECT vec_id, patch_order, y, x, pred FROM placed"))
def patch_cells(spark, sf_dir):
    return placed(spark, sf_dir).select("vec_id", "patch_order", "y", "x", "pred")


@query("W6_stitch_last_wins", with_(V, PLACED_SQL, body="SELECT vec_id, y, x, max_by(pred, patch_order) AS pred FROM placed GROUP BY 1, 2, 3"))
def stitch(spark, sf_dir):
    return patches.stitch(placed(spark, sf_dir), ["vec_id"], "pred")


@query("W7_first_placed", with_(V, PLACED_SQL, body="SELECT vec_id, y, x, min_by(pred, patch_order) AS pred FROM placed GROUP BY 1, 2, 3"))
def first_placed(spark, sf_dir):
    return patches.first_placed(placed(spark, sf_dir), ["vec_id"], "pred")


AGREE_SQL = """
f AS (SELECT *, first_value(pred) OVER (PARTITION BY vec_id, y, x ORDER BY patch_order) AS fp,
      row_number() OVER (PARTITION BY vec_id, y, x ORDER BY patch_order) AS rn FROM placed)"""


@query("A10_overlap_consistency", with_(V, PLACED_SQL, AGREE_SQL, body="""
SELECT vec_id, count_if(rn > 1 AND pred = fp)::BIGINT AS agreements, count_if(rn > 1)::BIGINT AS total,
  round(count_if(rn > 1 AND pred = fp) / count_if(rn > 1)::DOUBLE, 6) AS fraction FROM f GROUP BY 1"""))
def consistency(spark, sf_dir):
    return evaluation.consistency_report(evaluation.overlap_consistency(placed(spark, sf_dir), ["vec_id"]), ["vec_id"])


@query("K4_disagreement_raster", with_(V, PLACED_SQL, AGREE_SQL, body="""
SELECT vec_id, y, x, max(CASE WHEN pred <> fp THEN 1 ELSE 0 END)::BIGINT AS v FROM f GROUP BY 1, 2, 3"""))
def disagreement(spark, sf_dir):
    path = scratch_path(spark, "disagreements")
    d = evaluation.overlap_consistency(placed(spark, sf_dir), ["vec_id"]).withColumn("band", F.lit(1))
    writers.write_tiles(rasters.pack_tiles(d, ["vec_id", "band"], "disagreement", 8), path)
    return rasters.unpack_tiles(spark.read.parquet(path), 8).select("vec_id", "y", "x", "v")


CROPS_SQL = """
crops AS (SELECT vec_id, corner, y, x, y - 2 * (corner // 2) AS cy, x - 2 * (corner % 2) AS cx,
  (abs(q) + CASE WHEN q % 5 = 0 THEN corner ELSE 0 END) % 3 AS pred FROM qcells, range(4) k(corner)
  WHERE y - 2 * (corner // 2) BETWEEN 0 AND 5 AND x - 2 * (corner % 2) BETWEEN 0 AND 5)"""


def crops(spark, sf_dir):
    c = patches.corner_crops(B.vector_cells(spark, sf_dir), 8, 4)
    shift = F.when(F.col("q") % 5 == 0, F.col("corner")).otherwise(0)
    return c.withColumn("pred", (F.abs("q") + shift) % 3)


@query("G10_corner_crops", with_(V, CROPS_SQL, body="SELECT vec_id, corner, cy, cx, pred FROM crops"))
def corner_crops(spark, sf_dir):
    return crops(spark, sf_dir).select("vec_id", "corner", "cy", "cx", "pred")


CONSENSUS_SQL = """
score AS (SELECT vec_id, avg(agree) AS consensus_score FROM (SELECT vec_id, y, x, CASE WHEN min(pred) = max(pred) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS agree
  FROM crops WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 GROUP BY 1, 2, 3) GROUP BY 1)"""


def consensus_scores(spark, sf_dir):
    return patches.corner_consensus(patches.overlap_region(crops(spark, sf_dir), 8, 4), "vec_id", "pred")


@query("A9_corner_consensus", with_(V, CROPS_SQL, CONSENSUS_SQL, body="SELECT vec_id, round(consensus_score, 6) AS consensus_score FROM score"))
def consensus(spark, sf_dir):
    return consensus_scores(spark, sf_dir)


@query("A12_A14_consensus_stats", with_(V, CROPS_SQL, CONSENSUS_SQL, body="""
SELECT label::VARCHAR AS country, count(consensus_score) AS "count", round(avg(consensus_score), 4) AS mean, round(stddev_samp(consensus_score), 4) AS std
FROM score JOIN vectors USING (vec_id) GROUP BY label"""))
def consensus_stats(spark, sf_dir):
    s = consensus_scores(spark, sf_dir).join(B.vectors(spark, sf_dir).select("vec_id", F.col("label").cast("string").alias("country")), "vec_id")
    return evaluation.consensus_stats(s)


@query("A12_consensus_overall", with_(V, CROPS_SQL, CONSENSUS_SQL, body="""
SELECT round(avg(consensus_score), 4) AS mean, round(stddev_samp(consensus_score), 4) AS std, round(min(consensus_score), 4) AS min,
  round(max(consensus_score), 4) AS max, round(median(consensus_score), 4) AS median FROM score"""))
def consensus_overall(spark, sf_dir):
    return evaluation.consensus_overall(consensus_scores(spark, sf_dir))


@query("K6_consensus_sink", with_(V, CROPS_SQL, CONSENSUS_SQL, body="SELECT vec_id, round(consensus_score, 6) AS consensus_score FROM score"))
def consensus_sink(spark, sf_dir):
    path = scratch_path(spark, "consensus")
    writers.write_csv(consensus_scores(spark, sf_dir), path)
    return spark.read.schema("vec_id bigint, consensus_score double").option("header", True).csv(path)


@query("A13_mean_pooling", with_(V, body="SELECT vec_id, i // 8 AS channel, round(avg(v), 6) + 0.0::DOUBLE AS v FROM qcells GROUP BY 1, 2"))
def mean_pooling(spark, sf_dir):
    return B.vectors(spark, sf_dir).select("vec_id", F.posexplode(M.mean_pool(F.col("v"), 8)).alias("channel", "v"))


def _flag_tiles(spark, sf_dir, side):
    return cut(rasters.pack_tiles(field_flags(spark, sf_dir), ["raster_id"], "v", side))


@query("W9_U4_halo_closing", with_(B.cells_sql(), MASK_SQL, _morph_cte("m1", "m0", "max"), _morph_cte("m2", "m1", "max"),
       _morph_cte("m3", "m2", "min"), _morph_cte("m4", "m3", "min"), body="SELECT raster_id, y, x, v::BIGINT AS v FROM m4"))
def halo_closing(spark, sf_dir):
    """Closing by two steps on stored tiles; only edge strips travel."""
    out = halo.open_close_tiles(_flag_tiles(spark, sf_dir, 24), ["raster_id"], closing=2)
    return rasters.unpack_tiles(out, 24, "v")


@query("G1_W14_stored_tile_runs", with_(B.cells_sql(), MASK_SQL, body="""
SELECT raster_id, y, min(x) AS x0, max(x) AS x1 FROM (
  SELECT raster_id, y, x, x - row_number() OVER (PARTITION BY raster_id, y, x // 16 ORDER BY x) AS g FROM m0 WHERE v = 1)
GROUP BY raster_id, y, x // 16, g"""))
def stored_tile_runs(spark, sf_dir):
    """Runs of the fields of stored tiles."""
    return halo.tile_runs(_flag_tiles(spark, sf_dir, 16), ["raster_id"]).select("raster_id", "y", "x0", "x1")
