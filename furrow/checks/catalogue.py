"""Scene catalogue, areas of interest, crop calendar and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.checks import bindings as B
from furrow.checks.registry import query, with_
from furrow.functions import footprints, projection, raster_math, rings, text
from furrow.functions.projection import ECC, E2, K0
from furrow.constants import SCENE_PREFIX, SCENE_STORE, WGS84_A
from furrow.operators import scenes as S
from furrow.session import scratch_path
from furrow.sinks import writers
from furrow.sources import rasters

TODAY = "1999-06-30"


def ea_x(lon: str) -> str:
    return f"(radians({lon}) * {WGS84_A * K0!r}::DOUBLE)"


def ea_y(lat: str) -> str:
    s = f"sin(radians({lat}))"
    e = f"({ECC!r}::DOUBLE * {s})"
    return (f"({WGS84_A / (2 * K0)!r}::DOUBLE * {1 - E2!r}::DOUBLE * ({s} / (1 - {e} * {e}) "
            f"- {1 / (2 * ECC)!r}::DOUBLE * ln((1 - {e}) / (1 + {e}))))")


NODATA_SQL = f"""
measured AS (
  SELECT *, greatest(0, least(100, (1 - greatest(least({ea_x('x1')}, {ea_x('sx1')}) - greatest({ea_x('x0')}, {ea_x('sx0')}), 0)
                   * greatest(least({ea_y('y1')}, {ea_y('sy1')}) - greatest({ea_y('y0')}, {ea_y('sy0')}), 0)
                   / (({ea_x('x1')} - {ea_x('x0')}) * ({ea_y('y1')} - {ea_y('y0')}))) * 100)) AS nodata
  FROM candidates)"""

ITEMS_SQL = """
items AS (
  SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, o_orderstatus, o_totalprice,
         CASE WHEN o_orderpriority <> '5-LOW' THEN 'T' || (o_custkey % 20) END AS grid_code,
         CASE WHEN o_orderstatus <> 'P' THEN 'M' || (o_custkey % 20) END AS mgrs,
         CASE WHEN o_orderpriority = '1-URGENT' THEN '0' || (2 + o_orderkey % 3) || '.00' END AS pv,
         CASE o_orderstatus WHEN 'F' THEN '03.01' WHEN 'O' THEN 'n/a' END AS pb
  FROM orders)"""


def items(spark, sf_dir):
    """Orders as nested catalogue items."""
    o = B.table(spark, sf_dir, "orders")
    x, y = (F.col("o_custkey") % 30).cast("double"), (F.col("o_custkey") % 20).cast("double")
    x1, y1 = x + 1.2, y + 1.2
    corner = [F.array(a, b) for a, b in ((x, y), (x1, y), (x1, y1), (x, y1), (x, y))]
    key = (F.col("o_custkey") % 20).cast("string")
    properties = F.struct(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"),
        ((F.round(F.col("o_totalprice") * 100).cast("bigint") % 10000) / 100.0).alias("eo:cloud_cover"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("T"), key)).alias("grid:code"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("M"), key)).alias("s2:mgrs_tile"),
        F.when(F.col("o_orderpriority") == "1-URGENT",
               F.concat(F.lit("0"), (2 + F.col("o_orderkey") % 3).cast("string"), F.lit(".00"))).alias("processing:version"),
        F.when(F.col("o_orderstatus") == "F", "03.01").when(F.col("o_orderstatus") == "O", "n/a").alias("s2:processing_baseline"),
    )
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*corner)).alias("coordinates")).alias("geometry"),
        F.array(x, y, x1, y1).alias("bbox"), properties.alias("properties"),
    )


@query("S7_P21_catalogue_scan", with_(ITEMS_SQL, body="""
SELECT o_orderkey::VARCHAR AS scene_id, strftime(o_orderdate, '%Y-%m-%d') AS date,
       coalesce(grid_code, mgrs, 'Unknown') AS tile,
       round((round(o_totalprice * 100)::BIGINT % 10000) / 100.0, 6)::DOUBLE AS cloud,
       coalesce(try_cast(pv AS DOUBLE), try_cast(pb AS DOUBLE), 0.0)::DOUBLE AS version,
       (o_custkey % 30)::DOUBLE AS x0, ((o_custkey % 20) + 1.2)::DOUBLE AS y1, 5::BIGINT AS n_points
FROM items"""))
def catalogue_scan(spark, sf_dir):
    """Catalogue dump written as item collections, read back with the fixed schema."""
    path = scratch_path(spark, "catalogue")
    page = F.struct(F.lit("FeatureCollection").alias("type"), F.array(F.struct("id", "geometry", "bbox", "properties")).alias("features"))
    items(spark, sf_dir).select(F.to_json(page).alias("value")).write.text(path)
    return rasters.normalise_items(rasters.read_catalogue(spark, path)).select(
        "scene_id", "date", "tile", "cloud", "version", "x0", "y1", F.size("footprint").alias("n_points")
    )


@query("P4_cloud_filter", with_(B.SCENES_SQL, body="SELECT scene_id, cloud FROM scenes WHERE cloud < 20"))
def cloud_filter(spark, sf_dir):
    return B.scenes(spark, sf_dir).filter(F.col("cloud") < 20).select("scene_id", "cloud")


@query("P5_T1_T2_date_window", with_(B.SCENES_SQL, B.AREAS_SQL, body="""
SELECT aoi_id, win, center::DATE::VARCHAR AS center, strftime((center - 14)::DATE, '%Y-%m-%d 00:00:00') AS from_ts,
       strftime((center + 14)::DATE, '%Y-%m-%d 23:59:59') AS to_ts FROM windows"""))
def date_window(spark, sf_dir):
    return S.season_windows(B.areas(spark, sf_dir)).select("aoi_id", "win", "center", "from_ts", "to_ts")


@query("T1_day_of_year_date", """
SELECT o_orderkey, strftime(make_date(year(o_orderdate)::INT, 1, 1) + (dayofyear(o_orderdate)::INT - 1), '%Y-%m-%d') AS day
FROM orders""")
def day_date(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", text.day_of_year_date(F.year("o_orderdate"), F.dayofyear("o_orderdate")).alias("day"))


@query("T2_season_rollover", """
SELECT c_custkey AS aoi_id, CASE WHEN 1 + (c_custkey * 53) % 365 < 1 + (c_custkey * 37) % 365 THEN 1 ELSE 0 END
       + 1995 + c_custkey % 6 AS end_year FROM customer""")
def rollover(spark, sf_dir):
    return B.areas(spark, sf_dir).select(
        "aoi_id", text.season_end_year(F.col("year"), F.col("sday"), F.col("eday")).alias("end_year"))


@query("T3_rfc3339_range", """
SELECT o_orderkey, strftime((o_orderdate - INTERVAL 14 DAY), '%Y-%m-%dT00:00:00Z') || '/' ||
       strftime((o_orderdate + INTERVAL 14 DAY), '%Y-%m-%dT23:59:59Z') AS rng FROM orders""")
def rfc_range(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").select("o_orderkey", text.rfc3339_range(F.to_date("o_orderdate"), 14).alias("rng"))


@query("T4_time_tag", """
WITH t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y:%m:%d %H:%M:%S')
  WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000+00:00') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS tag,
  o_orderstatus, o_orderdate FROM orders)
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS iso FROM t""")
def time_tag(spark, sf_dir):
    d = F.col("o_orderdate")
    tag = (
        F.when(F.col("o_orderstatus") == "F", F.date_format(d, "yyyy:MM:dd HH:mm:ss"))
        .when(F.col("o_orderstatus") == "O", F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.'000+00:00'"))
        .otherwise(F.date_format(d, "dd/MM/yyyy"))
    )
    return B.table(spark, sf_dir, "orders").select("o_orderkey", text.normalise_time_tag(tag).alias("iso"))


@query("T5_latest_acquisition", """
SELECT o_custkey, strftime(max(coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END,
       CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 1 DAY END, o_orderdate - INTERVAL 1 DAY)), '%Y:%m:%d %H:%M:%S') AS latest
FROM orders GROUP BY o_custkey""")
def latest(spark, sf_dir):
    d, st = F.col("o_orderdate").cast("timestamp"), F.col("o_orderstatus")
    newest = S.latest_time(
        F.when(st == "F", d), F.when(st == "O", d + F.expr("INTERVAL 1 DAY")), d - F.expr("INTERVAL 1 DAY"))
    return B.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.date_format(newest, "yyyy:MM:dd HH:mm:ss").alias("latest"))


@query("T6_scene_url", f"""
WITH t AS (SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y') AS y, month(o_orderdate)::VARCHAR AS m,
  'S2B_33UUP_' || strftime(o_orderdate, '%Y%m%d') || '_' || o_orderkey || '_L2A' AS id FROM orders)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'https://host/items/' || id
  ELSE '{SCENE_STORE}/{SCENE_PREFIX}/33/U/UP/' || y || '/' || m || '/' || id || '/' || id || '.json' END AS url FROM t""")
def scene_url(spark, sf_dir):
    ident = F.concat(F.lit("S2B_33UUP_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.col("o_orderkey").cast("string"), F.lit("_L2A"))
    uri = F.concat(F.lit(f"s3://sentinel-cogs/{SCENE_PREFIX}/33/U/UP/"), F.year("o_orderdate").cast("string"), F.lit("/"),
                   F.month("o_orderdate").cast("string"), F.lit("/"), ident)
    given = F.when(F.col("o_orderstatus") == "F", ident).when(F.col("o_orderstatus") == "O", uri).otherwise(
        F.concat(F.lit("https://host/items/"), ident))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", text.scene_url(given).alias("url"))


@query("T7_bbox_parse", """
SELECT c_custkey, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN (c_custkey % 30)::DOUBLE END AS xmin,
       CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN (c_custkey % 20)::DOUBLE + 0.5 END AS ymax
FROM customer""")
def bbox_parse(spark, sf_dir):
    c, seg = F.col("c_custkey"), F.col("c_mktsegment")
    last = F.when(seg == "BUILDING", F.lit("north")).otherwise(((c % 20) + 0.5).cast("string"))
    raw = F.when(seg == "MACHINERY", F.concat_ws(",", (c % 30).cast("string"), (c % 20).cast("string"), last)).otherwise(
        F.concat_ws(",", (c % 30).cast("string"), (c % 20).cast("string"), (c % 30 + 1).cast("string"), last))
    box = text.parse_bbox(raw)
    return B.table(spark, sf_dir, "customer").select("c_custkey", box["xmin"].alias("xmin"), box["ymax"].alias("ymax"))


@query("P6_future_guard", with_(B.SCENES_SQL, B.AREAS_SQL, body=f"""
SELECT aoi_id, win, CASE WHEN center + 14 > DATE '{TODAY}' THEN 1 ELSE 0 END AS future FROM windows"""))
def future_guard(spark, sf_dir):
    w = S.season_windows(B.areas(spark, sf_dir))
    best = S.best_scenes(w, B.scenes(spark, sf_dir), nodata_max=None, today=F.lit(TODAY).cast("date"))
    return best.select("aoi_id", "win", (F.col("status") == "future").cast("int").alias("future"))


@query("J4_area_scene_join", with_(B.SCENES_SQL, B.AREAS_SQL, body="SELECT aoi_id, win, scene_id, cloud FROM candidates"), digits=None)
def area_scene_join(spark, sf_dir):
    """A row for each pair; clouds are whole hundredths already, so nothing is rounded pair by pair."""
    w = S.season_windows(B.areas(spark, sf_dir))
    return S.candidate_scenes(w, B.scenes(spark, sf_dir)).select("aoi_id", "win", "scene_id", "cloud")


@query("A11_nodata_percent", with_(B.SCENES_SQL, B.AREAS_SQL, NODATA_SQL, body="""
SELECT aoi_id, win, scene_id, round(nodata, 4) + 0.0::DOUBLE AS nodata FROM measured"""), digits=None)
def nodata(spark, sf_dir):
    """A row for each pair; shares are rounded before copies are joined on, so nothing is rounded pair by pair."""
    w = S.season_windows(B.areas(spark, sf_dir))
    return S.candidate_scenes(w, B.scenes(spark, sf_dir), measure=True, digits=4).select("aoi_id", "win", "scene_id", "nodata")


BEST_SQL = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY aoi_id, win ORDER BY cloud, scene_id) AS rn FROM measured WHERE nodata <= 50),
found AS (SELECT aoi_id, win, count(*) AS n_found, count_if(nodata <= 50) AS n_kept FROM measured GROUP BY 1, 2)"""


@query("P7_P9_W1_best_scene", with_(B.SCENES_SQL, B.AREAS_SQL, NODATA_SQL, BEST_SQL, body="""
SELECT w.aoi_id, w.win, coalesce(f.n_found, 0)::BIGINT AS n_found, coalesce(f.n_kept, 0)::BIGINT AS n_kept,
       CASE WHEN f.n_found IS NULL THEN 'no_scene' WHEN f.n_kept = 0 THEN 'nodata' ELSE 'ok' END AS status,
       coalesce(r.scene_id, -1) AS scene_id, coalesce(r.cloud, -1.0::DOUBLE) AS cloud
FROM windows w LEFT JOIN found f USING (aoi_id, win)
LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r USING (aoi_id, win)"""))
def best_scene(spark, sf_dir):
    w = S.season_windows(B.areas(spark, sf_dir))
    best = S.best_scenes(w, B.scenes(spark, sf_dir))
    return best.select("aoi_id", "win", "n_found", "n_kept", "status", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("scene_id", "cloud")])


@query("W2_scene_selection", with_(B.SCENES_SQL, B.AREAS_SQL, NODATA_SQL, BEST_SQL, body="""
SELECT a.aoi_id, coalesce(x.scene_id, -1) AS window_a, coalesce(y.scene_id, -1) AS window_b,
  CASE WHEN fa.n_found IS NULL THEN 'no_scene' WHEN fa.n_kept = 0 THEN 'nodata' ELSE 'ok' END AS status_a,
  CASE WHEN fb.n_found IS NULL THEN 'no_scene' WHEN fb.n_kept = 0 THEN 'nodata' ELSE 'ok' END AS status_b
FROM areas a
LEFT JOIN found fa ON fa.aoi_id = a.aoi_id AND fa.win = 'a' LEFT JOIN found fb ON fb.aoi_id = a.aoi_id AND fb.win = 'b'
LEFT JOIN ranked x ON x.aoi_id = a.aoi_id AND x.win = 'a' AND x.rn = 1
LEFT JOIN ranked y ON y.aoi_id = a.aoi_id AND y.win = 'b' AND y.rn = 1"""))
def scene_selection(spark, sf_dir):
    """The whole selection: two seasons per area, best scene each."""
    picked = S.scene_selection(B.areas(spark, sf_dir), B.scenes(spark, sf_dir))
    return picked.withColumns({w: F.coalesce(w, F.lit(-1)) for w in ("window_a", "window_b")})


@query("P8_multi_tile_guard", with_(B.SCENES_SQL, B.AREAS_SQL, f"""
wide AS (SELECT aoi_id, win, x0, y0, x0 + 3.0::DOUBLE AS x1, y0 + 3.0::DOUBLE AS y1, center FROM windows),
met AS (SELECT w.aoi_id, w.win, count(*) AS n, count(DISTINCT s.tile) AS tiles FROM wide w JOIN scenes s
  ON s.x0 <= w.x1 AND s.x1 >= w.x0 AND s.y0 <= w.y1 AND s.y1 >= w.y0 AND s.cloud < 20
 AND s.dt >= (w.center - 14)::TIMESTAMP AND s.dt < (w.center + 15)::TIMESTAMP GROUP BY 1, 2)""", body=f"""
SELECT w.aoi_id, w.win, CASE WHEN m.n IS NULL THEN 'no_scene' WHEN m.n > 1 AND m.tiles > 1
  AND ({ea_x('w.x1')} - {ea_x('w.x0')}) * ({ea_y('w.y1')} - {ea_y('w.y0')}) > 1e10 THEN 'multi_tile' ELSE 'ok' END AS status
FROM wide w LEFT JOIN met m USING (aoi_id, win)"""))
def multi_tile(spark, sf_dir):
    a = B.areas(spark, sf_dir).withColumns({"x1": F.col("x0") + 3.0, "y1": F.col("y0") + 3.0})
    w = S.season_windows(a)
    return S.best_scenes(w, B.scenes(spark, sf_dir), nodata_max=None).select("aoi_id", "win", "status")


@query("A17_distinct_tiles", with_(B.SCENES_SQL, B.AREAS_SQL, body="""
SELECT aoi_id, count(DISTINCT nullif(tile, 'T0')) AS tiles FROM candidates GROUP BY aoi_id"""))
def distinct_tiles(spark, sf_dir):
    """Distinct known tiles per area; tile T0 plays the unknown one."""
    w = S.season_windows(B.areas(spark, sf_dir))
    cand = S.candidate_scenes(w, B.scenes(spark, sf_dir))
    return cand.groupBy("aoi_id").agg(F.countDistinct(F.nullif("tile", F.lit("T0"))).alias("tiles"))


@query("J6_two_scene_intersect", with_(B.SCENES_SQL, body="""
SELECT a.scene_id, CASE WHEN a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 THEN 1 ELSE 0 END AS meets
FROM scenes a JOIN scenes b ON b.scene_id = a.scene_id + 1"""))
def two_scene_intersect(spark, sf_dir):
    a = B.scenes(spark, sf_dir).select("scene_id", "footprint")
    b = a.select((F.col("scene_id") - 1).alias("scene_id"), F.col("footprint").alias("other"))
    return a.join(b, "scene_id").select(
        "scene_id", S.footprints_meet(footprints.single(F.col("footprint")), footprints.single(F.col("other"))).cast("int").alias("meets"))


# Footprints in the plane: two slanted trapezoids, the first with a slanted hole; every eleventh crosses itself.
TRAPEZOIDS_SQL = """
trapezoids AS (
  SELECT o_orderkey AS scene_id, (o_custkey % 30)::DOUBLE AS a, (o_custkey % 20)::DOUBLE AS c, (8 + o_orderkey % 5)::DOUBLE AS w,
         (6 + o_orderkey % 4)::DOUBLE AS h, (1 + o_orderkey % 3)::DOUBLE AS rise, (o_custkey % 30 + o_orderkey % 17 - 8)::DOUBLE AS x0,
         (o_custkey % 20 + o_orderkey % 13 - 6)::DOUBLE AS y0, (3 + o_orderkey % 16)::DOUBLE AS bw, (2 + o_orderkey % 9)::DOUBLE AS bh, o_orderkey % 11 = 0 AS bad
  FROM orders),
pieces AS (
  SELECT scene_id, 1 AS sign, a AS xa, a + w AS xb, c AS low, c + h AS t, rise / w AS m, x0, y0, x0 + bw AS x1, y0 + bh AS y1 FROM trapezoids
  UNION ALL SELECT scene_id, -1, a + w / 4, a + w / 2, c + 1, c + h / 2, 4 * rise / 2 / w, x0, y0, x0 + bw, y0 + bh FROM trapezoids
  UNION ALL SELECT scene_id, 1, a + w + 2, a + 2 * w + 2, c - 1, c + h, rise / w, x0, y0, x0 + bw, y0 + bh FROM trapezoids),
spans AS (
  SELECT *, greatest(low, y0) AS lo, greatest(greatest(low, y0), y1) AS hi, t + m * (least(greatest(xa, x0), xb) - xa) AS ta, t + m * (greatest(least(xb, x1), xa) - xa) AS tb FROM pieces),
sums AS (SELECT scene_id, sum(CASE WHEN greatest(xa, x0) < least(xb, x1) THEN sign * ({gb} - {ga}) / m ELSE 0 END) AS covered FROM spans GROUP BY 1)""".format(
    **{f"g{e}": f"(CASE WHEN t{e} <= lo THEN 0 WHEN t{e} < hi THEN (t{e} - lo) * (t{e} - lo) / 2 ELSE (hi - lo) * (hi - lo) / 2 + (hi - lo) * (t{e} - hi) END)" for e in "ab"})


def _trapezoids(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = B.table(spark, sf_dir, "orders").select(
        k.alias("scene_id"), *[v.cast("double").alias(n) for n, v in {
            "a": c % 30, "c": c % 20, "w": 8 + k % 5, "h": 6 + k % 4, "rise": 1 + k % 3, "x0": c % 30 + k % 17 - 8, "y0": c % 20 + k % 13 - 6,
            "bw": 3 + k % 16, "bh": 2 + k % 9}.items()], (k % 11 == 0).alias("bad"))
    a, low, w, h, rise = (F.col(n) for n in ("a", "c", "w", "h", "rise"))

    def ring(*points):
        made = [rings.point(x, y) for x, y in points]
        return F.array(*made, made[0])

    def part(outer, *holes):
        inner = F.array(*holes) if holes else F.slice(F.array(outer), 1, 0)
        return F.struct(outer.alias("exterior"), inner.alias("interiors"))

    hole = ring((a + w / 4, low + 1), (a + w / 2, low + 1), (a + w / 2, low + h / 2 + rise / 2), (a + w / 4, low + h / 2))
    first = part(ring((a, low), (a + w, low), (a + w, low + h + rise), (a, low + h)), hole)
    bow = part(ring((a, low), (a + w, low), (a, low + h), (a + w, low + h)))
    x = a + w + 2
    second = part(ring((x, low - 1), (x + w, low - 1), (x + w, low + h + rise), (x, low + h)))
    return o.select("scene_id", F.when(F.col("bad"), F.array(bow)).otherwise(F.array(first, second)).alias("parts"), "x0", "y0",
                    (F.col("x0") + F.col("bw")).alias("x1"), (F.col("y0") + F.col("bh")).alias("y1"))


@query("A11_S7_parts_clipped", with_(TRAPEZOIDS_SQL, body="""
SELECT scene_id, NOT bad AS valid, CASE WHEN bad THEN 0 ELSE round(covered, 6) + 0.0 END::DOUBLE AS covered, CASE WHEN bad THEN 0 ELSE round(covered, 6) + 0.0 END::DOUBLE AS clipped
FROM trapezoids JOIN sums USING (scene_id)"""))
def parts_clipped(spark, sf_dir):
    """Area of footprints of two parts with a hole inside a box: measured in place, and on the clipped rings."""
    t = _trapezoids(spark, sf_dir).withColumn("valid", footprints.parts_valid(F.col("parts")))
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    cut = footprints.clip_parts_to_box(F.col("parts"), *box)
    measured = {"covered": footprints.covered_area(F.col("parts"), *box), "clipped": footprints.parts_area(cut)}
    return t.select("scene_id", "valid", *[F.when(F.col("valid"), F.round(v, 6) + 0.0).otherwise(0.0).alias(n) for n, v in measured.items()])


LEANING_SQL = """
leaning AS (
  SELECT o_orderkey AS scene_id, (o_custkey % 30)::DOUBLE AS cx, (o_custkey % 20)::DOUBLE AS cy, 1.0::DOUBLE + o_orderkey % 6 AS s,
         (o_orderkey % 5 - 2) / 4.0::DOUBLE AS p, (o_orderkey % 3) / 4.0::DOUBLE AS q FROM orders),
sides AS (SELECT scene_id, cx, cy, s AS ux, s * p AS uy, s * q AS vx, s AS vy FROM leaning)"""


def _axis(n: str, a: str) -> str:
    """The projections of both parallelograms on the normal of a side of ``a`` overlap."""
    x, y = f"(-{a}.{n}y)", f"{a}.{n}x"
    reach = " + ".join(f"abs({x} * {t}.{d}x + {y} * {t}.{d}y)" for t in "ab" for d in "uv")
    return f"abs({x} * (b.cx - a.cx) + {y} * (b.cy - a.cy)) <= {reach}"


@query("J6_slanted_intersect", with_(LEANING_SQL, body=f"""
SELECT a.scene_id, ({" AND ".join(_axis(n, t) for t in "ab" for n in "uv")})::INT AS meets
FROM sides a JOIN sides b ON b.scene_id = a.scene_id + 1"""))
def slanted_intersect(spark, sf_dir):
    """Slanted footprints that share a point."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s, p, q = 1.0 + k % 6, (k % 5 - 2) / 4.0, (k % 3) / 4.0
    corners = [rings.point(c % 30 + s * i + s * q * j, c % 20 + s * p * i + s * j) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]
    a = B.table(spark, sf_dir, "orders").select(k.alias("scene_id"), footprints.single(F.array(*corners)).alias("parts"))
    b = a.select((F.col("scene_id") - 1).alias("scene_id"), F.col("parts").alias("other"))
    return a.join(b, "scene_id").select("scene_id", S.footprints_meet(F.col("parts"), F.col("other")).cast("int").alias("meets"))


@query("S9_W3_landcover_first_item", """
WITH i AS (SELECT o_custkey AS raster_id, o_orderkey AS item_id, o_orderdate AS dt,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn
  FROM orders WHERE o_orderstatus <> 'P')
SELECT raster_id, item_id, 5::BIGINT AS cropland FROM i WHERE rn = 1""")
def landcover_first(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("raster_id"), F.col("o_orderkey").alias("item_id"),
        F.col("o_orderdate").cast("timestamp").alias("dt"),
        F.when(F.col("o_orderstatus") == "P", "esa-worldcover").otherwise("io-lulc-annual-v02").alias("provider"))
    return rasters.scan_landcover(o).select("raster_id", "item_id", "cropland")


@query("M4_processing_version", with_(ITEMS_SQL, """
v AS (SELECT o_orderkey, coalesce(try_cast(pv AS DOUBLE), try_cast(pb AS DOUBLE), 0.0)::DOUBLE AS version FROM items),
p AS (SELECT a.o_orderkey, a.version AS v1, b.version AS v2, CASE WHEN b.version > 0 THEN b.version ELSE a.version END AS used
      FROM v a JOIN v b ON b.o_orderkey = a.o_orderkey + 1)""", body="""
SELECT o_orderkey, v1, v2, CASE WHEN v1 > 0 AND v2 > 0 AND v1 <> v2 THEN 'differs'
  WHEN used < 3 OR used >= 4 THEN 'untested' ELSE 'ok' END AS status FROM p"""))
def version_status(spark, sf_dir):
    v = items(spark, sf_dir).select(
        F.col("id").cast("bigint").alias("o_orderkey"),
        raster_math.processing_version(F.col("properties.`processing:version`"), F.col("properties.`s2:processing_baseline`")).alias("v1"))
    nxt = v.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("v1").alias("v2"))
    return v.join(nxt, "o_orderkey").withColumn("status", raster_math.version_status(F.col("v1"), F.col("v2")))


@query("M13_equal_area_projection", with_(B.SCENES_SQL, B.AREAS_SQL, body=f"""
SELECT aoi_id, round({ea_x('x0')}, 3) + 0.0::DOUBLE AS ex, round({ea_y('y0')}, 3) + 0.0::DOUBLE AS ey FROM areas"""), digits=3)
def equal_area(spark, sf_dir):
    x, y = projection.equal_area(F.col("x0"), F.col("y0"))
    return B.areas(spark, sf_dir).select("aoi_id", x.alias("ex"), y.alias("ey"))


@query("M14_reprojection_round_trip", with_(B.SCENES_SQL, B.AREAS_SQL, body="""
SELECT aoi_id, round(x0, 6) AS lon, round(y0, 6) AS lat, round(x0, 6) AS ulon, round(y0, 6) AS ulat FROM areas"""))
def reprojection(spark, sf_dir):
    """Degrees -> grid metres -> degrees, for the equal-area grid and for UTM."""
    a = B.areas(spark, sf_dir).withColumn("zone", (F.floor((F.col("x0") + 180) / 6) + 1).cast("int"))
    ex, ey = projection.equal_area(F.col("x0"), F.col("y0"))
    ux, uy = projection.utm(F.col("x0"), F.col("y0"), F.col("zone"), F.col("y0") >= 0)
    m = a.select("aoi_id", "zone", (F.col("y0") >= 0).alias("north"), ex.alias("ex"), ey.alias("ey"), ux.alias("ux"), uy.alias("uy"))
    lon, lat = projection.equal_area_inverse(F.col("ex"), F.col("ey"))
    ulon, ulat = projection.utm_inverse(F.col("ux"), F.col("uy"), F.col("zone"), F.col("north"))
    return m.select("aoi_id", lon.alias("lon"), lat.alias("lat"), ulon.alias("ulon"), ulat.alias("ulat"))


CIRCULAR = """CASE WHEN count(doy) = 1 THEN max(doy) ELSE round_even(round(
  (CASE WHEN atan2(sum(sin(t)), sum(cos(t))) < 0 THEN atan2(sum(sin(t)), sum(cos(t))) + 2 * pi()
        ELSE atan2(sum(sin(t)), sum(cos(t))) END) * 364.0::DOUBLE / (2 * pi()) + 1, 9), 0) END"""


@query("A8_circular_mean", f"""
WITH d AS (SELECT o_custkey, dayofyear(o_orderdate) AS doy, (dayofyear(o_orderdate) - 1.0::DOUBLE) * (2 * pi() / 364.0::DOUBLE) AS t FROM orders)
SELECT o_custkey, ({CIRCULAR})::BIGINT AS day FROM d GROUP BY o_custkey""")
def circular_mean(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select("o_custkey", F.dayofyear("o_orderdate").alias("doy"))
    return o.groupBy("o_custkey").agg(S.circular_mean_day(F.col("doy")).alias("day"))


CALENDAR_SQL = """
calendar AS (
  SELECT (o_custkey % 30) + 0.25::DOUBLE * (o_orderkey % 4) AS lon, (o_custkey % 20) + 0.25::DOUBLE * (o_orderkey // 4 % 4) AS lat,
         CASE WHEN o_orderkey % 2 = 0 THEN 'start' ELSE 'end' END AS kind, min(dayofyear(o_orderdate)) AS doy
  FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2, 3),
inside AS (SELECT aoi_id, kind, lat, doy, (doy - 1.0::DOUBLE) * (2 * pi() / 364.0::DOUBLE) AS t,
           max(lat) OVER (PARTITION BY aoi_id, kind) AS top
           FROM areas JOIN calendar ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1)"""


@query("S8_A8_calendar_days", with_(B.SCENES_SQL, B.AREAS_SQL, CALENDAR_SQL, body=f"""
SELECT aoi_id, kind, ({CIRCULAR})::BIGINT AS day FROM inside WHERE lat = top GROUP BY 1, 2"""))
def calendar_days(spark, sf_dir):
    """Crop-calendar days per area from the first grid row in its box; order status plays the season."""
    k = F.col("o_orderkey")
    grid = B.table(spark, sf_dir, "orders").groupBy(
        ((F.col("o_custkey") % 30) + F.lit(0.25) * (k % 4)).alias("lon"),
        ((F.col("o_custkey") % 20) + F.lit(0.25) * (B.div(k, 4) % 4)).alias("lat"),
        F.when(k % 2 == 0, "start").otherwise("end").alias("kind"),
        F.when(F.col("o_orderstatus") == "P", "winter").otherwise("summer").alias("season"),
    ).agg(F.min(F.dayofyear("o_orderdate")).alias("doy"))
    return S.calendar_days(rasters.scan_calendar(grid, "summer"), B.areas(spark, sf_dir))


@query("K7_selection_sink", with_(B.SCENES_SQL, B.AREAS_SQL, NODATA_SQL, BEST_SQL, body="""
SELECT a.aoi_id, coalesce(x.scene_id, -1) AS window_a, coalesce(y.scene_id, -1) AS window_b FROM areas a
LEFT JOIN ranked x ON x.aoi_id = a.aoi_id AND x.win = 'a' AND x.rn = 1
LEFT JOIN ranked y ON y.aoi_id = a.aoi_id AND y.win = 'b' AND y.rn = 1"""))
def selection_sink(spark, sf_dir):
    path = scratch_path(spark, "selection")
    writers.write_selection(scene_selection(spark, sf_dir), path)
    return spark.read.schema("aoi_id bigint, window_a bigint, window_b bigint").json(path)


@query("M16_ring_bbox", with_(B.SCENES_SQL, body="SELECT scene_id, x0 AS xmin, y0 AS ymin, x1 AS xmax, y1 AS ymax FROM scenes"))
def ring_bbox(spark, sf_dir):
    return B.scenes(spark, sf_dir).select("scene_id", rings.ring_bbox(F.col("footprint")).alias("b")).select("scene_id", "b.*")
