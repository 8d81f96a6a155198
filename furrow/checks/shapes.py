"""Polygons of any slant: runs, pair measures, common sides and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.checks import bindings as B
from furrow.checks.fields import EULER, PARTS_SQL, QUADS_SQL, summary
from furrow.checks.registry import query, with_
from furrow.functions import rings
from furrow.operators import scanline, unions
from furrow.session import cut

CELLS = B.shape_cells_sql(1.0)


@query("J7_polygon_runs", with_(B.SHAPES_SQL, CELLS, body="""
SELECT id, r AS y, count(*) AS cells, min(c) AS first, max(c) AS last FROM shape_cells GROUP BY 1, 2"""))
def polygon_runs(spark, sf_dir):
    """Cells of each grid row inside a slanted polygon."""
    runs = scanline.polygon_runs(B.shapes(spark, sf_dir), 1.0)
    return runs.groupBy("id", "y").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("cells"), F.min("x0").alias("first"), F.max("x1").alias("last"))


MEASURES_SQL = """
areas AS (SELECT id, count(*) AS n FROM shape_cells GROUP BY 1),
both_in AS (SELECT a.id AS a_id, b.id AS b_id, count(*) AS n FROM shape_cells a JOIN shape_cells b ON a.r = b.r AND a.c = b.c AND a.id < b.id GROUP BY 1, 2),
measures AS (SELECT a_id, b_id, t.n * 1.0::DOUBLE AS inter, t.n / (a.n + b.n - t.n) AS iou, t.n / least(a.n, b.n) AS containment
  FROM both_in t JOIN areas a ON a.id = a_id JOIN areas b ON b.id = b_id)"""


@query("J7_J10_E6_polygon_overlap", with_(B.SHAPES_SQL, CELLS, MEASURES_SQL, body="""
SELECT a_id, b_id, inter, round(iou, 6) AS iou, round(containment, 6) AS containment FROM measures"""))
def polygon_overlap(spark, sf_dir):
    return scanline.pair_measures(B.shapes(spark, sf_dir), 1.0)


# Quadrilaterals cut from one strip of slanted bands: each shares its upper side with the next one's lower side.
BANDS_SQL = """
bands AS (SELECT p_partkey AS id, (p_partkey // 8) AS g, p_partkey % 8 AS i, (3 + (p_partkey // 8) % 5)::DOUBLE AS k, ((p_partkey // 8) * 100)::DOUBLE AS x,
  10.0::DOUBLE + (p_partkey % 3) * 4 AS w FROM part)"""


def _bands(spark, sf_dir):
    p = F.col("p_partkey")
    g = B.div(p, 8)
    rows = B.table(spark, sf_dir, "part").select(
        p.alias("id"), (p % 8).alias("i"), (3 + g % 5).cast("double").alias("k"), (g * 100).cast("double").alias("x"), (F.lit(10.0) + (p % 3) * 4).alias("w"))
    x, k, w, y = F.col("x"), F.col("k"), F.col("w"), F.col("i") * 20.0
    # sides rise by k over 20, so all of them lie on parallel lines
    corners = [(x, y), (x + w, y + w * k / 20), (x + w, y + w * k / 20 + 20), (x, y + 20)]
    ring = [rings.point(a, b) for a, b in [*corners, corners[0]]]
    return rows.select("id", F.array(*ring).alias("exterior"), F.slice(F.array(F.array(*ring)), 1, 0).alias("interiors"))


@query("J9_polygon_shared_sides", with_(BANDS_SQL, body="""
SELECT a.id AS a_id, b.id AS b_id, round(least(a.w, b.w) * sqrt(1 + (a.k / 20) * (a.k / 20)), 6) AS shared
FROM bands a JOIN bands b ON b.g = a.g AND b.i = a.i + 1"""))
def polygon_shared_sides(spark, sf_dir):
    """Length of slanted outline that neighbours have in common, of sides of different lengths."""
    b = _bands(spark, sf_dir)
    pairs = scanline.spatial.intersecting_pairs(scanline.polygon_boxes(b))
    return scanline.shared_sides(b, pairs).select("a_id", "b_id", "shared")


UNION_STEP = 2.0
WALK_SQL = """
ok AS (SELECT a_id AS s, b_id AS d FROM measures WHERE iou >= 0.2 OR containment >= 0.8 UNION ALL SELECT b_id, a_id FROM measures WHERE iou >= 0.2 OR containment >= 0.8),
walk AS (SELECT id, id AS root FROM sized UNION SELECT ok.d, w.root FROM walk w JOIN ok ON ok.s = w.id),
grp AS (SELECT id, min(root) AS comp FROM walk GROUP BY 1),
names AS (SELECT comp, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM grp GROUP BY 1)"""


def _union_sql() -> str:
    coarse = B.shape_cells_sql(UNION_STEP).replace("shape_cells AS", "coarse AS")
    cells = "ucells AS (SELECT DISTINCT comp, r AS cy, c AS cx FROM coarse JOIN grp USING (id))"
    sides = f"""shape AS (SELECT a.comp, count(*) * {UNION_STEP * UNION_STEP} AS area, sum((l.comp IS NULL)::INT + (r.comp IS NULL)::INT + (u.comp IS NULL)::INT + (d.comp IS NULL)::INT) * {UNION_STEP}::DOUBLE AS perimeter
  FROM ucells a LEFT JOIN ucells l ON l.comp = a.comp AND l.cy = a.cy AND l.cx = a.cx - 1 LEFT JOIN ucells r ON r.comp = a.comp AND r.cy = a.cy AND r.cx = a.cx + 1
  LEFT JOIN ucells u ON u.comp = a.comp AND u.cx = a.cx AND u.cy = a.cy - 1 LEFT JOIN ucells d ON d.comp = a.comp AND d.cx = a.cx AND d.cy = a.cy + 1 GROUP BY 1)"""
    return with_(B.SHAPES_SQL, CELLS, MEASURES_SQL, WALK_SQL, coarse, cells, sides, QUADS_SQL.format(keys="comp", y="cy", x="cx", cells="ucells"), PARTS_SQL, body=f"""
SELECT comp, ids, p.parts, (p.parts - {EULER})::BIGINT AS holes, (q1 + q3 + 2 * qd)::BIGINT AS corners, area::DOUBLE AS area, perimeter
FROM names JOIN shape USING (comp) JOIN corners USING (comp) JOIN pieces p USING (comp)""", recursive=True)


@query("G6_A16_U2_merged_polygons", _union_sql())
def merged_polygons(spark, sf_dir):
    """Slanted detections of one object merged to rings on the snap grid, parts as rows."""
    merged = unions.merge_duplicate_polygons(cut(B.shapes(spark, sf_dir)), step=1.0, grid=UNION_STEP)
    return summary(merged, ["comp", "ids"])
