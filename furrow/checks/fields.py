"""Labelling, polygons, spatial joins, merging and field sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.checks import bindings as B
from furrow.checks.registry import query, with_
from furrow.functions import rings
from furrow.operators import graph, labelling, merging, outlines, scoring, spatial
from furrow.plans import flows
from furrow.session import cut, scratch_path
from furrow.sinks import writers
from furrow.sources import features

KEY = ["raster_id"]
STRIDE = 32
STEP = labelling.ROW_STEP


def reach_sql(name: str, mask: str, stride: int, cells: str = "cells") -> str:
    """4-connected regions of cells passing ``mask`` inside tiles: cell -> smallest reachable code."""
    same = "" if stride >= 1 << 20 else f" AND b.y // {stride} = a.y // {stride} AND b.x // {stride} = a.x // {stride}"
    return f"""
{name}_f AS (SELECT raster_id, y, x, y * {STEP}::BIGINT + x AS code FROM {cells} WHERE {mask}),
{name}_e AS (
  SELECT a.raster_id, a.code AS s, b.code AS d FROM {name}_f a JOIN {name}_f b ON b.raster_id = a.raster_id AND b.y = a.y AND b.x = a.x + 1{same}
  UNION ALL SELECT a.raster_id, b.code, a.code FROM {name}_f a JOIN {name}_f b ON b.raster_id = a.raster_id AND b.y = a.y AND b.x = a.x + 1{same}
  UNION ALL SELECT a.raster_id, a.code, b.code FROM {name}_f a JOIN {name}_f b ON b.raster_id = a.raster_id AND b.y = a.y + 1 AND b.x = a.x{same}
  UNION ALL SELECT a.raster_id, b.code, a.code FROM {name}_f a JOIN {name}_f b ON b.raster_id = a.raster_id AND b.y = a.y + 1 AND b.x = a.x{same}),
{name}_r AS (
  SELECT raster_id, code, code AS root FROM {name}_f f
  WHERE NOT EXISTS (SELECT 1 FROM {name}_e e WHERE e.raster_id = f.raster_id AND e.s = f.code AND e.d < f.code)
  UNION SELECT e.raster_id, e.d, r.root FROM {name}_r r JOIN {name}_e e ON e.raster_id = r.raster_id AND e.s = r.code),
{name} AS (
  SELECT f.raster_id, f.y, f.x, f.code, min(r.root) AS comp FROM {name}_f f JOIN {name}_r r USING (raster_id, code) GROUP BY 1, 2, 3, 4)"""


STATS_SQL = f"""
sides AS (
  SELECT a.raster_id, a.y // {STRIDE} AS ty, a.x // {STRIDE} AS tx, a.comp,
    CASE WHEN l.code IS NULL THEN 1 ELSE 0 END + CASE WHEN r.code IS NULL THEN 1 ELSE 0 END AS sv,
    CASE WHEN u.code IS NULL THEN 1 ELSE 0 END + CASE WHEN d.code IS NULL THEN 1 ELSE 0 END AS sh
  FROM lab a
  LEFT JOIN lab l ON l.raster_id = a.raster_id AND l.comp = a.comp AND l.y = a.y AND l.x = a.x - 1
  LEFT JOIN lab r ON r.raster_id = a.raster_id AND r.comp = a.comp AND r.y = a.y AND r.x = a.x + 1
  LEFT JOIN lab u ON u.raster_id = a.raster_id AND u.comp = a.comp AND u.y = a.y - 1 AND u.x = a.x
  LEFT JOIN lab d ON d.raster_id = a.raster_id AND d.comp = a.comp AND d.y = a.y + 1 AND d.x = a.x),
stats AS (
  SELECT raster_id, ty, tx, comp, count(*) AS cells, sum(sh)::BIGINT AS sides_h, sum(sv)::BIGINT AS sides_v,
    count(*) * 100.0::DOUBLE AS area, (sum(sh) + sum(sv)) * 10.0::DOUBLE AS perimeter
  FROM sides GROUP BY 1, 2, 3, 4)"""

LAB = (B.cells_sql(), reach_sql("lab", "cls = 1", STRIDE))


def fields(spark, sf_dir, stride=STRIDE):
    return labelling.label_fields(B.cells(spark, sf_dir).filter(F.col("cls") == 1), KEY, stride)


def stats(runs):
    return labelling.cell_metrics(labelling.field_stats(runs, KEY))


@query("W14_field_runs", with_(B.cells_sql(), body=f"""
SELECT raster_id, y, min(x) AS x0, max(x) AS x1 FROM (
  SELECT raster_id, y, x, x - row_number() OVER (PARTITION BY raster_id, y, x // {STRIDE} ORDER BY x) AS g FROM cells WHERE cls = 1)
GROUP BY raster_id, y, x // {STRIDE}, g"""))
def field_runs(spark, sf_dir):
    c = B.cells(spark, sf_dir).filter(F.col("cls") == 1)
    return labelling.field_runs(c, KEY, STRIDE).select("raster_id", "y", "x0", "x1")


@query("G1_G9_label_fields", with_(*LAB, body="SELECT raster_id, y, x, comp FROM lab", recursive=True))
def label_fields(spark, sf_dir):
    return labelling.run_cells(fields(spark, sf_dir)).select("raster_id", "y", "x", "comp")


@query("G1_G2_label_across_tiles", with_(B.cells_sql(), reach_sql("lab", "cls = 1", 1 << 20), body="""
SELECT raster_id, y, x, comp AS label FROM lab""", recursive=True))
def label_across(spark, sf_dir):
    """Regions of whole rasters: tile labels joined over tile edges by graph components."""
    runs = cut(fields(spark, sf_dir))
    return labelling.run_cells(labelling.stitched(runs, KEY, STRIDE)).select("raster_id", "y", "x", "label")


@query("M15_E7_field_metrics", with_(*LAB, STATS_SQL, body="SELECT raster_id, ty, tx, comp, cells, sides_h, sides_v, area, perimeter FROM stats", recursive=True))
def field_metrics(spark, sf_dir):
    return stats(fields(spark, sf_dir)).select("raster_id", "ty", "tx", "comp", "cells", "sides_h", "sides_v", "area", "perimeter")


@query("W4_P10_running_id", with_(*LAB, STATS_SQL, body="""
SELECT raster_id, comp, cells, row_number() OVER (PARTITION BY raster_id ORDER BY ty, tx, comp) AS id FROM stats WHERE area >= 500 AND area <= 20000""", recursive=True))
def running_id(spark, sf_dir):
    return flows.polygonize(B.cells(spark, sf_dir), KEY, STRIDE, 500, 20000).select("raster_id", "comp", "cells", "id")


CONTACT_SQL = f"""
kept AS (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY ty, tx, comp) AS id FROM stats WHERE area >= 500),
kl AS (SELECT l.* FROM lab l JOIN kept k ON k.raster_id = l.raster_id AND k.comp = l.comp),
contacts AS (
  SELECT raster_id, least(a, b) AS a, greatest(a, b) AS b, count(*) * 10.0::DOUBLE AS shared FROM (
    SELECT p.raster_id, p.comp AS a, q.comp AS b FROM kl p JOIN kl q ON q.raster_id = p.raster_id AND q.y = p.y AND q.x = p.x + 1 AND q.comp <> p.comp
    UNION ALL SELECT p.raster_id, p.comp, q.comp FROM kl p JOIN kl q ON q.raster_id = p.raster_id AND q.y = p.y + 1 AND q.x = p.x AND q.comp <> p.comp)
  GROUP BY 1, 2, 3)"""


@query("J8_J9_shared_boundary", with_(*LAB, STATS_SQL, CONTACT_SQL, body="""
SELECT c.raster_id, c.a, c.b, shared, round(shared / least(x.perimeter, y.perimeter), 6) AS ratio
FROM contacts c JOIN kept x ON x.raster_id = c.raster_id AND x.comp = c.a JOIN kept y ON y.raster_id = c.raster_id AND y.comp = c.b""", recursive=True))
def shared_boundary(spark, sf_dir):
    """Shared side length of kept neighbours, relative to the smaller perimeter."""
    runs = fields(spark, sf_dir)
    kept = labelling.size_filter(stats(runs), 500)
    inside = runs.join(kept.select(*KEY, "ty", "tx", "comp"), [*KEY, "ty", "tx", "comp"], "left_semi")
    c = labelling.tile_contacts(inside, KEY, STRIDE).withColumn("shared", (F.col("sides_v") + F.col("sides_h")) * 10.0)
    p = kept.select(*KEY, F.col("comp").alias("a"), F.col("perimeter").alias("pa"))
    q = p.withColumnsRenamed({"a": "b", "pa": "pb"})
    return c.join(p, [*KEY, "a"]).join(q, [*KEY, "b"]).select(
        "raster_id", "a", "b", "shared", (F.col("shared") / F.least("pa", "pb")).alias("ratio"))


def merged_sql(ratio: float) -> str:
    return f"""
acc AS (SELECT c.raster_id, c.a, c.b FROM contacts c JOIN kept x ON x.raster_id = c.raster_id AND x.comp = c.a
  JOIN kept y ON y.raster_id = c.raster_id AND y.comp = c.b WHERE shared / least(x.perimeter, y.perimeter) >= {ratio}),
both_ways AS (SELECT raster_id, a AS s, b AS d FROM acc UNION ALL SELECT raster_id, b, a FROM acc),
walk AS (SELECT raster_id, comp, comp AS root FROM kept UNION
  SELECT e.raster_id, e.d, w.root FROM walk w JOIN both_ways e ON e.raster_id = w.raster_id AND e.s = w.comp),
lbl AS (SELECT raster_id, comp, min(root) AS label FROM walk GROUP BY 1, 2),
inner_len AS (SELECT c.raster_id, p.label, sum(shared) AS s FROM contacts c JOIN lbl p ON p.raster_id = c.raster_id AND p.comp = c.a
  JOIN lbl q ON q.raster_id = c.raster_id AND q.comp = c.b WHERE p.label = q.label GROUP BY 1, 2),
merged AS (SELECT k.raster_id, l.label, string_agg(k.id::VARCHAR, ',' ORDER BY k.id) AS ids, count(*) AS parts, sum(k.cells)::BIGINT AS cells,
  sum(k.area) AS area, sum(k.perimeter) - 2 * coalesce(max(i.s), 0) AS perimeter
  FROM kept k JOIN lbl l USING (raster_id, comp) LEFT JOIN inner_len i ON i.raster_id = k.raster_id AND i.label = l.label GROUP BY 1, 2)"""


def _merge_fields(ratio):
    def run(spark, sf_dir):
        runs = cut(fields(spark, sf_dir))
        kept = labelling.running_id(labelling.size_filter(stats(runs), 500), KEY)
        return merging.merge_adjacent_fields(runs, cut(kept), KEY, STRIDE, ratio)

    return run


for _name, _ratio in (("G5_A15_merge_adjacent_fields", 0.0), ("G5_merge_adjacent_ratio", 0.15)):
    query(_name, with_(*LAB, STATS_SQL, CONTACT_SQL, merged_sql(_ratio), body="""
SELECT raster_id, label, ids, parts, cells, area, perimeter FROM merged""", recursive=True))(_merge_fields(_ratio))


PAIRS_SQL = """
pairs AS (SELECT a.id AS a_id, b.id AS b_id,
    greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS inter,
    CASE WHEN least(a.x1, b.x1) = greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) THEN least(a.y1, b.y1) - greatest(a.y0, b.y0)
         WHEN least(a.y1, b.y1) = greatest(a.y0, b.y0) AND least(a.x1, b.x1) > greatest(a.x0, b.x0) THEN least(a.x1, b.x1) - greatest(a.x0, b.x0)
         ELSE 0 END AS shared
  FROM boxes a JOIN boxes b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)"""


@query("J7_intersecting_pairs", with_(B.BOXES_SQL, PAIRS_SQL, body="SELECT a_id, b_id FROM pairs"))
def intersecting(spark, sf_dir):
    return spatial.intersecting_pairs(B.boxes(spark, sf_dir)).select("a_id", "b_id")


@query("J10_E6_overlap_measures", with_(B.BOXES_SQL, PAIRS_SQL, body="""
SELECT a_id, b_id, inter, round(inter / (200 - inter), 6) AS iou, round(inter / 100, 6) AS containment, shared::DOUBLE AS shared,
  (inter / (200 - inter) >= 0.2 OR inter / 100 >= 0.8) AS merges FROM pairs"""))
def overlap_measures(spark, sf_dir):
    m = spatial.box_pair_measures(spatial.intersecting_pairs(B.boxes(spark, sf_dir)))
    return m.select("a_id", "b_id", "inter", "iou", "containment", "shared",
                    spatial.merges_duplicates(F.col("iou"), F.col("containment")).alias("merges"))


def box_walk(cond: str) -> str:
    return f"""
ok AS (SELECT a_id AS s, b_id AS d FROM pairs WHERE {cond} UNION ALL SELECT b_id, a_id FROM pairs WHERE {cond}),
walk AS (SELECT id, id AS root FROM boxes UNION SELECT ok.d, w.root FROM walk w JOIN ok ON ok.s = w.id),
grp AS (SELECT id, min(root) AS comp FROM walk GROUP BY 1)"""


@query("G2_components", with_(B.BOXES_SQL, PAIRS_SQL, box_walk("true"), body="SELECT id, comp FROM grp", recursive=True))
def components(spark, sf_dir):
    b = B.boxes(spark, sf_dir)
    e = spatial.intersecting_pairs(b).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))
    return graph.with_components(b, e, "id").select("id", "comp")


# Unit cells a box covers; boxes have whole coordinates, so cell counts give exact areas.
UNION_SQL = """
ucells AS (SELECT DISTINCT g.comp, cx, cy FROM snapped b JOIN grp g USING (id), unnest(range((b.x0 / {u})::BIGINT, (b.x1 / {u})::BIGINT)) AS t1(cx),
  unnest(range((b.y0 / {u})::BIGINT, (b.y1 / {u})::BIGINT)) AS t2(cy)),
usides AS (SELECT a.comp, CASE WHEN l.comp IS NULL THEN 1 ELSE 0 END + CASE WHEN r.comp IS NULL THEN 1 ELSE 0 END
    + CASE WHEN u.comp IS NULL THEN 1 ELSE 0 END + CASE WHEN d.comp IS NULL THEN 1 ELSE 0 END AS s
  FROM ucells a LEFT JOIN ucells l ON l.comp = a.comp AND l.cy = a.cy AND l.cx = a.cx - 1
  LEFT JOIN ucells r ON r.comp = a.comp AND r.cy = a.cy AND r.cx = a.cx + 1
  LEFT JOIN ucells u ON u.comp = a.comp AND u.cx = a.cx AND u.cy = a.cy - 1
  LEFT JOIN ucells d ON d.comp = a.comp AND d.cx = a.cx AND d.cy = a.cy + 1),
shape AS (SELECT comp, count(*) * {u} * {u} * 1.0::DOUBLE AS area, sum(s) * {u} * 1.0::DOUBLE AS perimeter FROM usides GROUP BY 1),
names AS (SELECT comp, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids, count(*) AS parts FROM grp GROUP BY 1)"""
UNSNAPPED = "snapped AS (SELECT * FROM boxes)"
SNAPPED = "snapped AS (SELECT id, floor(x0 / 10 + 0.5) * 10 AS x0, floor(y0 / 10 + 0.5) * 10 AS y0, floor(x1 / 10 + 0.5) * 10 AS x1, floor(y1 / 10 + 0.5) * 10 AS y1 FROM boxes)"
UNION_BODY = "SELECT comp, ids, parts, area, perimeter FROM names JOIN shape USING (comp)"


@query("G5_J9_T9_E5_merge_boxes", with_(B.BOXES_SQL, PAIRS_SQL, box_walk("inter > 0 OR shared > 0"), UNSNAPPED, UNION_SQL.format(u=1), body=UNION_BODY, recursive=True))
def merge_boxes(spark, sf_dir):
    """Boxes that overlap or touch along a side, dissolved exactly."""
    return merging.merge_adjacent_boxes(B.boxes(spark, sf_dir), 0.0)


@query("G6_A16_merge_duplicates", with_(B.BOXES_SQL, PAIRS_SQL, box_walk("inter / (200 - inter) >= 0.2 OR inter / 100 >= 0.8"), SNAPPED, UNION_SQL.format(u=10), body=UNION_BODY, recursive=True))
def merge_duplicates(spark, sf_dir):
    return merging.merge_duplicate_boxes(B.boxes(spark, sf_dir))


# Patterns of the four cells around each lattice point: one or three cells make a corner, two across make two.
QUADS_SQL = """
quads AS (SELECT {keys}, vy, vx, sum(bit) AS q FROM (
    SELECT {keys}, {y} + dy AS vy, {x} + dx AS vx, 1 << (2 * dy + dx) AS bit FROM {cells}, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(dy, dx)) GROUP BY ALL),
corners AS (SELECT {keys},
    count(*) FILTER (q IN (1, 2, 4, 8)) AS q1, count(*) FILTER (q IN (7, 11, 13, 14)) AS q3, count(*) FILTER (q IN (6, 9)) AS qd FROM quads GROUP BY ALL)"""
# Parts less holes, from the corner patterns.
EULER = "((q1 - q3 + 2 * qd) // 4)"


def summary(polygons, keys):
    """Parts, holes, corners and measures taken from the coordinates of the rings."""
    own = polygons.withColumns({
        "holes": F.size("interiors"),
        "corners": F.size("exterior") - 1 + F.aggregate("interiors", F.lit(0), lambda acc, r: acc + F.size(r) - 1),
        "area": rings.polygon_area(F.col("exterior"), F.col("interiors")),
        "perimeter": rings.polygon_length(F.col("exterior"), F.col("interiors")),
    })
    return own.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("parts"), *[F.sum(c).cast("bigint").alias(c) for c in ("holes", "corners")],
        *[F.sum(c).alias(c) for c in ("area", "perimeter")])


def _merged_rings(ratio):
    def run(spark, sf_dir):
        runs = cut(fields(spark, sf_dir))
        kept = cut(labelling.running_id(labelling.size_filter(stats(runs), 500), KEY))
        return summary(merging.merged_field_polygons(runs, kept, KEY, STRIDE, ratio), ["raster_id", "label", "ids"])

    return run


for _name, _ratio in (("G5_A15_merged_rings", 0.0), ("G5_merged_rings_ratio", 0.15)):
    query(_name, with_(
        *LAB, STATS_SQL, CONTACT_SQL, merged_sql(_ratio),
        "mc AS (SELECT l.raster_id, p.label, l.y, l.x FROM lab l JOIN lbl p USING (raster_id, comp))",
        QUADS_SQL.format(keys="raster_id, label", y="y", x="x", cells="mc"), body=f"""
SELECT raster_id, label, ids, 1::BIGINT AS parts, (1 - {EULER})::BIGINT AS holes, (q1 + q3 + 2 * qd)::BIGINT AS corners, area, perimeter
FROM merged JOIN corners USING (raster_id, label)""", recursive=True))(_merged_rings(_ratio))


# Parts of a union: cells of one component joined over their sides.
PARTS_SQL = """
steps AS (SELECT a.comp, a.cx, a.cy, b.cx AS nx, b.cy AS ny FROM ucells a JOIN ucells b ON b.comp = a.comp AND abs(b.cx - a.cx) + abs(b.cy - a.cy) = 1),
reach AS (SELECT u.comp, u.cx, u.cy, u.cy * 1000000 + u.cx AS root FROM ucells u
  LEFT JOIN ucells l ON l.comp = u.comp AND l.cy = u.cy AND l.cx = u.cx - 1 LEFT JOIN ucells t ON t.comp = u.comp AND t.cx = u.cx AND t.cy = u.cy - 1
  WHERE l.comp IS NULL AND t.comp IS NULL
  UNION SELECT s.comp, s.nx, s.ny, r.root FROM reach r JOIN steps s USING (comp, cx, cy)),
pieces AS (SELECT comp, count(DISTINCT root) AS parts FROM (SELECT comp, cx, cy, min(root) AS root FROM reach GROUP BY 1, 2, 3) GROUP BY 1)"""
RINGS_BODY = f"""
SELECT comp, ids, p.parts, (p.parts - {EULER})::BIGINT AS holes, (q1 + q3 + 2 * qd)::BIGINT AS corners, area, perimeter
FROM names JOIN shape USING (comp) JOIN corners USING (comp) JOIN pieces p USING (comp)"""


def _box_rings_sql(cond: str, snapped: str, unit: int) -> str:
    return with_(B.BOXES_SQL, PAIRS_SQL, box_walk(cond), snapped, UNION_SQL.format(u=unit), QUADS_SQL.format(keys="comp", y="cy", x="cx", cells="ucells"),
                 PARTS_SQL, body=RINGS_BODY, recursive=True)


@query("G5_E5_box_union_rings", _box_rings_sql("inter > 0 OR shared > 0", UNSNAPPED, 1))
def box_union_rings(spark, sf_dir):
    """Rings of the unions of boxes that overlap or touch along a side."""
    accept = spatial.merges_adjacent(F.col("inter"), F.col("shared"), F.col("min_perimeter"), 0.0)
    grouped = merging.box_components(B.boxes(spark, sf_dir), accept)
    return summary(merging.dissolved_polygons(grouped, None, tile=256.0), ["comp", "ids"])


@query("G6_A16_duplicate_rings", _box_rings_sql("inter / (200 - inter) >= 0.2 OR inter / 100 >= 0.8", SNAPPED, 10))
def duplicate_rings(spark, sf_dir):
    """Rings of merged detections on the snap grid, part by part."""
    accept = spatial.merges_duplicates(F.col("iou"), F.col("containment"))
    grouped = merging.box_components(B.boxes(spark, sf_dir), accept)
    return summary(merging.dissolved_polygons(grouped, 10.0), ["comp", "ids"])


@query("P11_W5_size_filter", with_(B.BOXES_SQL, body="""
SELECT id, row_number() OVER (ORDER BY id) AS new_id FROM (SELECT *, (x1 - x0) * (1 + patch_id) * 10 AS area FROM boxes) WHERE area > 500 AND area < 1500"""))
def size_filter(spark, sf_dir):
    """Bounds are dropped here; ids are positions after the filter."""
    b = B.boxes(spark, sf_dir).withColumn("area", (F.col("x1") - F.col("x0")) * (1 + F.col("patch_id")) * 10)
    kept = labelling.size_filter(b, 500, 1500, keep_bounds=False)
    return graph.dense_index(kept, [F.col("id")], "new_id").select("id", (F.col("new_id") + 1).alias("new_id"))


@query("P20_confidence_filter", with_(B.BOXES_SQL, body="SELECT id, conf FROM boxes WHERE conf > 0.05"))
def confidence(spark, sf_dir):
    return scoring.confident(B.boxes(spark, sf_dir)).select("id", "conf")


@query("W8_top_per_patch", with_(B.BOXES_SQL, body="""
SELECT patch_id, id, conf FROM (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY conf DESC, id) AS r FROM boxes) WHERE r <= 100"""))
def top_per_patch(spark, sf_dir):
    return scoring.top_per_patch(B.boxes(spark, sf_dir), 100).select("patch_id", "id", "conf")


@query("E1_union_patch_frames", with_(B.BOXES_SQL, body="""
SELECT id, patch_id, conf FROM boxes WHERE patch_id < 8 UNION ALL SELECT id, patch_id, -1.0::DOUBLE FROM boxes WHERE patch_id >= 8"""))
def union_frames(spark, sf_dir):
    """Frames of patches put together; the second half lacks a column."""
    b = B.boxes(spark, sf_dir)
    some = b.filter(F.col("patch_id") < 8).select("id", "patch_id", "conf")
    rest = b.filter(F.col("patch_id") >= 8).select("id", "patch_id")
    return scoring.union_frames([some, rest], {"conf": -1.0})


def _segments(spark, sf_dir):
    """Detections as segments; the third of each chain is degenerate (two points)."""
    b = B.boxes(spark, sf_dir)
    full = (F.array("x0", "x1", "x1", "x0"), F.array("y0", "y0", "y1", "y1"))
    thin = (F.array("x0", "x1"), F.array("y0", "y1"))
    bad = F.col("id") % 3 == 2
    return b.select("id", *[F.when(bad, t).otherwise(f).alias(n) for n, f, t in zip(("xs", "ys"), full, thin)])


def _affine():
    return tuple(F.lit(v) for v in (10.0, 0.0, 500.0, 0.0, -10.0, 900.0))


@query("T11_P18_segment_rings", with_(B.BOXES_SQL, body="""
SELECT id, 10000.0::DOUBLE AS area, 400.0::DOUBLE AS perimeter, 10 * x0 + 500 AS xmin, 900 - 10 * y1 AS ymin, 5::BIGINT AS points
FROM boxes WHERE id % 3 <> 2"""))
def segment_rings(spark, sf_dir):
    r = scoring.segment_rings(_segments(spark, sf_dir), _affine()).select("id", "exterior")
    e = F.col("exterior")
    return r.select("id", rings.ring_area(e).alias("area"), rings.ring_length(e).alias("perimeter"), rings.ring_bbox(e).alias("b"),
                    F.size(e).alias("points")).select("id", "area", "perimeter", "b.xmin", "b.ymin", "points")


@query("T12_feature_flatten", with_(B.BOXES_SQL, body="""
SELECT id::VARCHAR AS id, CASE WHEN id % 2 = 0 THEN 100.0::DOUBLE ELSE -1.0 END AS area, -1.0::DOUBLE AS perimeter FROM boxes"""))
def feature_flatten(spark, sf_dir):
    """Feature documents -> columns; what a feature lacks is null (shown as -1)."""
    b = B.boxes(spark, sf_dir)
    props = F.struct(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, 100.0).alias("metrics:area"))
    doc = F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties")))
    flat = features.feature_columns(b.select(doc.alias("value")), {"id": "string", "metrics:area": "double", "metrics:perimeter": "double"})
    return flat.select("id", *[F.coalesce(f"metrics:{m}", F.lit(-1.0)).alias(m) for m in ("area", "perimeter")])


@query("G3_ring_assembly", with_(*LAB, STATS_SQL, body="SELECT raster_id, comp, area, perimeter FROM stats", recursive=True))
def ring_assembly(spark, sf_dir):
    """Traced rings measured as polygons equal the cell counts."""
    return flows.field_outlines(B.cells(spark, sf_dir), KEY, STRIDE, min_size=None).select("raster_id", "comp", "area", "perimeter")


@query("G4_drop_interiors", with_(B.BOXES_SQL, body="SELECT id, 84.0::DOUBLE AS with_hole, 56.0::DOUBLE AS len, 100.0::DOUBLE AS closed FROM boxes"))
def drop_interiors(spark, sf_dir):
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    p = B.boxes(spark, sf_dir).select("id", rings.box_ring(x0, y0, x1, y1).alias("e"), F.array(rings.box_ring(x0 + 3, y0 + 3, x0 + 7, y0 + 7)).alias("i"))
    return p.select("id", rings.polygon_area(F.col("e"), F.col("i")).alias("with_hole"), rings.polygon_length(F.col("e"), F.col("i")).alias("len"),
                    rings.polygon_area(F.col("e"), rings.drop_interiors(F.col("i"))).alias("closed"))


@query("U7_simplify_rings")
def simplify(spark, sf_dir):
    """Outlines with holes closed and vertices reduced."""
    p = flows.field_outlines(B.cells(spark, sf_dir), KEY, STRIDE, tolerance=15, close_interiors=True, min_size=500)
    return p.select("raster_id", "id", "area", "perimeter", F.size("exterior").alias("points"))


@query("P19_valid_polygons", with_(B.BOXES_SQL, body="SELECT id FROM boxes WHERE patch_id % 4 <> 3"))
def valid_polygons(spark, sf_dir):
    """Every fourth patch has bow ties, flat rings or no ring; those go."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    pt = rings.point
    bow = F.array(pt(x0, y0), pt(x1, y1), pt(x1, y0), pt(x0, y1 + 5), pt(x0, y0))
    flat = F.array(pt(x0, y0), pt(x1, y0), pt(x0, y0), pt(x0, y0))
    ring = F.when(F.col("patch_id") % 4 != 3, rings.box_ring(x0, y0, x1, y1)).when(F.col("id") % 3 == 0, bow).when(F.col("id") % 3 == 1, flat)
    return outlines.valid_polygons(B.boxes(spark, sf_dir).withColumn("exterior", ring)).select("id")


@query("E7_explode_parts", with_(B.BOXES_SQL, body="SELECT id, 100.0::DOUBLE AS area FROM boxes UNION ALL SELECT id, 25.0::DOUBLE FROM boxes"))
def explode_parts(spark, sf_dir):
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    parts = F.array(rings.box_ring(x0, y0, x1, y1), rings.box_ring(x0 + 20, y0, x0 + 25, y0 + 5))
    e = outlines.explode_parts(B.boxes(spark, sf_dir).select("id", parts.alias("parts")), "parts")
    return e.select("id", rings.ring_area(F.col("exterior")).alias("area"))


@query("G3_merged_outlines", with_(B.cells_sql(), reach_sql("lab", "cls = 1", 1 << 20), body="""
SELECT raster_id, comp AS label, count(*) * 100.0::DOUBLE AS area FROM lab GROUP BY 1, 2""", recursive=True))
def merged_outlines(spark, sf_dir):
    """Outlines of whole regions after the tile cuts are undone."""
    runs = labelling.stitched(cut(fields(spark, sf_dir)), KEY, STRIDE)
    shapes = outlines.field_polygons(outlines.rejoin_runs(runs, KEY), KEY, "label", (10.0, 0.0, 0.0, 0.0, 10.0, 0.0))
    return shapes.select("raster_id", "label", rings.polygon_area(F.col("exterior"), F.col("interiors")).alias("area"))


@query("G11_non_maximum_suppression", with_(B.BOXES_SQL, """
r AS (SELECT *, id // 3 AS g, row_number() OVER (PARTITION BY id // 3 ORDER BY conf DESC, id) AS k FROM boxes),
hit AS (SELECT a.g, a.k AS ka, b.k AS kb FROM r a JOIN r b ON a.g = b.g AND a.k < b.k
  WHERE greatest(10 - abs(a.x0 - b.x0), 0) * 10 / (200 - greatest(10 - abs(a.x0 - b.x0), 0) * 10) > 0.3),
f AS (SELECT r.*, EXISTS (SELECT 1 FROM hit h WHERE h.g = r.g AND ka = 1 AND kb = 2) AS h12,
  EXISTS (SELECT 1 FROM hit h WHERE h.g = r.g AND ka = 1 AND kb = 3) AS h13, EXISTS (SELECT 1 FROM hit h WHERE h.g = r.g AND ka = 2 AND kb = 3) AS h23 FROM r)""", body="""
SELECT id, conf FROM f WHERE k = 1 OR (k = 2 AND NOT h12) OR (k = 3 AND NOT h13 AND (h12 OR NOT h23))"""))
def nms(spark, sf_dir):
    """The boxes of a chain lie in one patch here."""
    b = B.boxes(spark, sf_dir).withColumn("patch_id", B.div(F.col("id"), 3) % 16)
    return scoring.non_maximum_suppression(b, 0.3).select("id", "conf")


@query("U2_instance_flow", with_("""
boxes0 AS (SELECT * FROM boxes_in WHERE conf > 0.05),
ranked AS (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY conf DESC, id) AS r FROM boxes0),
boxes AS (SELECT * FROM ranked WHERE r <= 100)""".replace("\nboxes0", B.BOXES_SQL.replace("boxes AS", "boxes_in AS", 1) + ",\nboxes0"),
       PAIRS_SQL, box_walk("inter / (200 - inter) >= 0.2 OR inter / 100 >= 0.8"), SNAPPED, UNION_SQL.format(u=10), body=UNION_BODY, recursive=True))
def instance_flow(spark, sf_dir):
    """Detections to merged fields: confidence, top 100 per patch, size, duplicates."""
    return flows.postprocess_instances(B.boxes(spark, sf_dir), min_size=50)


@query("K1_field_table_sink", with_(B.BOXES_SQL, body="""
SELECT id::VARCHAR AS id, 100.0::DOUBLE AS area, 40.0::DOUBLE AS perimeter, 'auto-imagery' AS method, 93::BIGINT AS bytes,
  '2023-04-10T10:20:30Z' AS determined FROM boxes"""))
def field_table(spark, sf_dir):
    """Field polygons with binary geometry, written and read back."""
    path = scratch_path(spark, "fields")
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    p = B.boxes(spark, sf_dir).withColumns({"exterior": rings.box_ring(x0, y0, x1, y1)})
    p = p.withColumns({"interiors": F.slice(F.array("exterior"), 1, 0), "area": rings.ring_area(F.col("exterior")), "perimeter": rings.ring_length(F.col("exterior"))})
    writers.write_fields(writers.field_table(p, F.lit("2023:04:10 10:20:30")), path)
    return spark.read.parquet(path).select(
        "id", F.col("metrics:area").alias("area"), F.col("metrics:perimeter").alias("perimeter"), F.col("determination:method").alias("method"),
        F.length("geometry").alias("bytes"), F.col("determination:datetime").alias("determined"))


FILE_SQL = with_(*LAB, STATS_SQL, QUADS_SQL.format(keys="raster_id, comp", y="y", x="x", cells="lab"), body=f"""
SELECT raster_id || '-' || comp AS id, (1 - {EULER})::BIGINT AS holes, (q1 + q3 + 2 * qd)::BIGINT AS corners, area, perimeter
FROM stats JOIN corners USING (raster_id, comp) WHERE area >= 500""", recursive=True)


def _outlined(spark, sf_dir):
    """Fields of at least 500 square metres as polygons with an id."""
    shapes = outlines.field_polygons(fields(spark, sf_dir), [*KEY, "ty", "tx"], affine=(10.0, 0.0, 0.0, 0.0, -10.0, 0.0)).withColumns({
        "area": rings.polygon_area(F.col("exterior"), F.col("interiors")), "perimeter": rings.polygon_length(F.col("exterior"), F.col("interiors"))})
    return labelling.size_filter(shapes, 500).withColumn("id", F.concat_ws("-", "raster_id", "comp"))


@query("K1_T10_geoparquet_rings", FILE_SQL)
def geoparquet_rings(spark, sf_dir):
    """Holes, corners and measures taken from the coordinates that come back from the written parts."""
    path = scratch_path(spark, "geoparquet")
    writers.write_fields(writers.field_table(_outlined(spark, sf_dir)), path, srid=32633)
    back = spark.read.parquet(path).select("id", writers.wkb_polygon("geometry").alias("g")).select("id", "g.*")
    return summary(back, ["id"]).drop("parts")


@query("K2_geojson_document", FILE_SQL)
def geojson_document(spark, sf_dir):
    """The same through one GeoJSON document."""
    path = scratch_path(spark, "geojson")
    writers.write_geojson(writers.field_features(_outlined(spark, sf_dir)), path)
    found = features.read_document(spark, path, "struct<geometry: struct<coordinates: array<array<array<double>>>>, properties: struct<id: string>>")
    ring = F.transform("f.geometry.coordinates", lambda r: F.transform(r, lambda p: rings.point(p[0], p[1])))
    parts = found.select(F.col("f.properties.id").alias("id"), ring.alias("r")).select(
        "id", F.col("r")[0].alias("exterior"), F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(0))).alias("interiors"))
    return summary(parts, ["id"]).drop("parts")


@query("A15_K1_field_file", with_(
    *LAB, STATS_SQL, CONTACT_SQL, merged_sql(0.0), "mc AS (SELECT l.raster_id, p.label, l.y, l.x FROM lab l JOIN lbl p USING (raster_id, comp))",
    QUADS_SQL.format(keys="raster_id, label", y="y", x="x", cells="mc"), body=f"""
SELECT raster_id, ids AS id, (1 - {EULER})::BIGINT AS holes, (q1 + q3 + 2 * qd)::BIGINT AS corners, area, perimeter
FROM merged JOIN corners USING (raster_id, label)""", recursive=True))
def field_file(spark, sf_dir):
    """From class raster to merged polygons in files, and back."""
    made = flows.field_polygons(B.cells(spark, sf_dir), KEY, STRIDE, merge_ratio=0.0)
    path = scratch_path(spark, "field-file")
    flows.write_field_polygons(made.withColumn("id", F.concat_ws("/", "raster_id", "id")), path, srid=32633)
    back = spark.read.parquet(path).select(F.split("id", "/").alias("n"), writers.wkb_polygon("geometry").alias("g"))
    back = back.select(F.col("n")[0].cast("bigint").alias("raster_id"), F.col("n")[1].alias("id"), "g.*")
    return summary(back, ["raster_id", "id"]).drop("parts")


@query("K2_ndjson_sink", with_(B.BOXES_SQL, body="""
SELECT printf('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[%s,%s],[%s,%s],[%s,%s],[%s,%s],[%s,%s]]]},"properties":{"id":"%s"}}',
  x0::VARCHAR, y0::VARCHAR, x1::VARCHAR, y0::VARCHAR, x1::VARCHAR, y1::VARCHAR, x0::VARCHAR, y1::VARCHAR, x0::VARCHAR, y0::VARCHAR, id::VARCHAR) AS value FROM boxes"""))
def ndjson(spark, sf_dir):
    path = scratch_path(spark, "ndjson")
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    p = B.boxes(spark, sf_dir).select("id", rings.box_ring(x0, y0, x1, y1).alias("e"))
    line = writers.geojson_feature(F.col("e"), F.slice(F.array("e"), 1, 0), F.struct(F.col("id").cast("string").alias("id")))
    writers.write_ndjson(p.select(line.alias("value")), path)
    return spark.read.text(path)
