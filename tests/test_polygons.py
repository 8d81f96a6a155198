"""Slanted polygons: runs, pair measures, common sides, unions, the detection flow."""

import math
import random

from pyspark.sql import functions as F

from furrow.functions import projection
from furrow.operators import scanline, unions
from furrow.plans import flows

SCHEMA = "id long, exterior array<struct<x: double, y: double>>, interiors array<array<struct<x: double, y: double>>>"


def closed(points):
    return [tuple(map(float, p)) for p in [*points, points[0]]]


def frame(spark, shapes):
    return spark.createDataFrame([(i, closed(o), [closed(h) for h in holes]) for i, (o, *holes) in shapes.items()], SCHEMA)


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def cells(shape, step):
    """Cells whose centre has an odd number of sides to its left."""
    rings = [closed(r) for r in shape]
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    out = set()
    for r in range(math.floor(min(ys) / step) - 1, math.ceil(max(ys) / step) + 1):
        for c in range(math.floor(min(xs) / step) - 1, math.ceil(max(xs) / step) + 1):
            x, y, odd = (c + 0.5) * step, (r + 0.5) * step, False
            for ring in rings:
                for a, b in zip(ring, ring[1:]):
                    if min(a[1], b[1]) <= y < max(a[1], b[1]) and a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) <= x:
                        odd = not odd
            if odd:
                out.add((r, c))
    return out


def random_shapes(n, seed):
    rng = random.Random(seed)
    made = {}
    for i in range(n):
        cx, cy, size = rng.uniform(-40, 40), rng.uniform(-40, 40), rng.choice([2, 5, 20])
        around = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(3, 9)))
        outer = [(cx + size * rng.uniform(0.4, 1) * math.cos(t), cy + size * rng.uniform(0.4, 1) * math.sin(t)) for t in around]
        hole = [(cx + size * 0.2 * math.cos(t), cy + size * 0.2 * math.sin(t)) for t in (0, 2, 4)]
        made[i] = (outer, hole) if i % 3 == 0 else (outer,)
    made[n] = ([(0, 0), (10, 10), (10, 0), (0, 10)],)  # crosses itself
    made[n + 1] = ([(3, 3), (5, 3)],)  # no area
    return made


def test_runs_and_measures(spark):
    shapes = random_shapes(25, 3)
    want = {i: cells(s, 0.5) for i, s in shapes.items()}
    polygons = frame(spark, shapes)
    got = {i: set() for i in shapes}
    for r in scanline.polygon_runs(polygons, 0.5).collect():
        new = {(r["y"], c) for c in range(r["x0"], r["x1"] + 1)}
        assert not new & got[r["id"]]
        got[r["id"]] |= new
    assert got == want
    pairs = {(r["a_id"], r["b_id"]): (r["inter"], r["iou"], r["containment"]) for r in scanline.pair_measures(polygons, 0.5).collect()}
    assert set(pairs) == {(i, j) for i in want for j in want if i < j and want[i] & want[j]}
    for (i, j), (inter, iou, containment) in pairs.items():
        n = len(want[i] & want[j])
        assert inter == n / 4 and math.isclose(iou, n / len(want[i] | want[j])) and math.isclose(containment, n / min(len(want[i]), len(want[j])))


def test_shared_sides_of_any_slant(spark):
    shapes = {
        1: ([(0, 0), (10, 0), (13, 4), (3, 4)],), 2: ([(10, 0), (20, 0), (23, 4), (13, 4)],),  # a common slanted side of 5
        3: ([(16, 8), (0, 4.0), (3, 4), (12, 4)],),  # 9 of the upper side of 1
        4: (box(-4, -4, 0, 0),), 5: ([(10, 0), (11.5, 2), (14, 1)],),  # a corner; a part of the slanted side
    }
    polygons = frame(spark, shapes)
    pairs = scanline.spatial.intersecting_pairs(scanline.polygon_boxes(polygons))
    got = {(r["a_id"], r["b_id"]): round(r["shared"], 6) for r in scanline.shared_sides(polygons, pairs).collect()}
    assert got == {(1, 2): 5.0, (1, 3): 9.0, (1, 5): 2.5, (2, 5): 2.5}


def merged(spark, shapes, ratio, **options):
    rows = unions.merge_adjacent_polygons(frame(spark, shapes), ratio, **options).collect()
    return sorted((r["ids"], r["area"], r["perimeter"]) for r in rows)


def test_adjacent_polygons(spark):
    pair = {1: (box(0, 0, 4, 4),), 2: (box(4, 0, 8, 4),)}  # shared / shorter outline = 0.25
    assert merged(spark, pair, 0.2) == [("1,2", 32.0, 24.0)]
    assert [i for i, _, _ in merged(spark, pair, 0.5)] == ["1", "2"]
    assert [i for i, _, _ in merged(spark, {1: (box(0, 0, 2, 2),), 2: (box(1, 1, 3, 3),)}, 0.9)] == ["1,2"]
    assert [i for i, _, _ in merged(spark, {1: (box(0, 0, 2, 2),), 2: (box(2, 2, 4, 4),)}, 0.0)] == ["1", "2"]
    chain = {i: (box(3 * i, 0, 3 * i + 3, 3),) for i in range(1, 4)} | {9: (box(50, 0, 51, 1),)}
    assert merged(spark, chain, 0.0) == [("1,2,3", 27.0, 24.0), ("9", 1.0, 4.0)]
    assert unions.merge_adjacent_polygons(frame(spark, chain).limit(0), 0.0).count() == 0
    some = spark.createDataFrame([(1, closed(box(0, 0, 1, 1)), []), (2, [], []), (3, closed(box(5, 5, 6, 6)), [])], SCHEMA)
    assert [r["ids"] for r in unions.merge_adjacent_polygons(some, 0.0).orderBy("ids").collect()] == ["1", "3"]


def test_measures_through_a_hook(spark):
    shapes = {1: (box(0, 0, 4, 4),), 2: (box(4, 0, 8, 4),)}
    assert merged(spark, shapes, 0.0, hook=lambda x, y: (x * 2, y * 3)) == [("1,2", 32.0 * 6, 2 * (8 * 2 + 4 * 3))]
    degrees = {1: (box(10, 50, 10.01, 50.01),)}
    got = merged(spark, degrees, 0.0, step=0.001, grid=0.001, hook=projection.equal_area)
    assert math.isclose(got[0][1], 0.797e6, rel_tol=0.01)  # a hundredth of a degree at 50 north, in square metres


def test_detections_of_any_shape(spark):
    shapes = {
        1: ([(0, 0), (60, 0), (60, 60), (0, 60)], [(20, 20), (40, 20), (40, 40), (20, 40)]),
        2: ([(5, 5), (70, 0), (60, 70), (0, 60)],),  # the same object
        3: ([(200, 200), (260, 200), (230, 260)],),
        4: (box(300, 300, 310, 310),),  # too small
        5: ([(400, 400), (460, 460), (460, 400), (400, 460)],),  # crosses itself
    }
    rows = flows.postprocess_polygons(frame(spark, shapes)).collect()
    assert sorted(r["ids"] for r in rows) == ["1,2", "3"] and all(not r["interiors"] for r in rows)
    union = cells((shapes[1][0],), 10.0) | cells(shapes[2], 10.0)
    one = next(r for r in rows if r["ids"] == "1,2")
    assert one["area"] == len(union) * 100 and one["exterior"][0] == one["exterior"][-1]
    apart = flows.postprocess_polygons(frame(spark, shapes), padding=0, close_interiors=False).orderBy("comp").collect()
    assert [(r["comp"], len(r["interiors"])) for r in apart] == [(1, 1), (2, 0), (3, 0)] and apart[0]["area"] == 3200.0


def test_many_polygons_with_gaps(spark):
    grid = {i * 32 + j: (box(i * 3, j * 3, i * 3 + 2, j * 3 + 2),) for i in range(32) for j in range(32)}
    assert unions.merge_adjacent_polygons(frame(spark, grid), 0.0).agg(F.count(F.lit(1)), F.sum("area")).first()[:] == (1024, 4096.0)
