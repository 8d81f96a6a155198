"""Rings of unions against counting on cells."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from furrow.operators import boundary, merging


def inside(rings, x, y):
    """Even-odd test of a point against all rings of a polygon."""
    odd = False
    for ring in rings:
        for a, b in zip(ring, ring[1:]):
            if (a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
                odd = not odd
    return odd


def cells_of(rings):
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    return {(x, y) for x in range(int(min(xs)), int(max(xs))) for y in range(int(min(ys)), int(max(ys))) if inside(rings, x + 0.5, y + 0.5)}


def parts_of(cells):
    left, out = set(cells), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            part.add((x, y))
            near = {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} & left
            left -= near
            todo += near
        out.append(frozenset(part))
    return out


def polygons(spark, cells, tile):
    """Label -> polygons, from cells given as unit boxes."""
    rows = [(label, float(x), float(y), float(x + 1), float(y + 1)) for label, x, y in cells]
    boxes = spark.createDataFrame(rows, "label long, x0 double, y0 double, x1 double, y1 double")
    made = defaultdict(list)
    for r in boundary.outlines_of(boxes, [], "label", tile).collect():
        rings = [[(p["x"], p["y"]) for p in ring] for ring in (r["exterior"], *r["interiors"])]
        for ring in rings:
            assert ring[0] == ring[-1]
            corners = list(zip(ring[-2:-1] + ring[:-2], ring[:-1], ring[1:]))
            assert all(((a[0] == b[0]) != (b[0] == c[0])) for a, b, c in corners)
        made[r["label"]].append((rings, r["area"], r["perimeter"]))
    return made


@pytest.mark.parametrize("tile", [3.0, 8.0, 1000.0])
def test_random_regions(spark, tile):
    rng = random.Random(int(tile))
    cells = [(label, x, y) for label in range(6) for x in range(-5, 14) for y in range(-3, 12) if rng.random() < 0.35 + 0.1 * label]
    made = polygons(spark, cells, tile)
    for label in range(6):
        own = {(x, y) for i, x, y in cells if i == label}
        parts = parts_of(own)
        got = {frozenset(cells_of(rings)): (area, perimeter) for rings, area, perimeter in made[label]}
        assert set(got) == set(parts) and len(made[label]) == len(parts)
        for part, (area, perimeter) in got.items():
            assert area == len(part)
            assert perimeter == sum((x + i, y + j) not in part for x, y in part for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))


def test_islands_in_holes(spark):
    cells = [(1, x, y) for x in range(13) for y in range(13) if min(x, y, 12 - x, 12 - y) % 2 == 0]
    cells += [(1, 3, 3)]  # a wall inside the first hole touches nothing but corners
    made = polygons(spark, cells, 4.0)[1]
    assert sorted(cells_of(r) for r, _, _ in made) and {frozenset(cells_of(r)) for r, _, _ in made} == set(parts_of({(x, y) for _, x, y in cells}))
    assert sorted(len(r) - 1 for r, _, _ in made) == sorted([1] * 3 + [0] * (len(made) - 3))


def test_one_field_over_many_tiles(spark):
    """A comb over 100 tiles: one ring, put together from chains of all of them."""
    cells = [(7, x, y) for x in range(100) for y in range(100) if y == 0 or x % 2 == 0]
    runs = spark.createDataFrame([(1, c, c // 10 * 1000 + y // 10, y, c, c) for _, c, y in cells], "r int, x0 int, comp int, y int, a int, x1 int").drop("a")
    boxes = boundary.run_boxes(runs.withColumn("label", F.lit(7)), ["r"], "label")
    got = boundary.outlines_of(boxes, ["r"], "label", 10.0, (10, 0, 500, 0, -10, 900)).collect()
    assert len(got) == 1 and len(got[0]["interiors"]) == 0 and got[0]["area"] == len(cells) * 100
    assert len(got[0]["exterior"]) - 1 == 4 * 50 + 2  # four corners a tooth, and the end of the back
    assert {(p["x"] - 500) % 10 for p in got[0]["exterior"]} == {0.0} and max(p["y"] for p in got[0]["exterior"]) == 900


def test_ring_places(spark):
    rng = random.Random(9)
    links, want = [], {}
    for size in (1, 2, 3, 5, 16, 37, 100):
        ids = rng.sample(range(1000 * size, 1000 * size + 999), size)
        links += list(zip(ids, ids[1:] + ids[:1]))
        low = ids.index(min(ids))
        want |= {i: (min(ids), (low - n) % size) for n, i in enumerate(ids)}
    got = boundary.ring_places(spark.createDataFrame(links, "id long, nxt long")).collect()
    assert {r["id"]: (r["low"], r["at"]) for r in got} == want


def test_dissolved_boxes_with_a_hole_and_two_parts(spark):
    boxes = spark.createDataFrame(
        [(1, 1, 0.0, 0.0, 30.0, 10.0), (2, 1, 0.0, 20.0, 30.0, 30.0), (3, 1, 0.0, 5.0, 10.0, 25.0), (4, 1, 20.0, 5.0, 30.0, 25.0), (5, 1, 50.5, 0.0, 60.5, 3.0),
         (6, 2, 0.0, 0.0, 4.0, 4.0)], "id long, comp long, x0 double, y0 double, x1 double, y1 double")
    got = sorted(((r["comp"], r["ids"], r["boxes"], r["area"], r["perimeter"], len(r["interiors"])) for r in merging.dissolved_polygons(boxes, None).collect()))
    assert got == [(1, "1,2,3,4,5", 5, 30.0, 26.0, 0), (1, "1,2,3,4,5", 5, 800.0, 160.0, 1), (2, "6", 1, 16.0, 16.0, 0)]
    snapped = merging.dissolved_polygons(boxes, 10.0).collect()
    assert [(r["comp"], r["area"]) for r in snapped] == [(1, 800.0)]


def test_nothing(spark):
    none = spark.createDataFrame([], "label long, x0 double, y0 double, x1 double, y1 double")
    assert boundary.outlines_of(none, [], "label", 8.0).count() == 0
