"""Footprints of several parts: reading, validity, clipping, meeting."""

import json

import pytest
from pyspark.sql import functions as F

from furrow.functions import footprints as P
from furrow.functions import rings
from furrow.sources import rasters


def box(x0, y0, x1, y1):
    return [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]


def parts(kind, coordinates):
    return P.from_geojson(F.lit(kind), F.lit(json.dumps(coordinates)))


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


class Shape:
    """A geometry that becomes a Column once a session is there."""

    def __init__(self, kind, coordinates):
        self.given = kind, coordinates

    def __call__(self):
        return parts(*self.given)


HOLED = Shape("Polygon", [box(0, 0, 10, 10), box(2, 2, 8, 8)])
TWO = Shape("MultiPolygon", [[box(0, 0, 10, 10), box(2, 2, 8, 8)], [box(20, 0, 30, 10)]])
BOW = Shape("Polygon", [[[0, 0], [10, 0], [0, 10], [10, 10], [0, 0]]])
OUTSIDE = Shape("Polygon", [box(0, 0, 10, 10), box(20, 20, 21, 21)])


def lit_box(*v):
    return [F.lit(float(x)) for x in v]


def test_reading_and_validity(spark):
    assert one(spark, P.parts_area(HOLED())) == 64 and one(spark, P.parts_area(TWO())) == 164
    assert one(spark, parts("Point", [1, 2])) is None
    flags = one(spark, F.array(*[P.parts_valid(p) for p in (HOLED(), TWO(), BOW(), OUTSIDE(), parts("Point", [1, 2]), parts("MultiPolygon", []), parts("Polygon", [box(0, 0, 0, 5)]))]))
    assert flags == [True, True, False, False, False, False, False]


@pytest.mark.parametrize(("window", "area"), [((-5, -5, 40, 40), 164), ((0, 0, 5, 10), 32), ((2, 2, 8, 8), 0), ((5, 5, 25, 20), 16 + 25), ((11, 0, 19, 9), 0)])
def test_clipping_in_place_and_by_rings(spark, window, area):
    cut = P.clip_parts(TWO(), lambda r: P.clip_ring(r, *lit_box(*window)))
    assert one(spark, P.covered_area(TWO(), *lit_box(*window))) == pytest.approx(area)
    assert one(spark, P.parts_area(cut)) == pytest.approx(area)
    assert all(r["exterior"][0] == r["exterior"][-1] for r in one(spark, cut))


def test_clip_to_a_slanted_ring(spark):
    diamond = F.array(*[rings.point(F.lit(float(x)), F.lit(float(y))) for x, y in [(5, 0), (10, 5), (5, 10), (0, 5), (5, 0)]])
    square = F.array(*[rings.point(F.lit(float(x)), F.lit(float(y))) for x, y in box(0, 0, 5, 10)])
    assert one(spark, rings.ring_area(P.clip_ring_to(square, diamond))) == pytest.approx(25)
    cut = P.clip_parts(TWO(), lambda r: P.clip_ring_to(r, diamond))
    assert one(spark, P.parts_area(cut)) == pytest.approx(50 - 34)  # of the hole, 36 less its four corners of 0.5


def test_meeting(spark):
    def meets(a, b):
        return one(spark, F.array(P.parts_meet(a, b), P.parts_meet(b, a)))

    def alone(*coordinates):
        return parts("Polygon", list(coordinates))

    assert meets(TWO(), alone(box(25, 5, 26, 6))) == [True, True]
    assert meets(HOLED(), alone(box(4, 4, 5, 5))) == [False, False]  # inside the hole
    assert meets(HOLED(), alone(box(4, 4, 9, 5))) == [True, True]
    assert meets(HOLED(), alone(box(10, 10, 12, 12))) == [True, True]  # one corner
    assert meets(HOLED(), alone([[11, 0], [20, 10], [20, 0], [11, 0]])) == [False, False]
    assert meets(alone([[0, 0], [10, 10], [0, 10], [0, 0]]), alone([[1, 0], [10, 0], [10, 9], [1, 0]])) == [False, False]  # boxes overlap
    assert one(spark, P.separated(F.get(TWO(), F.lit(0))["exterior"], F.get(TWO(), F.lit(1))["exterior"])) is True


def test_catalogue_with_many_kinds(spark, tmp_path):
    made = [("Polygon", [box(0, 0, 1, 1)]), ("MultiPolygon", [[box(0, 0, 1, 1)], [box(2, 0, 3, 1), box(2.2, 0.2, 2.4, 0.4)]]), ("Point", [1, 2])]
    page = {"type": "FeatureCollection", "features": [
        {"id": str(i), "geometry": {"type": k, "coordinates": c}, "bbox": [0, 0, 3, 1], "properties": {"datetime": "2024-05-01T10:00:00Z"}} for i, (k, c) in enumerate(made)]}
    page["features"].append({"id": "3", "geometry": None, "bbox": None, "properties": {}})
    (tmp_path / "page.json").write_text(json.dumps(page))
    rows = rasters.normalise_items(rasters.read_catalogue(spark, str(tmp_path))).select(
        "scene_id", F.size("parts").alias("n"), P.parts_area(F.col("parts")).alias("area"), P.parts_valid(F.col("parts")).alias("valid"), "footprint").orderBy("scene_id").collect()
    assert [r["valid"] for r in rows] == [True, True, False, False]
    assert [r["area"] for r in rows[:2]] == [1.0, pytest.approx(1.96)] and rows[2]["footprint"] is None
