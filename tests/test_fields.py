"""Labelling, outlines and stencils against whole-array brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import rings
from furrow.operators import labelling, outlines, stencil
from furrow.plans import flows

KEY = ["raster_id"]
SHAPES = {
    "snake": ["#######", "......#", "#######", "#......", "#######"],
    "ring with island": ["#####", "#...#", "#.#.#", "#...#", "#####"],
    "corner touch": ["##..", "##..", "..##", "..##"],
    "hole corner touch": ["#####", "#.###", "##.##", "#####"],
    "single": ["#"],
    "full": ["####", "####", "####"],
}


def grid(rows):
    return np.array([[c == "#" for c in r] for r in rows]).astype(int)


def cells(spark, arrays, value="cls"):
    rows = [(i, y, x, int(v)) for i, a in enumerate(arrays) for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, f"raster_id long, y int, x int, {value} int")


def flood(img, stride=None):
    """Cell -> smallest (y, x) of its 4-connected region inside its tile."""
    seen, out = set(), {}
    for y, x in zip(*np.nonzero(img)):
        if (y, x) in seen:
            continue
        todo, region = [(y, x)], []
        seen.add((y, x))
        while todo:
            a, b = todo.pop()
            region.append((a, b))
            for p in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= p[0] < img.shape[0] and 0 <= p[1] < img.shape[1] and img[p] and p not in seen:
                    if stride is None or (p[0] // stride, p[1] // stride) == (a // stride, b // stride):
                        seen.add(p)
                        todo.append(p)
        for p in region:
            out[p] = min(region)
    return {(int(k[0]), int(k[1])): int(v[0]) * labelling.ROW_STEP + int(v[1]) for k, v in out.items()}


@pytest.mark.parametrize("name", SHAPES)
def test_labels_and_outlines(spark, name):
    img = grid(SHAPES[name])
    c = cells(spark, [img]).filter("cls = 1")
    got = labelling.run_cells(labelling.label_fields(c, KEY, 64)).collect()
    assert {(r["y"], r["x"]): r["comp"] for r in got} == flood(img)
    polygons = flows.field_outlines(cells(spark, [img]), KEY, 64, affine=(1, 0, 0, 0, 1, 0), min_size=None).collect()
    stats = {r["comp"]: r for r in labelling.cell_metrics(
        labelling.field_stats(labelling.label_fields(c, KEY, 64), KEY), 1.0, 1.0).collect()}
    assert len(polygons) == len(stats)
    for p in polygons:
        assert (p["area"], p["perimeter"]) == (stats[p["comp"]]["area"], stats[p["comp"]]["perimeter"])


def test_random_rasters_across_tiles(spark):
    rng = np.random.default_rng(3)
    imgs = [(rng.random((40, 37)) < p).astype(int) for p in (0.45, 0.6, 0.75)]
    c = cells(spark, imgs).filter("cls = 1")
    runs = labelling.label_fields(c, KEY, 11)
    for tiled, df, name in ((11, labelling.run_cells(runs), "comp"), (None, labelling.run_cells(labelling.stitched(runs, KEY, 11)), "label")):
        rows = df.collect()
        for i, img in enumerate(imgs):
            assert {(r["y"], r["x"]): r[name] for r in rows if r["raster_id"] == i} == flood(img, tiled)


def test_no_field_cells(spark):
    c = cells(spark, [np.zeros((4, 4))])
    assert flows.polygonize(c, KEY, 4).count() == 0


def test_tile_cut_field_is_put_together(spark):
    c = cells(spark, [np.ones((8, 8))])
    row = flows.polygonize(c, KEY, 4, min_size=None, merge_ratio=0.0).collect()
    assert [(r["ids"], r["parts"], r["area"], r["perimeter"]) for r in row] == [("1,2,3,4", 4, 6400.0, 320.0)]
    assert flows.polygonize(c, KEY, 4, min_size=None, merge_ratio=0.3).count() == 4


def test_running_ids_follow_tiles(spark):
    img = grid(["#.#.", "....", "#.#."])
    got = flows.polygonize(cells(spark, [img]), KEY, 2, min_size=None).orderBy("id").collect()
    assert [(r["id"], r["comp"] // labelling.ROW_STEP, r["comp"] % labelling.ROW_STEP) for r in got] == [
        (1, 0, 0), (2, 0, 2), (3, 2, 0), (4, 2, 2)]


def thin_whole(img):
    while True:
        nxt = stencil.thin_once(img)
        if (nxt == img).all():
            return img
        img = nxt


def test_thinning_in_tiles_equals_whole(spark):
    rng = np.random.default_rng(5)
    img = np.kron((rng.random((6, 6)) < 0.6).astype(int), np.ones((7, 7), dtype=int))
    got = stencil.thin(cells(spark, [img]).filter("cls = 1"), KEY, stride=13, per_round=2).collect()
    out = np.zeros_like(img)
    for r in got:
        out[r["y"], r["x"]] = 1
    assert (out == thin_whole(img)).all()


@pytest.mark.parametrize("opening, closing", [(2, 0), (0, 2), (1, 3)])
def test_morphology_in_tiles_equals_windows(spark, opening, closing):
    img = (np.random.default_rng(9).random((23, 31)) < 0.7).astype(int)
    c = cells(spark, [img], "v")
    got = {(r["y"], r["x"]): r["v"] for r in stencil.open_close(c, KEY, "v", opening, closing, stride=8).collect()}
    want, n = c, opening or closing
    for grow in [bool(closing and not opening)] * n + [not (closing and not opening)] * n:
        want = stencil.morph_step(want, KEY, "v", grow)
    assert got == {(r["y"], r["x"]): r["v"] for r in want.collect()}


def test_frame_is_never_boundary(spark):
    c = cells(spark, [np.full((5, 5), 2)])
    got = {(r["y"], r["x"]): r["field"] for r in stencil.fill_thinned_boundaries(c, KEY, F.lit(5), F.lit(5), stride=4).collect()}
    assert all(got[p] == 0 for p in got if 0 in p or 4 in p) and sum(got.values()) > 0


def test_canny_finds_a_step():
    band = np.zeros((16, 16), dtype=np.uint8)
    band[:, 8:] = 255
    edges = stencil.canny(band)
    assert edges.sum(axis=1).tolist() == [1] * 16 and edges[:, 7:9].sum() == 16
    assert stencil.canny(np.zeros((16, 16), dtype=np.uint8)).sum() == 0


def test_simplify_keeps_square_corners(spark):
    ring = [(0, 0), (5, 0.1), (10, 0), (10, 10), (0, 10), (0, 0)]
    df = spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in ring],)], "exterior array<struct<x:double,y:double>>")
    got = outlines.simplify(df, 1.0).select(F.size("exterior").alias("n"), rings.ring_area(F.col("exterior")).alias("a")).first()
    assert (got["n"], got["a"]) == (5, 100.0)


def test_clip_of_a_concave_ring(spark):
    ring = [(0, 0), (10, 0), (10, 10), (5, 5), (0, 10), (0, 0)]
    df = spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in ring],)], "r array<struct<x:double,y:double>>")
    area = rings.clip_area(F.col("r"), F.lit(0.0), F.lit(4.0), F.lit(10.0), F.lit(8.0))
    # rows 4..5 whole, then two flanks losing a triangle of base 6 and height 3
    assert df.select(area.alias("a")).first()["a"] == pytest.approx(10 + 30 - 9)
