"""Small tiles are handed to Python in blocks, and still labelled each for itself."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from furrow.operators import boundary, evaluation, labelling, outlines
from furrow.plans import flows


def _want(cells, stride):
    """Smallest first cell of each region inside its tile, by flooding."""
    left, comp = set(cells), {}
    for y, x in sorted(cells):
        if (y, x) not in left:
            continue
        todo = [(y, x)]
        left.discard((y, x))
        while todo:
            v, u = todo.pop()
            comp[v, u] = y * labelling.ROW_STEP + x
            for n in ((v + 1, u), (v - 1, u), (v, u + 1), (v, u - 1)):
                if n in left and n[0] // stride == v // stride and n[1] // stride == u // stride:
                    left.discard(n)
                    todo.append(n)
    return comp


def test_labels_and_overlaps_of_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(labelling, "BLOCK", 12)
    rng = np.random.default_rng(7)
    shown = {(k, layer): {(int(y) + 9, int(x) + 4) for y, x in np.argwhere(rng.random((31, 29)) < 0.6)} for k in range(2) for layer in "tp"}
    rows = [(k, layer, y, x) for (k, layer), cells in shown.items() for y, x in cells]
    cells = spark.createDataFrame(rows, "raster_id long, layer string, y int, x int")
    runs = labelling.label_fields(cells, ["raster_id", "layer"], 5).cache()
    got = {tuple(r)[:4]: r["comp"] for r in labelling.run_cells(runs).select("raster_id", "layer", "y", "x", "comp").collect()}
    want = {key: _want(cells, 5) for key, cells in shown.items()}
    assert got == {(*key, y, x): c for key, comp in want.items() for (y, x), c in comp.items()}
    met = evaluation.tile_overlaps(runs, ["raster_id"], 5).groupBy("raster_id", "t", "p").agg(F.sum("both")).collect()
    counts = {}
    for k in range(2):
        t, p = want[k, "t"], want[k, "p"]
        for at in t.keys() | p.keys():
            counts[k, t.get(at), p.get(at)] = counts.get((k, t.get(at), p.get(at)), 0) + 1
    assert {tuple(r)[:3]: r[3] for r in met} == counts


def test_a_block_of_tiles_is_one_call(spark, monkeypatch):
    """A call costs about 2 ms, so tiles of a few cells must not have one each."""
    calls = spark.sparkContext.accumulator(0)
    label, overlap = labelling._label_tile, evaluation._overlap_tile

    def counted(made):
        def run(runs: pa.Table) -> pa.Table:
            calls.add(1)
            return made(runs)

        return run

    monkeypatch.setattr(labelling, "_label_tile", counted(label))
    monkeypatch.setattr(evaluation, "_overlap_tile", counted(overlap))
    pixels = spark.range(32 * 32).select(F.lit(1).alias("raster_id"), F.floor(F.col("id") / 32).alias("y"), (F.col("id") % 32).alias("x"),
                                         F.lit(1).alias("cls"), F.lit(1).alias("pred"))
    stats = evaluation.chip_stats(pixels, ["raster_id"], stride=5)
    assert [r.asDict() for r in stats.collect()] == [{"raster_id": 1, "p_tp": 1024, "p_fp": 0, "p_fn": 0, "o_tp": 1, "o_fp": 0, "o_fn": 0}]
    # once for each layer and once for their overlap, where 49 tiles took 147
    assert calls.value <= 3


def _links(rng, raster, n, far):
    """Chains and random links of ``n`` fields whose first cells lie up to ``far`` rows and columns away."""
    codes = sorted({int(y) * labelling.ROW_STEP + int(x) for y, x in rng.integers(0, far, (n, 2))})
    at = rng.integers(0, len(codes), (2 * len(codes) // 3, 2))
    return codes, [(raster, min(codes[i], codes[j]), max(codes[i], codes[j])) for i, j in at if i != j]


def test_labels_of_pairs_inside_and_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(labelling, "LINK_BLOCK", 20)
    rng = np.random.default_rng(11)
    fields, pairs = [], []
    for raster, far in ((0, 20), (1, 70), (2, 20), (3, 70)):
        codes, links = _links(rng, raster, 60, far)
        fields += [(raster, c) for c in codes]
        pairs += links
    got = labelling.merge_labels(
        spark.createDataFrame(fields, "r long, comp long"), spark.createDataFrame(pairs, "r long, a long, b long"), ["r"]).collect()
    label = {f: f[1] for f in fields}
    changed = True
    while changed:
        changed = False
        for r, a, b in pairs:
            low = min(label[r, a], label[r, b])
            if label[r, a] != low or label[r, b] != low:
                label[r, a] = label[r, b] = low
                changed = True
    assert sorted(map(tuple, got)) == sorted((r, c, v) for (r, c), v in label.items())


def test_small_rasters_take_no_rounds_on_the_whole_graph(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("rounds on the whole graph")

    monkeypatch.setattr(labelling, "with_components", refused)
    cells = spark.range(3 * 40 * 40).select(F.floor(F.col("id") / 1600).alias("raster_id"), F.floor(F.col("id") % 1600 / 40).alias("y"), (F.col("id") % 40).alias("x"))
    runs = labelling.label_fields(cells, ["raster_id"], 8).cache()
    assert {tuple(r) for r in labelling.stitched(runs, ["raster_id"], 8).select("raster_id", "label").distinct().collect()} == {(0, 0), (1, 0), (2, 0)}


def _grown(spark):
    """A ragged field over many tiles of side 5 in a raster of 24 cells."""
    rng = np.random.default_rng(5)
    rows = [(0, int(y), int(x), int(v)) for (y, x), v in np.ndenumerate((rng.random((24, 24)) < 0.7).astype(int))]
    return spark.createDataFrame(rows, "r long, y int, x int, cls int")


def test_merged_rings_of_a_small_raster_are_not_joined_piece_by_piece(spark, monkeypatch):
    cells = _grown(spark)
    pixel = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)

    def made():
        found = flows.field_polygons(cells, ["r"], 5, pixel, min_size=3, merge_ratio=0.0).collect()
        return sorted((r["id"], r["area"], r["perimeter"], len(r["exterior"]), sorted(map(len, r["interiors"]))) for r in found)

    with monkeypatch.context() as m:
        m.setattr(labelling, "BLOCK", 1)
        want = made()

    def refused(*_):
        raise AssertionError("rings joined piece by piece")

    monkeypatch.setattr(boundary, "_joined", refused)
    assert made() == want and sum(a for _, a, *_ in want) > 200


def test_parts_are_outlined_for_their_size_only_where_that_differs(spark, monkeypatch):
    calls = []
    traced = outlines.field_polygons
    monkeypatch.setattr(outlines, "field_polygons", lambda *a, **k: calls.append(1) or traced(*a, **k))
    cells = _grown(spark)
    pixel = (2.0, 0.0, 0.0, 0.0, -3.0, 0.0)
    plain = flows.field_polygons(cells, ["r"], 5, pixel, min_size=18, merge_ratio=0.0).collect()
    assert not calls
    moved = flows.field_polygons(cells, ["r"], 5, pixel, min_size=18, merge_ratio=0.0, hook=lambda x, y: (x + 0.0, y + 0.0)).collect()
    assert calls
    assert sorted((r["id"], r["area"]) for r in plain) == sorted((r["id"], r["area"]) for r in moved)


def test_sides_that_cancel_in_their_block_are_not_summed_over_the_table(spark, monkeypatch):
    cells = _grown(spark).filter("cls = 1").select("r", "y", "x")
    runs = labelling.stitched(labelling.label_fields(cells, ["r"], 4), ["r"], 4)
    boxes = boundary.run_boxes(runs, ["r"], "label").cache()
    want = sorted(map(tuple, boundary.boundary_sides(boxes, ["r"], "label").collect()))
    for tile in (4.0, 12.0, 64.0):
        assert sorted(map(tuple, boundary.boundary_sides_in_blocks(boxes, ["r"], "label", tile).collect())) == want
    summed = []
    whole = boundary._left_over
    monkeypatch.setattr(boundary, "_left_over", lambda e, *a: summed.append(e.count()) or whole(e, *a))
    boundary.boundary_sides_in_blocks(boxes, ["r"], "label", 64.0).collect()
    boundary.boundary_sides(boxes, ["r"], "label").collect()
    assert 5 * summed[0] < summed[1]
