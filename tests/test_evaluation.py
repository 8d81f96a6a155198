"""Metrics, bootstrap, losses, suppression and sampling on small cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import evaluation as E
from furrow.operators import losses as L
from furrow.operators import patches, sampling, scoring

KEY = ["chip"]


def pixels(spark, label, pred, chip=1):
    rows = [(chip, y, x, int(label[y][x]), int(pred[y][x])) for y in range(len(label)) for x in range(len(label[0]))]
    return spark.createDataFrame(rows, "chip int, y int, x int, cls int, pred int")


def test_all_labels_ignored(spark):
    p = pixels(spark, [[3, 3], [3, 3]], [[1, 0], [0, 1]])
    m = E.metrics_from_counts(E.chip_stats(p, KEY)).first()
    assert m["pixel_iou"] == 0 and m["o_fp"] == 2 and math.isnan(m["object_f1"])


def test_half_overlap_is_not_a_match(spark):
    p = pixels(spark, [[1, 1, 1, 0]], [[1, 1, 1, 1]])
    assert E.chip_stats(p, KEY).first()["o_tp"] == 1
    q = pixels(spark, [[1, 1, 0, 0]], [[1, 1, 1, 1]])
    s = E.chip_stats(q, KEY).first()
    assert (s["o_tp"], s["o_fp"], s["o_fn"]) == (0, 1, 1)
    with pytest.raises(ValueError):
        E.chip_stats(q, KEY, iou_threshold=0.4)


def test_bootstraps_agree(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(int, rng.integers(20, 60, 6))) for i in range(80)]
    stats = spark.createDataFrame(rows, "chip long, " + ", ".join(f"{c} long" for c in E.COUNTS))
    a = {r["metric"]: r for r in E.bootstrap_by_draws(stats, "chip", 400).collect()}
    b = {r["metric"]: r for r in E.bootstrap_by_blocks(stats, "chip", 400, blocks=7).collect()}
    point = E.metrics_from_counts(stats.agg(*E.sum_counts())).first()
    for m in E.METRICS:
        assert a[m]["lower"] < point[m] < a[m]["upper"]
        assert b[m]["lower"] == pytest.approx(a[m]["lower"], abs=0.01)
        assert b[m]["upper"] == pytest.approx(a[m]["upper"], abs=0.01)


def test_block_bootstrap_depends_on_rows_and_seed_alone(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(int, rng.integers(0, 60, 6))) for i in range(60)]
    stats = spark.createDataFrame(rows, "chip long, " + ", ".join(f"{c} long" for c in E.COUNTS))
    results = [sorted(map(tuple, E.bootstrap_by_blocks(stats.repartition(n), "chip", 50).collect())) for n in (1, 3, 7)]
    assert results[0] == results[1] == results[2]


def test_objects_that_cross_tiles_are_one(spark):
    grid = np.zeros((12, 30), int)
    grid[2:9, 1:28] = 1
    s = E.chip_stats(pixels(spark, grid, grid), KEY, stride=4).first()
    assert (s["o_tp"], s["o_fp"], s["o_fn"]) == (1, 0, 0)


def test_sparse_tiles_keep_their_places(spark):
    from furrow.sources import rasters

    cells = [(1, y, x, 10 * y + x) for y, x in [(2, 3), (2, 5), (3, 3), (3, 4), (3, 5), (9, 17), (11, 16)]]
    packed = rasters.pack_tiles(spark.createDataFrame(cells, "r int, y int, x int, v int"), ["r"], "v", 8)
    got = sorted((r["r"], r["y"], r["x"], r["v"]) for r in rasters.unpack_tiles(packed, 8).collect())
    assert got == sorted(cells)


def test_suppression_pairs_stay_inside_patches(spark):
    from furrow.operators import spatial

    rows = [(p * 10 + i, p, float(i), 0.0, float(i) + 5, 5.0) for p in range(6) for i in range(4)]
    boxes = spark.createDataFrame(rows, "id long, patch long, x0 double, y0 double, x1 double, y1 double")
    pairs = spatial.intersecting_pairs(boxes, keys=["patch"]).collect()
    assert len(pairs) == 6 * 6 and all(r["a_id"] // 10 == r["b_id"] // 10 for r in pairs)


def test_masked_loss_without_labels_is_zero(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 0.0], 3)], "b int, logits array<double>, cls int")
    sums = L.overlap_sums(L.scored(df, 3), "b", 3, mode="flatten")
    assert sums.select(L.masked(L.jaccard(3)).alias("v")).first()["v"] == 0
    w = E.class_weights(df, "b", 3).first()["class_weights"]
    assert w == [1e-5] * 3


def test_perfect_scores_cost_nothing(spark):
    df = spark.createDataFrame([(1, [60.0, 0.0, 0.0], 0), (1, [0.0, 60.0, 0.0], 1)], "b int, logits array<double>, cls int")
    s = L.scored(df, 3)
    sums = L.overlap_sums(s, "b", 3)
    for loss in (L.dice(3), L.jaccard(3), L.tversky(3), L.log_cosh_dice(3), L.tversky_focal(3)):
        assert sums.select(loss.alias("v")).first()["v"] == pytest.approx(0, abs=1e-9)
    assert L.cross_entropy_sums(s, "b", 3).first()["ce"] == pytest.approx(0, abs=1e-9)


def greedy(rows, iou_max):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[0])):
        ok = True
        for k in kept:
            if k[1] != r[1]:
                continue
            w = max(0, min(k[4], r[4]) - max(k[2], r[2]))
            h = max(0, min(k[5], r[5]) - max(k[3], r[3]))
            a = (k[4] - k[2]) * (k[5] - k[3]) + (r[4] - r[2]) * (r[5] - r[3]) - w * h
            ok &= w * h <= iou_max * a
        if ok:
            kept.append(r)
    return {r[0] for r in kept}


def test_suppression_equals_greedy(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(300):
        x, y = rng.integers(0, 30, 2)
        w, h = rng.integers(3, 12, 2)
        rows.append((i, int(rng.integers(0, 3)), float(x), float(y), float(x + w), float(y + h), float(rng.integers(0, 50)) / 50))
    rows += [(1000 + i, 0, 1.0, 1.0, 9.0, 9.0, 0.5) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, patch_id int, x0 double, y0 double, x1 double, y1 double, conf double")
    got = {r["id"] for r in scoring.non_maximum_suppression(df, 0.3).collect()}
    assert got == greedy(rows, 0.3)


def test_subsample_sizes(spark):
    df = spark.range(97).select(F.col("id").alias("aoi_id"), F.lit("train").alias("split"))
    assert sampling.subsample(df, ["aoi_id"], percent=0.1).count() == 1
    assert sampling.subsample(df, ["aoi_id"], num_samples=500).count() == 97
    first = {r[0] for r in sampling.subsample(df, ["aoi_id"], num_samples=10).select("aoi_id").collect()}
    again = {r[0] for r in sampling.subsample(df.repartition(9), ["aoi_id"], num_samples=10).select("aoi_id").collect()}
    assert first == again and len(first) == 10


def test_impossible_overlaps():
    for side, overlap in ((8, 8), (8, 0), (8, 3)):
        with pytest.raises(ValueError):
            patches.check_overlap(side, overlap)


def test_rotation_by_a_quarter_turn():
    img = np.arange(16.0).reshape(1, 4, 4)
    turned = sampling.rotate(img, 90)
    assert np.allclose(turned, np.rot90(img[0])[None], atol=1e-9) or np.allclose(turned, np.rot90(img[0], -1)[None], atol=1e-9)


def test_stitching_covers_the_raster(spark):
    r = spark.createDataFrame([(1, 300, 260)], "raster_id int, height int, width int")
    t = patches.trimmed(patches.patch_grid(r, F.lit(128), F.lit(8))).collect()
    seen = np.zeros((300, 260), dtype=int)
    for p in t:
        seen[p["dst_top"]:p["dst_bottom"], p["dst_left"]:p["dst_right"]] += 1
    assert seen.min() == 1
