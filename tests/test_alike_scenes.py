"""Copies of scenes and windows meet once; results are those of all candidates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from furrow.functions import rings
from furrow.operators import scenes as S

COPIES = 40


@pytest.fixture()
def tables(spark):
    """Two areas in many copies; scenes in many copies with different clouds and tiles, some without a footprint."""
    areas = spark.range(2 * COPIES).select(
        F.col("id").alias("aoi_id"), *[(F.col("id") % 2 * 0.5 + v).alias(n) for n, v in {"x0": 10.0, "y0": 20.0, "x1": 10.4, "y1": 20.4}.items()],
        F.lit(2020).alias("year"), F.lit(100).alias("sday"), F.lit(200).alias("eday"))
    k = F.col("id")
    shift = k % 3 * 0.3
    scenes = spark.range(6 * COPIES).select(
        k.alias("scene_id"), F.lit(dt.datetime(2020, 4, 9, 10, 20, 30)).alias("dt"), (k * 7 % 25).cast("double").alias("cloud"),
        F.when(k % 5 == 0, "Unknown").otherwise(F.concat(F.lit("T"), (k % 2).cast("string"))).alias("tile"),
        *[(shift + v).alias(n) for n, v in {"x0": 9.0, "y0": 19.0, "x1": 10.6, "y1": 20.6}.items()])
    ring = rings.box_ring(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    return S.season_windows(areas), scenes.withColumn("footprint", F.when(F.col("scene_id") % 6 != 5, ring))


def test_answers_are_those_of_all_candidates(spark, tables):
    windows, scenes = tables
    found = S.candidate_scenes(windows, scenes)
    boxes = windows.crossJoin(scenes.select("scene_id", "dt", "cloud", *[F.col(c).alias("s" + c) for c in ("x0", "y0", "x1", "y1")]))
    plain = boxes.filter("cloud < 20 AND sx0 <= x1 AND sx1 >= x0 AND sy0 <= y1 AND sy1 >= y0 AND dt BETWEEN from_ts AND to_ts")
    keys = ["aoi_id", "win", "scene_id"]
    assert sorted(found.select(keys).collect()) == sorted(plain.select(keys).collect())
    for limit in (50, 10, None):
        one = S.best_scene(windows, found, limit).orderBy("aoi_id", "win").collect()
        assert one == S.best_scene(windows, S.candidate_scenes(windows, scenes, measure=True), limit).orderBy("aoi_id", "win").collect()
        assert one == S.best_scenes(windows, scenes, nodata_max=limit).orderBy("aoi_id", "win").collect()
    assert {r["status"] for r in one} == {"ok", "no_scene"}


def test_copies_meet_once(spark, tables, monkeypatch):
    windows, scenes = tables
    made = []
    real = S._meetings
    monkeypatch.setattr(S, "_meetings", lambda *a: made.append(real(*a)) or made[-1])
    S.best_scenes(windows, scenes)
    S.candidate_scenes(windows, scenes)
    # 2 places in window a, 3 boxes with a footprint or without
    assert [m.count() <= 12 for m in made] == [True, True]
