"""Scene selection, dates, countries and sample assembly: cases with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from furrow.constants import ALL_COUNTRIES, FULL_DATA_COUNTRIES
from furrow.functions import footprints, rings, text
from furrow.operators import scenes as S
from furrow.sources import samples as C


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def pct(spark, foot, box):
    ring = rings.box_ring(*map(F.lit, foot)) if foot else F.lit(None).cast("array<struct<x:double,y:double>>")
    return one(spark, S.nodata_percent(S.projected(footprints.single(ring)), *[F.lit(float(v)) for v in box]))


def test_nodata_percent(spark):
    assert pct(spark, (10.0, 47.0, 11.0, 48.0), (10.2, 47.2, 10.8, 47.8)) < 1
    assert 40 <= pct(spark, (10.0, 47.0, 10.5, 48.0), (10, 47, 11, 48)) <= 60
    assert pct(spark, (10.0, 47.0, 11.0, 48.0), (20, 50, 21, 51)) > 99
    assert pct(spark, None, (10, 47, 11, 48)) == 100
    with pytest.raises(Exception, match="zero area"):
        pct(spark, (10.0, 47.0, 11.0, 48.0), (10, 47, 10, 48))


def test_day_of_year(spark):
    assert one(spark, text.day_of_year_date(F.lit(2023), F.lit(100))) == dt.date(2023, 4, 10)


def test_scene_url_month_without_zero(spark):
    url = one(spark, text.scene_url(F.lit("S2B_33UUP_20210925_0_L2A")))
    assert url.endswith("/33/U/UP/2021/9/S2B_33UUP_20210925_0_L2A/S2B_33UUP_20210925_0_L2A.json")


def test_circular_mean_crosses_the_year_end(spark):
    days = spark.createDataFrame([(d,) for d in (360, 364, 2, 6)], "d int")
    assert days.agg(S.circular_mean_day(F.col("d")).alias("m")).first()["m"] in (1, 365)


def test_country_expansion():
    assert C.expand_countries(["full_data"]) == FULL_DATA_COUNTRIES and len(FULL_DATA_COUNTRIES) == 21
    mixed = ["rwanda", "full_data", "kenya"]
    assert C.expand_countries(mixed) == FULL_DATA_COUNTRIES and mixed == ["rwanda", "full_data", "kenya"]
    assert C.expand_countries(["rwanda", "kenya", "belgium"]) == ["rwanda", "kenya", "belgium"]
    assert C.expand_countries(["all"]) == ALL_COUNTRIES


AOI = "aoi_id long, x0 double, y0 double, x1 double, y1 double, year int, sday int, eday int"
SCENE = "scene_id string, dt timestamp, cloud double, tile string, x0 double, y0 double, x1 double, y1 double"


def select(spark, aois, scenes, **kw):
    s = spark.createDataFrame(scenes, SCENE)
    s = s.withColumn("footprint", rings.box_ring(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    return {r["aoi_id"]: r for r in S.scene_selection(spark.createDataFrame(aois, AOI), s, **kw).collect()}


def scene(name, day, cloud, tile="T1", box=(0.0, 0.0, 2.0, 2.0)):
    return (name, dt.datetime.fromisoformat(day), cloud, tile, *box)


def test_selection_statuses_and_ties(spark):
    aois = [(1, 0.5, 0.5, 1.0, 1.0, 2020, 100, 200), (2, 1.9, 1.9, 2.9, 2.9, 2020, 100, 200),
            (3, 50.0, 50.0, 51.0, 51.0, 2020, 100, 200), (4, 0.1, 0.1, 1.9, 1.9, 2090, 100, 200)]
    got = select(spark, aois, [
        scene("b", "2020-04-09", 5.0), scene("a", "2020-04-20", 5.0), scene("c", "2020-04-09", 20.0),
        scene("d", "2020-07-18", 3.0), scene("late", "2020-05-01", 0.0), scene("edge", "2020-08-01 23:59:59", 1.0)])
    assert (got[1]["window_a"], got[1]["window_b"]) == ("a", "edge")
    assert (got[2]["status_a"], got[3]["status_a"], got[4]["status_a"]) == ("nodata", "no_scene", "future")


def test_wide_area_over_several_tiles(spark):
    big = (0.0, 0.0, 3.0, 3.0)
    got = select(spark, [(1, *big, 2020, 100, 200)], [
        scene("a", "2020-04-09", 1.0, "T1", big), scene("b", "2020-04-09", 2.0, "T2", big), scene("c", "2020-07-18", 2.0, "T2", big)])
    assert (got[1]["status_a"], got[1]["status_b"]) == ("multi_tile", "ok")


def test_only_the_asked_mask_is_needed(spark):
    chips = spark.createDataFrame([("rwanda", "a", "train")], "country string, aoi_id string, split string")
    files = spark.createDataFrame(
        [("rwanda", "a", k, f"p/{k}") for k in ("window_a", "window_b", "semantic_2class")],
        "country string, aoi_id string, kind string, path string")
    assert C.assemble(chips, files).count() == 1
    assert C.assemble(chips, files, boundaries=True).count() == 0
    with pytest.raises(Exception, match="missing edge file"):
        C.assemble(chips, files, edges=True).collect()


def test_reading_a_dataset_folder(spark, tmp_path):
    import pandas as pd

    for country in ("rwanda", "kenya"):
        root = tmp_path / country
        for kind in ("s2_images/window_a", "s2_images/window_b", "label_masks/semantic_2class"):
            (root / kind).mkdir(parents=True)
            (root / kind / "a1.tif").write_bytes(b"x")
        pd.DataFrame({"aoi_id": ["a1", "a2"], "split": ["train", "test"]}).to_parquet(root / f"chips_{country}.parquet")
    chips = C.read_chips(spark, str(tmp_path))
    ready = C.assemble(C.of_split(chips, "train"), C.read_inventory(spark, str(tmp_path)))
    assert sorted((r["country"], r["aoi_id"]) for r in ready.collect()) == [("kenya", "a1"), ("rwanda", "a1")]
    assert C.file_hashes(spark, str(tmp_path / "rwanda" / "s2_images")).select("md5").distinct().count() == 1


def test_bad_split_is_refused(spark):
    with pytest.raises(ValueError):
        C.of_split(spark.range(1), "dev")
