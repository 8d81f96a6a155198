"""Sides that end in an explode are larger than their size estimate: they are shuffled, never broadcast."""

from pyspark.sql import functions as F

from furrow.checks import bindings, shapes
from furrow.operators import unions
from furrow.operators.skew import bucket_join

SF = "/root/testdata/sf0.001"


def _broadcasts(df):
    """What lies between each broadcast and the joins or shuffles below it, before anything runs."""
    found, inside = [], False
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        if "BroadcastExchange" in line:
            found.append("")
            inside = True
        elif "Exchange" in line or "Join" in line:
            inside = False
        elif inside:
            found[-1] += line + "\n"
    return found


def test_bucket_join_broadcasts_no_side(spark):
    few = spark.range(20).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    left, right = few.withColumnRenamed("id", "l"), few.withColumnRenamed("id", "r")
    met = bucket_join(left, right, ["k"])
    assert all("_salt" not in b for b in _broadcasts(met))
    assert met.count() == 4000
    parted = bucket_join(left, right, ["k"], hot_rows=3)
    assert sorted(parted.collect()) == sorted(met.collect())


def test_cells_broadcast_no_grid(spark):
    inner = bindings.cells(spark, SF).filter("cls = 2 AND x > 0")  # makes the outer join an inner one
    assert _broadcasts(inner) == []


def test_polygon_pairs_broadcast_no_side(spark):
    assert all("_salt" not in b for b in _broadcasts(shapes.polygon_overlap(spark, SF)))


def test_union_broadcasts_no_runs(spark, monkeypatch):
    seen = []
    real = unions.scanline.merged_runs
    monkeypatch.setattr(unions.scanline, "merged_runs", lambda runs, key: seen.append(runs) or real(runs, key))
    polygons = bindings.shapes(spark, SF)
    unions.union_components(polygons, polygons.select("id", F.col("id").alias("comp")), 2.0)
    assert _broadcasts(seen[0]) == []
