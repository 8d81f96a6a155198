"""Sinks with a commit: footers, one document, and nothing left of tasks that fail."""

import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from furrow.functions import rings
from furrow.sinks import geo, writers


def polygons(spark, n=20):
    rows = spark.range(n).repartition(3).select(
        "id", rings.box_ring(F.col("id") * 10.0, F.lit(0.0), F.col("id") * 10.0 + 5, F.lit(7.0)).alias("exterior"))
    return rows.withColumns({"interiors": F.slice(F.array("exterior"), 1, 0), "area": F.lit(35.0), "perimeter": F.lit(24.0)})


def parts(path):
    return sorted(f for f in os.listdir(path) if not f.endswith(".crc"))


def test_footer_and_bounds(spark, tmp_path):
    path = str(tmp_path / "fields")
    writers.write_fields(writers.field_table(polygons(spark)), path, srid=32633)
    names = parts(path)
    assert names and all(n.startswith("part-") for n in names)
    boxes = []
    for name in names:
        meta = json.loads(pq.read_metadata(f"{path}/{name}").metadata[b"geo"])
        column = meta["columns"]["geometry"]
        assert meta["version"] == "1.1.0" and column["encoding"] == "WKB" and column["crs"]["id"]["code"] == 32633
        boxes.append(column["bbox"])
    assert min(b[0] for b in boxes) == 0 and max(b[2] for b in boxes) == 195 and {b[3] for b in boxes} == {7.0}
    back = spark.read.parquet(path).select("id", writers.wkb_polygon("geometry").alias("g")).select("id", rings.ring_area(F.col("g.exterior")).alias("a"))
    assert sorted((int(r["id"]), r["a"]) for r in back.collect()) == [(i, 35.0) for i in range(20)]


def test_existing_output_is_kept_or_replaced(spark, tmp_path):
    path = str(tmp_path / "fields")
    for n, overwrite, want in ((5, False, 5), (8, False, 5), (8, True, 8), (0, True, 0)):
        writers.write_fields(writers.field_table(polygons(spark, n)), path, overwrite=overwrite)
        held = parts(path)
        assert (spark.read.parquet(path).count() if held else 0) == want


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "fields")
    bad = polygons(spark).withColumn("id", F.when(F.col("id") == 13, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="stop"):
        writers.write_fields(writers.field_table(bad), path)
    assert not os.path.exists(path) or parts(path) == []
    writers.write_fields(writers.field_table(polygons(spark)), path, overwrite=True)
    with pytest.raises(Exception, match="stop"):
        writers.write_fields(writers.field_table(bad), path, overwrite=True)
    assert spark.read.parquet(path).count() == 20


def test_parts_that_were_not_reported_never_show(tmp_path):
    writer = geo.GeoJsonWriter({"path": str(tmp_path)}, True)
    import pyarrow as pa

    first = writer.write(iter([pa.record_batch({"value": ['{"a":1}', '{"a":2}']})]))
    writer.write(iter([pa.record_batch({"value": ['{"a":3}']})]))  # a second try whose report is lost
    empty = writer.write(iter([]))
    writer.commit([first, None, empty])
    assert os.listdir(tmp_path) == ["fields.geojson"]
    assert json.loads((tmp_path / "fields.geojson").read_text())["features"] == [{"a": 1}, {"a": 2}]


def test_one_document_in_degrees(spark, tmp_path):
    path = str(tmp_path / "doc")
    moved = writers.reproject(polygons(spark), lambda x, y: (x / 1000, y / 1000))
    writers.write_geojson(writers.field_features(moved), path)
    made = json.loads((tmp_path / "doc" / "fields.geojson").read_text())
    assert made["type"] == "FeatureCollection" and len(made["features"]) == 20
    one = next(f for f in made["features"] if f["properties"]["id"] == "3")
    assert one["geometry"]["coordinates"][0][0] == [0.03, 0.0] and one["properties"]["metrics:area"] == 35.0


def test_holes_of_different_lengths(spark, tmp_path):
    def ring(*points):
        return [tuple(map(float, p)) for p in [*points, points[0]]]

    rows = [(1, ring((0, 0), (30, 0), (30, 30), (0, 30)), [ring((1, 1), (2, 1), (1, 2)), ring((5, 5), (8, 5), (8, 8), (5, 8)), ring((20, 20), (22, 20), (23, 21), (22, 23), (20, 22))], 1.0, 2.0)]
    schema = "id long, exterior array<struct<x: double, y: double>>, interiors array<array<struct<x: double, y: double>>>, area double, perimeter double"
    made = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "fields")
    writers.write_fields(writers.field_table(made), path)
    back = spark.read.parquet(path).select(writers.wkb_polygon("geometry").alias("g")).select("g.*").first()
    assert back["exterior"] == made.first()["exterior"] and back["interiors"] == made.first()["interiors"]

    from furrow.operators import outlines

    thin = outlines.simplify(made, 0.1).first()
    assert [len(r) for r in thin["interiors"]] == [4, 5, 6]
