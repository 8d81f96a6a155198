"""One GeoJSON document read by many tasks."""

import pytest
from pyspark.sql import functions as F

from furrow.functions import rings
from furrow.sinks import writers
from furrow.sources import features

SCHEMA = "struct<geometry: struct<coordinates: array<array<array<double>>>>, properties: struct<id: string>>"
ODD = 'a,\r\n\u2028"b" ]} '


def written(spark, path, n):
    rows = spark.range(n).repartition(3).select(
        F.concat(F.lit(ODD), "id").alias("id"), rings.box_ring(F.col("id") * 1.0, F.lit(0.0), F.col("id") + 5.0, F.lit(7.0)).alias("exterior"))
    rows = rows.withColumns({"interiors": F.slice(F.array("exterior"), 1, 0), "area": F.lit(35.0), "perimeter": F.lit(24.0)})
    writers.write_geojson(writers.field_features(rows), path)


def test_a_document_is_dealt_to_many_tasks(spark, tmp_path):
    path = str(tmp_path / "doc")
    written(spark, path, 2000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 16))
    try:
        found = features.read_document(spark, path, SCHEMA)
        assert found.rdd.getNumPartitions() > 3
        made = {r["f"]["properties"]["id"]: r["f"]["geometry"]["coordinates"][0][0] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert made == {ODD + str(i): [float(i), 0.0] for i in range(2000)}


def test_an_empty_document_and_other_layouts(spark, tmp_path):
    written(spark, str(tmp_path / "empty"), 0)
    assert features.read_document(spark, str(tmp_path / "empty"), SCHEMA).count() == 0
    for i, text in enumerate(('{"type":"FeatureCollection","features":[{"type":"Feature"}]}\n', '{"type":"FeatureCollection","features":[\n{"type":\n"Feature"}\n]}\n')):
        (tmp_path / f"{i}.geojson").write_text(text)
        with pytest.raises(Exception, match="no feature a line"):
            features.read_document(spark, str(tmp_path / f"{i}.geojson"), SCHEMA).collect()
