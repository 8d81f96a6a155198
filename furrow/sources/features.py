"""Feature documents (GeoJSON features as text) as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def feature_columns(features: DataFrame, properties: dict[str, str], column: str = "value") -> DataFrame:
    """One column per property, named and typed by ``properties``; what a feature lacks, or holds as another type, is null.

    A text that is no JSON gives a row of nulls.
    """
    def read(name: str, kind: str) -> Column:
        return F.try_variant_get("_feature", f'$.properties["{name}"]', kind).alias(name)

    return features.select(F.try_parse_json(column).alias("_feature")).select(*[read(n, k) for n, k in properties.items()])


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Column ``f``: the features of FeatureCollections that hold one feature a line, as ``write_geojson`` lays them out.

    Lines can be dealt to any number of tasks. A line that is no feature and no part of the frame is an error, so
    a document laid out otherwise is refused and nothing of it is left out.
    """
    line = F.rtrim(F.regexp_replace("value", r",\s*$", ""))
    kind = F.get_json_object(line, "$.type")
    text = spark.read.option("lineSep", "\n").text(path).filter(F.trim("value") != "")
    framed = line.startswith('{"type":"FeatureCollection"') & line.endswith("[") | (line == "]}")
    feature = F.when(kind == "Feature", F.from_json(line, schema)).when(
        ~framed, F.raise_error(F.concat(F.lit("no feature a line: "), F.substring(line, 1, 80))).cast(schema))
    return text.select(feature.alias("f")).filter("f IS NOT NULL")
