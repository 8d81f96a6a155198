"""Sinks. Each writes a Spark table; existing output is skipped, replaced or refused by mode."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions import rings
from furrow.functions.text import normalise_time_tag
from furrow.sinks import geo

METHOD = "auto-imagery"


def save_mode(overwrite: bool, strict: bool = False) -> str:
    """Existing output: replaced when asked, else skipped (or refused when ``strict``)."""
    return "overwrite" if overwrite else ("errorifexists" if strict else "ignore")


@F.arrow_udf(T.BinaryType())
def polygon_wkb(exterior: pa.Array, interiors: pa.Array) -> pa.Array:
    """Rings -> well-known binary, little endian."""
    def flat(rings_: pa.Array) -> tuple[bytes, list[int]]:
        points = rings_.flatten()
        pairs = np.stack([pc.struct_field(points, c).to_numpy(zero_copy_only=False).astype("<f8") for c in ("x", "y")], 1)
        return pairs.tobytes(), rings_.value_lengths().fill_null(0).to_pylist()

    outer, inner = flat(exterior), flat(interiors.flatten())
    made, at, ring, hole = [], 0, 0, 0
    for n, holes in zip(outer[1], interiors.value_lengths().fill_null(0).to_pylist(), strict=True):
        body = [struct.pack("<BIII", 1, 3, 1 + holes, n), outer[0][at:at + 16 * n]]
        at += 16 * n
        for k in inner[1][ring:ring + holes]:
            body += [struct.pack("<I", k), inner[0][hole:hole + 16 * k]]
            hole += 16 * k
        ring += holes
        made.append(b"".join(body))
    return pa.array(made, pa.binary())


def field_table(polygons: DataFrame, time_tag: Column | None = None) -> DataFrame:
    """Columns of the field-boundary output; the time column only when a tag is given."""
    out = polygons.select(
        F.col("id").cast("string").alias("id"),
        polygon_wkb("exterior", "interiors").alias("geometry"),
        F.col("area").cast("float").alias("metrics:area"),
        F.col("perimeter").cast("float").alias("metrics:perimeter"),
        F.lit(METHOD).alias("determination:method"),
        *([] if time_tag is None else [normalise_time_tag(time_tag).alias("determination:datetime")]),
    )
    return out


_RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


@F.arrow_udf(T.StructType([T.StructField("exterior", _RING), T.StructField("interiors", T.ArrayType(_RING))]))
def wkb_polygon(geometry: pa.Array) -> pa.Array:
    """Well-known binary of a polygon -> rings."""
    sizes, holes, data = [], [], []
    for wkb in geometry.to_pylist():
        count, at = struct.unpack_from("<I", wkb, 5)[0], 9
        holes.append(count - 1)
        for _ in range(count):
            n = struct.unpack_from("<I", wkb, at)[0]
            sizes.append(n)
            data.append(wkb[at + 4:at + 4 + 16 * n])
            at += 4 + 16 * n
    pairs = np.frombuffer(b"".join(data), "<f8").reshape(-1, 2)
    points = pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["x", "y"])
    each = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), points)
    bounds = np.concatenate(([0], np.cumsum(holes))).astype(np.int64)
    first = bounds[:-1] + np.arange(len(holes))
    rest = np.setdiff1d(np.arange(len(sizes)), first)
    inner = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), each.take(pa.array(rest, pa.int64())))
    return pa.StructArray.from_arrays([each.take(pa.array(first, pa.int64())), inner], ["exterior", "interiors"])


def reproject(polygons: DataFrame, fn: rings.XY) -> DataFrame:
    """Rings in other coordinates (for example degrees, as GeoJSON wants them)."""
    return polygons.withColumns({
        "exterior": rings.map_ring(F.col("exterior"), fn), "interiors": F.transform("interiors", lambda r: rings.map_ring(r, fn))})


def write_fields(table: DataFrame, path: str, srid: int = 4326, overwrite: bool = False) -> None:
    """Field table as GeoParquet parts, each with its ``geo`` footer."""
    geo.save(table, geo.GeoParquet, path, overwrite, srid=str(srid))


def geojson_feature(exterior: Column, interiors: Column, properties: Column) -> Column:
    """One feature as JSON text."""
    def coords(ring: Column) -> Column:
        return F.transform(ring, lambda p: F.array(p["x"], p["y"]))

    geometry = F.struct(
        F.lit("Polygon").alias("type"),
        F.concat(F.array(coords(exterior)), F.transform(interiors, coords)).alias("coordinates"),
    )
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def write_ndjson(features: DataFrame, path: str, overwrite: bool = False) -> None:
    """One feature per line, in parallel files."""
    features.select("value").write.mode(save_mode(overwrite)).text(path)


def field_features(polygons: DataFrame) -> DataFrame:
    """Polygons -> ``value``: features with id, area and perimeter as JSON text."""
    properties = F.struct(
        F.col("id").cast("string").alias("id"), F.col("area").alias("metrics:area"), F.col("perimeter").alias("metrics:perimeter"))
    return polygons.select(geojson_feature(F.col("exterior"), F.col("interiors"), properties).alias("value"))


def write_geojson(features: DataFrame, path: str, overwrite: bool = False) -> None:
    """One FeatureCollection document in ``path``, a feature a line, so that ``sources.features.read_document`` can split it."""
    geo.save(features.select("value"), geo.GeoJson, path, overwrite)


def write_tiles(tiles: DataFrame, path: str, overwrite: bool = False, partition: str = "band") -> None:
    """Raster tiles, partitioned so a band scan prunes files (``raster_id`` would make one folder
    per raster)."""
    tiles.write.mode(save_mode(overwrite, strict=True)).partitionBy(partition).parquet(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").parquet(path)


def write_csv(rows: DataFrame, path: str, overwrite: bool = True) -> None:
    rows.write.mode(save_mode(overwrite)).option("header", True).csv(path)


def write_selection(selection: DataFrame, path: str, overwrite: bool = True) -> None:
    """``{"window_a": .., "window_b": ..}`` per area."""
    selection.select("aoi_id", "window_a", "window_b").write.mode(save_mode(overwrite)).json(path)


def append_missing(tiles: DataFrame, existing: DataFrame, key: str, path: str) -> None:
    """Append only what the table does not hold yet."""
    tiles.join(existing.select(key).distinct(), key, "left_anti").write.mode("append").parquet(path)
