"""Raster tables: tiles (stored form), cells (relational form), scene catalogues, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.constants import CROPLAND_CLASS
from furrow.functions import footprints, raster_math, rings
from furrow.functions.rings import XY
from furrow.operators.scenes import first_item

TILE_SIDE = 256

# A search result: a collection of items.
CATALOGUE_SCHEMA = (
    "type string, features array<struct<id:string, "
    "geometry:struct<type:string,coordinates:string>, bbox:array<double>, "
    "properties:struct<datetime:string,start_datetime:string,end_datetime:string,"
    "`eo:cloud_cover`:double,`grid:code`:string,`s2:mgrs_tile`:string,"
    "`processing:version`:string,`s2:processing_baseline`:string>>>"
)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Offline catalogue dump (item collections) with a fixed schema, one row per item."""
    return spark.read.schema(CATALOGUE_SCHEMA).json(path).select(F.explode("features").alias("item")).select("item.*")


def normalise_items(items: DataFrame) -> DataFrame:
    """Nested items -> scene rows. ``parts`` holds footprints of one or several parts; ``footprint`` is the first outer ring."""
    p = F.col("properties")
    items = items.withColumn("parts", footprints.from_geojson(F.col("geometry.type"), F.col("geometry.coordinates").cast("string")))
    return items.select(
        F.col("id").alias("scene_id"),
        F.coalesce(p["datetime"], p["start_datetime"], p["end_datetime"]).try_cast("timestamp").alias("dt"),
        F.coalesce(F.to_date(p["datetime"].try_cast("timestamp")).cast("string"), F.lit("Unknown date")).alias("date"),
        F.coalesce(F.when(p["grid:code"] != "", p["grid:code"]), p["s2:mgrs_tile"], F.lit("Unknown")).alias("tile"),
        p["eo:cloud_cover"].alias("cloud"),
        raster_math.processing_version(p["processing:version"], p["s2:processing_baseline"]).alias("version"),
        *[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(["x0", "y0", "x1", "y1"])],
        F.get("parts", F.lit(0))["exterior"].alias("footprint"), "parts",
    )


def pack_tiles(cells: DataFrame, keys: list[str], value: str, side: int = TILE_SIDE) -> DataFrame:
    """Cells -> one row per tile: its first cell ``y0, x0``, its size and row-major ``values``.

    Cells that are absent inside a tile are null. A tile has at most side^2 cells.
    """
    spot = F.struct(F.col("y"), F.col("x"), F.col(value).alias("v"))
    tile = cells.withColumns({"tile_y": F.floor(F.col("y") / side), "tile_x": F.floor(F.col("x") / side)})
    packed = tile.groupBy(*keys, "tile_y", "tile_x").agg(
        F.min("y").cast("int").alias("y0"), F.min("x").cast("int").alias("x0"),
        (F.max("y") - F.min("y") + 1).cast("int").alias("h"),
        (F.max("x") - F.min("x") + 1).cast("int").alias("w"),
        F.array_sort(F.collect_list(spot)).alias("_spots"),
    )
    at = F.transform("_spots", lambda s: ((s["y"] - F.col("y0")) * F.col("w") + s["x"] - F.col("x0")).cast("int"))
    packed = packed.withColumn("_at", at)
    absent = F.get(F.col("_spots"), F.lit(-1))["v"]  # null of the value's type
    gaps = F.transform("_spots", lambda s, i: F.concat(
        F.array_repeat(absent, F.col("_at")[i] - F.when(i > 0, F.col("_at")[F.greatest(i - 1, F.lit(0))]).otherwise(-1) - 1), F.array(s["v"])
    ))
    rest = F.array_repeat(absent, F.col("h") * F.col("w") - 1 - F.element_at("_at", -1))
    return packed.withColumn("values", F.concat(F.flatten(gaps), rest)).drop("_spots", "_at")


def unpack_tiles(tiles: DataFrame, side: int = TILE_SIDE, name: str = "v") -> DataFrame:
    """Tiles -> one row per cell that is not null, where it was before packing."""
    out = tiles.select("*", F.posexplode("values").alias("_i", name)).filter(F.col(name).isNotNull())
    return out.withColumns({
        "y": (F.col("y0") + F.floor(F.col("_i") / F.col("w"))).cast("int"),
        "x": (F.col("x0") + F.col("_i") % F.col("w")).cast("int"),
    }).drop("_i", "values", "h", "w", "y0", "x0", "tile_y", "tile_x")


def scan_bands(tiles: DataFrame, bands: list[int]) -> DataFrame:
    """Only these bands; on a table partitioned by band this prunes files."""
    return tiles.filter(F.col("band").isin(bands))


def clip_cells(cells: DataFrame, boxes: DataFrame, keys: list[str], affine: dict[str, Column], side: int = TILE_SIDE) -> DataFrame:
    """Cells whose centre lies in the raster's box (``bx0, by0, bx1, by1`` in map units).

    The box becomes a tile range first, so stored tiles outside it are never unpacked.
    """
    a = [affine[k] for k in "abcdef"]
    corners = [raster_math.map_to_pixel(*a, F.col(x), F.col(y)) for x in ("bx0", "bx1") for y in ("by0", "by1")]
    cols, rows = [c[0] for c in corners], [c[1] for c in corners]
    rng = boxes.withColumns({
        "px0": F.ceil(F.least(*cols) - 0.5), "px1": F.floor(F.greatest(*cols) - 0.5),
        "py0": F.ceil(F.least(*rows) - 0.5), "py1": F.floor(F.greatest(*rows) - 0.5),
    }).select(*keys, "px0", "px1", "py0", "py1")
    tiles = rng.filter((F.col("px1") >= F.col("px0")) & (F.col("py1") >= F.col("py0"))).withColumn(
        "_ty", F.explode(F.sequence(F.floor(F.col("py0") / side), F.floor(F.col("py1") / side)))
    ).withColumn("_tx", F.explode(F.sequence(F.floor(F.col("px0") / side), F.floor(F.col("px1") / side))))
    placed = cells.withColumns({"_ty": F.floor(F.col("y") / side), "_tx": F.floor(F.col("x") / side)})
    return placed.join(tiles, [*keys, "_ty", "_tx"]).filter(
        F.col("y").between(F.col("py0"), F.col("py1")) & F.col("x").between(F.col("px0"), F.col("px1"))
    ).drop("_ty", "_tx", "px0", "px1", "py0", "py1")


def scan_calendar(calendar: DataFrame, season: str = "summer") -> DataFrame:
    """Start and end days of one season."""
    return calendar.filter(F.col("season") == season).select("lon", "lat", "kind", "doy")


def scan_landcover(items: DataFrame, provider: str = "io-lulc-annual-v02") -> DataFrame:
    """First land-cover item per raster (newest first) of one provider, with its cropland class."""
    if provider not in CROPLAND_CLASS:
        raise ValueError(f"unknown land-cover product {provider!r}")
    chosen = items.filter(F.col("provider") == provider)
    newest = first_item(chosen.withColumn("_age", -F.unix_timestamp("dt")), ["raster_id"], [F.col("_age"), F.col("item_id")])
    return newest.drop("_age").withColumn("cropland", F.lit(CROPLAND_CLASS[provider]))


def align_landcover(cells: DataFrame, landcover: DataFrame, keys: list[str], scale_y: Column, scale_x: Column) -> DataFrame:
    """Nearest land-cover class of each cell: target index by arithmetic, then an equi-join."""
    lc = landcover.select(*keys, F.col("y").alias("_ly"), F.col("x").alias("_lx"), "lc")
    placed = cells.withColumns({
        "_ly": F.floor((F.col("y") + 0.5) * scale_y), "_lx": F.floor((F.col("x") + 0.5) * scale_x),
    })
    return placed.join(lc, [*keys, "_ly", "_lx"], "left").drop("_ly", "_lx")


def to_grid(affine: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """Map coordinates -> fractional column and row of the grid with this affine ``(a, b, c, d, e, f)``."""
    a, b, c, d, e, f = affine
    det = a * e - b * d
    return (e * (x - c) - b * (y - f)) / det, (a * (y - f) - d * (x - c)) / det


def align_tiles(tiles: DataFrame, source: DataFrame, keys: list[str], affine: list[Column], source_affine: list[Column],
                to_source: XY | None = None, side: int = TILE_SIDE, edge: int = 8, name: str = "aligned") -> DataFrame:
    """Nearest value of another raster for each cell of stored tiles, by affine and projection.

    ``tiles`` and ``source`` are as ``pack_tiles`` leaves them (``source`` with tiles of ``side``); the affines are
    columns of ``tiles``; ``to_source`` maps coordinates of the target system to the source's. The bounds of a target tile
    (``edge`` points a side, and a cell more all around) select the source tiles it can need; each cell is placed once and
    looked up in the one tile it falls in, so what is exchanged are tiles. Cells off the source are null. Adds the array ``name``.
    """
    a, b, c, d, e, f = affine

    def placed(x: Column, y: Column) -> Column:
        px, py = a * x + b * y + c, d * x + e * y + f
        sx, sy = to_grid(source_affine, *(to_source(px, py) if to_source else (px, py)))
        return F.struct(sx.alias("x"), sy.alias("y"))

    steps = F.sequence(F.lit(0), F.lit(edge))
    x0, y0 = F.col("x0").cast("double"), F.col("y0").cast("double")
    outline = F.flatten(F.transform(steps, lambda i: F.array(
        placed(x0 + F.col("w") * i / edge, y0), placed(x0 + F.col("w") * i / edge, y0 + F.col("h")),
        placed(x0, y0 + F.col("h") * i / edge), placed(x0 + F.col("w"), y0 + F.col("h") * i / edge))))
    own = tiles.withColumn("_b", outline)

    def span(axis: str) -> Column:
        seen = F.transform("_b", lambda p: p[axis])
        return F.sequence(F.floor((F.array_min(seen) - 1) / side), F.floor((F.array_max(seen) + 1) / side))

    def code(row: Column, column: Column) -> Column:
        return row.cast("bigint") * F.lit(1 << 32) + column

    asked = own.withColumn("_sy", F.explode(span("y"))).withColumn("_sx", F.explode(span("x"))).select(*keys, "tile_y", "tile_x", "_sy", "_sx")
    held = source.select(*keys, F.col("tile_y").alias("_sy"), F.col("tile_x").alias("_sx"), F.struct("y0", "x0", "h", "w", "values").alias("_s"))
    # a target tile meets the few source tiles under it
    under = asked.join(held, [*keys, "_sy", "_sx"]).groupBy(*keys, "tile_y", "tile_x").agg(
        F.map_from_entries(F.collect_list(F.struct(code(F.col("_sy"), F.col("_sx")), "_s"))).alias("_under"))

    def inside(s: Column, row: Column, column: Column) -> Column:
        r, q = row - s["y0"], column - s["x0"]
        return F.when((r >= 0) & (r < s["h"]) & (q >= 0) & (q < s["w"]), F.get(s["values"], (r * s["w"] + q).cast("int")))

    def looked_up(i: Column) -> Column:
        at = placed(x0 + i % F.col("w") + 0.5, y0 + F.floor(i / F.col("w")) + 0.5)
        cell = rings.let(at, lambda p: F.struct(F.floor(p["y"]).alias("r"), F.floor(p["x"]).alias("q")))
        return rings.let(cell, lambda k: rings.let(
            F.try_element_at("_under", code(F.floor(k["r"] / side), F.floor(k["q"] / side))), lambda s: inside(s, k["r"], k["q"])))

    cells = F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), looked_up)
    joined = tiles.join(under, [*keys, "tile_y", "tile_x"], "left")
    return joined.withColumn(name, F.when(F.col("_under").isNotNull(), cells)).drop("_under")


def mask_cropland(aligned: DataFrame, cropland: Column, value: str = "cls") -> DataFrame:
    """Zero what is not cropland; ``cropland_mask`` keeps the predicate for its own sink."""
    is_crop = F.coalesce(F.col("lc") == cropland, F.lit(False))
    return aligned.withColumn("cropland_mask", is_crop.cast("int")).withColumn(
        value, F.when(is_crop, F.col(value)).otherwise(0)
    )
