"""String, date and identifier rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.constants import SCENE_PREFIX, SCENE_STORE

# Fixed value: accepted acquisition time tags.
TIME_TAG = r"^(\d{4})[:-](\d{2})[:-](\d{2})[T\s](\d{2}):(\d{2}):(\d{2}).*$"


def day_of_year_date(year: Column, day: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (day - 1).cast("int"))


def season_end_year(year: Column, start_day: Column, end_day: Column) -> Column:
    """A season that ends before it starts runs into the next year."""
    return F.when(end_day < start_day, year + 1).otherwise(year)


def rfc3339_range(day: Column, buffer_days: int) -> Column:
    return F.concat(
        F.date_format(F.date_sub(day, buffer_days), "yyyy-MM-dd"), F.lit("T00:00:00Z/"),
        F.date_format(F.date_add(day, buffer_days), "yyyy-MM-dd"), F.lit("T23:59:59Z"),
    )


def normalise_time_tag(tag: Column) -> Column:
    """Acquisition tag -> ISO time with ``Z``; null when it does not parse."""
    return F.when(tag.rlike(TIME_TAG), F.regexp_replace(tag, TIME_TAG, "$1-$2-$3T$4:$5:$6Z"))


def scene_url(scene: Column) -> Column:
    """Scene id, object-store URI or URL -> metadata URL."""
    path = F.regexp_replace(F.regexp_replace(scene, "^s3://[^/]*/", ""), "/+$", "")
    from_uri = F.concat(
        F.lit(SCENE_STORE + "/"), path, F.lit("/"), F.element_at(F.split(path, "/"), -1), F.lit(".json")
    )
    tile = F.get(F.split(scene, "_"), F.lit(1))
    day = F.get(F.split(scene, "_"), F.lit(2))
    from_id = F.concat_ws(
        "/",
        F.lit(SCENE_STORE), F.lit(SCENE_PREFIX),
        F.substring(tile, 1, 2), F.substring(tile, 3, 1), F.substr(tile, F.lit(4)),
        F.substring(day, 1, 4), F.substring(day, 5, 2).try_cast("int").cast("string"),
        scene, F.concat(scene, F.lit(".json")),
    )
    return (
        F.when(F.contains(scene, F.lit("s3://")), from_uri)
        .when(~F.contains(scene, F.lit("/")), from_id)
        .otherwise(scene)
    )


def catalogue_url(scene: Column, root: str, collection: str) -> Column:
    """Bare id -> item URL of a catalogue host; URLs pass through."""
    return F.when(
        ~F.contains(scene, F.lit("/")),
        F.concat(F.lit(f"{root}/collections/{collection}/items/"), scene),
    ).otherwise(scene)


def parse_bbox(text: Column) -> Column:
    """``minx,miny,maxx,maxy`` -> struct; null unless it has exactly four numbers."""
    parts = F.transform(F.split(text, ","), lambda s: F.trim(s).try_cast("double"))
    ok = (F.size(parts) == 4) & ~F.exists(parts, lambda v: v.isNull())
    names = ["xmin", "ymin", "xmax", "ymax"]
    return F.when(ok, F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]))


def result_key(path: Column) -> Column:
    return F.replace(F.replace(path, F.lit("/"), F.lit("_")), F.lit(".ckpt"), F.lit(""))


def edge_path(mask_path: Column) -> Column:
    return F.replace(mask_path, F.lit("semantic_3class"), F.lit("edges"))


def country_list(text: Column) -> Column:
    return F.filter(
        F.transform(F.split(F.lower(text), ","), lambda s: F.trim(s)), lambda s: s != ""
    )


def hash_unit(*keys: Column, seed: int = 42) -> Column:
    """Repeatable uniform draw in [0, 1) from key columns, free of partition order."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
