"""Scene selection: the best scene per area and season window from a catalogue.

Scenes: ``scene_id, dt, cloud, tile``, ``footprint`` (closed ring) or ``parts`` (parts with holes), and
``x0, y0, x1, y1`` (its box).
Areas:  ``aoi_id, x0, y0, x1, y1, year, sday, eday`` in degrees and days of year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import footprints, projection, rings, text
from furrow.operators.skew import bucket_join
from furrow.session import cut

AREA_LIMIT_M2 = 1e10


def season_windows(aois: DataFrame, buffer_days: int = 14) -> DataFrame:
    """One row per area and window (a: start of season, b: end) with its date range."""
    end_year = text.season_end_year(F.col("year"), F.col("sday"), F.col("eday"))
    windows = F.array(
        F.struct(F.lit("a").alias("win"),
                 text.day_of_year_date(F.col("year"), F.col("sday")).alias("center")),
        F.struct(F.lit("b").alias("win"),
                 text.day_of_year_date(end_year, F.col("eday")).alias("center")),
    )
    return (
        aois.withColumn("w", F.explode(windows))
        .select(*aois.columns, "w.win", "w.center")
        .withColumn("from_ts", F.date_sub("center", buffer_days).cast("timestamp"))
        .withColumn(
            "to_ts",
            F.date_add("center", buffer_days + 1).cast("timestamp") - F.expr("INTERVAL 1 SECOND"),
        )
    )


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


# What decides which scenes a window meets, and what its best one is.
PLACE = ["x0", "y0", "x1", "y1", "from_ts", "to_ts"]
SCENE_BOX = ["sx0", "sy0", "sx1", "sy1"]


def _clear(scenes: DataFrame, cloud_max: float) -> DataFrame:
    """Scenes below the cloud limit with their footprint as parts."""
    parts = F.col("parts") if "parts" in scenes.columns else footprints.single(F.col("footprint"))
    return scenes.filter(F.col("cloud") < F.lit(cloud_max)).select(
        "scene_id", "dt", "cloud", "tile", parts.alias("parts"), *[F.col(c).alias("s" + c) for c in ("x0", "y0", "x1", "y1")])


def _meetings(windows: DataFrame, scenes: DataFrame, cell: float, period_days: int) -> DataFrame:
    """Pairs of a window and a scene whose boxes meet, with the date inside the window.

    The range join becomes an equi-join on (lon cell, lat cell, period). A pair is kept only in
    the cell that holds the lower-left corner of the overlap, so no pair appears twice. The
    period splits places that hold very many scenes, and hot buckets are salted.
    """
    epoch = F.to_date(F.lit("1970-01-01"))

    def period(d: Column) -> Column:
        return F.floor(F.date_diff(F.to_date(d), epoch) / period_days)

    s = (
        scenes.withColumn("per", period(F.col("dt")))
        .withColumn("cx", F.explode(_cells(F.col("sx0"), F.col("sx1"), cell)))
        .withColumn("cy", F.explode(_cells(F.col("sy0"), F.col("sy1"), cell)))
    )
    a = (
        windows.withColumn(
            "per", F.explode(F.sequence(period(F.col("from_ts")), period(F.col("to_ts"))))
        )
        .withColumn("cx", F.explode(_cells(F.col("x0"), F.col("x1"), cell)))
        .withColumn("cy", F.explode(_cells(F.col("y0"), F.col("y1"), cell)))
    )
    corner_x, corner_y = F.greatest("x0", "sx0"), F.greatest("y0", "sy0")
    return (
        bucket_join(a, s, ["per", "cx", "cy"])
        .filter(
            (F.col("sx0") <= F.col("x1")) & (F.col("sx1") >= F.col("x0"))
            & (F.col("sy0") <= F.col("y1")) & (F.col("sy1") >= F.col("y0"))
            & F.col("dt").between(F.col("from_ts"), F.col("to_ts"))
            & (F.col("cx") == F.floor(corner_x / cell))
            & (F.col("cy") == F.floor(corner_y / cell))
        )
        .drop("per", "cx", "cy")
    )


# Tasks a core that make the pairs: the last ones to end leave cores idle for a part of that only.
TASKS = 8


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows by key over many tasks, whatever their bytes: a row makes a pair with each member, so few bytes make many rows."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS * spark.sparkContext.defaultParallelism), key)


def candidate_scenes(
    windows: DataFrame, scenes: DataFrame, cloud_max: float = 20, cell: float = 1.0,
    period_days: int = 32, measure: bool = False, digits: int | None = None,
) -> DataFrame:
    """Area x scene join: boxes meet, date inside the window, cloud strictly below the limit.

    Windows of one box and time, and scenes of one footprint and time, meet once for all that are alike; their
    members are joined on afterwards. Footprints are projected (``outline``), and with ``measure`` the share of
    the box they leave open (``nodata``) is taken, and rounded to ``digits``, before that, so only the rows of the
    result grow with copies.
    """
    clear = _clear(scenes, cloud_max)
    kind = ["dt", "parts", *SCENE_BOX]
    kinds = cut(clear.select(*kind).distinct().withColumn("_alike", F.monotonically_increasing_id()))
    same = [clear[c].eqNullSafe(kinds[c]) for c in kind]  # a scene without a footprint is a candidate too
    outlined = kinds.select("_alike", "dt", projected(F.col("parts")).alias("outline"), *SCENE_BOX)
    met = _meetings(windows.select(*PLACE).distinct(), outlined, cell, period_days)
    if measure:
        share = nodata_percent(F.col("outline"), *[F.col(c) for c in PLACE[:4]])
        met = met.withColumn("nodata", share if digits is None else F.round(share, digits) + F.lit(0.0))
    members = clear.hint("merge").join(kinds, same).select("_alike", "scene_id", "cloud", "tile")
    # few rows of either side share a key, and estimates of both are too low for a broadcast
    placed = _dealt(met.hint("merge").join(windows, PLACE), "_alike")
    return placed.hint("merge").join(_dealt(members, "_alike"), "_alike").select(
        *windows.columns, "scene_id", "dt", "cloud", "tile", "outline", *SCENE_BOX, *(["nodata"] if measure else []))


def projected(parts: Column) -> Column:
    """Parts of a footprint in equal-area metres; null for invalid and empty ones."""
    return F.when(footprints.parts_valid(parts), footprints.map_parts(parts, projection.equal_area_point))


def nodata_percent(outline: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Share of an area's box (degrees) outside a projected footprint, in percent."""
    ax0, ay0 = projection.equal_area(x0, y0)
    ax1, ay1 = projection.equal_area(x1, y1)
    # the outline is bound too: a lambda may not hold the Python function that judges it
    bound = F.struct(ax0.alias("x0"), ay0.alias("y0"), ax1.alias("x1"), ay1.alias("y1"), outline.alias("outline"))

    def share(b: Column) -> Column:
        whole = (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
        covered = footprints.covered_area(b["outline"], b["x0"], b["y0"], b["x1"], b["y1"])
        pct = (F.lit(1.0) - covered / whole) * 100
        return F.when(whole <= 0, F.raise_error(F.lit("area box has zero area")).cast("double")).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(100.0), pct))
        )

    return F.when(outline.isNull() | (F.size(outline) < 1), F.lit(100.0)).otherwise(
        rings.let(bound, share)
    )


def box_area_m2(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    ax0, ay0 = projection.equal_area(x0, y0)
    ax1, ay1 = projection.equal_area(x1, y1)
    return (ax1 - ax0) * (ay1 - ay0)


KEYS = ["aoi_id", "win"]
FRAME = ["center", "to_ts", "x0", "y0", "x1", "y1"]


def _with_status(rows: DataFrame, today: Column | None) -> DataFrame:
    """Counts and best scenes of windows, in one or more rows each -> one row with the status."""
    today = F.current_date() if today is None else today
    grouped = rows.groupBy(*KEYS).agg(
        *[F.max(c).alias(c) for c in FRAME],
        F.coalesce(F.sum("n_found"), F.lit(0)).cast("bigint").alias("n_found"),
        F.coalesce(F.sum("n_kept"), F.lit(0)).cast("bigint").alias("n_kept"),
        (F.min("low_tile") != F.max("high_tile")).alias("many_tiles"),
        F.min("best").alias("best"),
    )
    wide = box_area_m2(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) > AREA_LIMIT_M2
    status = (
        F.when(F.to_date("to_ts") > today, F.lit("future"))
        .when(F.col("n_found") == 0, F.lit("no_scene"))
        .when(F.col("n_kept") == 0, F.lit("nodata"))
        .when((F.col("n_kept") > 1) & wide & F.col("many_tiles"), F.lit("multi_tile"))
        .otherwise(F.lit("ok"))
    )
    ok = F.col("status") == "ok"
    return (
        grouped.withColumn("status", status)
        .select(
            *KEYS, "center", "n_found", "n_kept", "status",
            *[F.when(ok, F.col(f"best.{c}")).alias(c) for c in ("scene_id", "cloud", "tile", "nodata")],
        )
    )


def _kept(nodata_max: float | None) -> Column:
    return F.lit(True) if nodata_max is None else F.col("nodata") <= F.lit(nodata_max)


def _known_tile() -> Column:
    return F.when(F.col("tile") != "Unknown", F.col("tile"))


def best_scene(
    windows: DataFrame, candidates: DataFrame, nodata_max: float | None = 50,
    today: Column | None = None,
) -> DataFrame:
    """Least cloudy scene per area and window with a status instead of an error.

    One aggregation, combined map-side: the best scene is a minimum over
    (cloud, scene order), so no group is ever sorted or held whole.
    """
    cand = candidates
    if "nodata" not in cand.columns:
        cand = cand.withColumn(
            "nodata", nodata_percent(F.col("outline"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    kept = _kept(nodata_max)
    known = F.when(kept, _known_tile())
    found = cand.select(
        *KEYS, F.col("scene_id").isNotNull().cast("int").alias("n_found"), F.coalesce(kept.cast("int"), F.lit(0)).alias("n_kept"),
        known.alias("low_tile"), known.alias("high_tile"), F.when(kept, F.struct("cloud", "scene_id", "tile", "nodata")).alias("best"))
    return _with_status(windows.select(*KEYS, *FRAME).unionByName(found, allowMissingColumns=True), today)


def best_scenes(
    windows: DataFrame, scenes: DataFrame, cloud_max: float = 20, nodata_max: float | None = 50,
    today: Column | None = None, cell: float = 1.0, period_days: int = 32,
) -> DataFrame:
    """``best_scene`` of all candidates without a row for each of them.

    Scenes of one footprint and time are counted first and keep their best one; windows of one box and time
    share their answer. So copies on either side cost one row each instead of one for each pair.
    """
    alike = _clear(scenes, cloud_max).groupBy("dt", "parts", *SCENE_BOX).agg(
        F.count("scene_id").alias("found"), F.count(F.lit(1)).alias("rows"),
        F.min(_known_tile()).alias("low"), F.max(_known_tile()).alias("high"),
        F.min(F.struct("cloud", "scene_id", "tile")).alias("first"),
    ).withColumn("outline", projected(F.col("parts"))).drop("parts")
    met = _meetings(windows.select(*PLACE).distinct(), alike, cell, period_days).withColumn(
        "nodata", nodata_percent(F.col("outline"), *[F.col(c) for c in PLACE[:4]]))
    kept = _kept(nodata_max)
    answers = met.groupBy(*PLACE).agg(
        F.sum("found").alias("n_found"), F.sum(F.when(kept, F.col("rows")).otherwise(0)).alias("n_kept"),
        F.min(F.when(kept, F.col("low"))).alias("low_tile"), F.max(F.when(kept, F.col("high"))).alias("high_tile"),
        F.min(F.when(kept, F.struct("first.cloud", "first.scene_id", "first.tile", "nodata"))).alias("best"))
    return _with_status(windows.select(*KEYS, *FRAME, "from_ts").join(answers, PLACE, "left"), today)


def two_windows(best: DataFrame) -> DataFrame:
    """Windows a and b of each area side by side."""
    def side(win: str, col: str) -> Column:
        return F.max(F.when(F.col("win") == win, F.col(col)))

    return best.groupBy("aoi_id").agg(
        side("a", "scene_id").alias("window_a"), side("b", "scene_id").alias("window_b"),
        side("a", "status").alias("status_a"), side("b", "status").alias("status_b"),
    )


def scene_selection(
    aois: DataFrame, scenes: DataFrame, cloud_max: float = 20, buffer_days: int = 14,
    nodata_max: float | None = 50, today: Column | None = None,
) -> DataFrame:
    windows = season_windows(aois, buffer_days)
    return two_windows(best_scenes(windows, scenes, cloud_max, nodata_max, today))


def footprints_meet(a: Column, b: Column) -> Column:
    """Two footprints of parts share a point; boxes are compared first."""
    def bounds(parts: Column) -> Column:
        return rings.ring_bbox(F.flatten(F.transform(parts, lambda p: p["exterior"])))

    def meet(p: Column) -> Column:
        l, r = p["l"], p["r"]
        return (
            (l["xmin"] <= r["xmax"]) & (r["xmin"] <= l["xmax"])
            & (l["ymin"] <= r["ymax"]) & (r["ymin"] <= l["ymax"])
        )

    near = rings.let(F.struct(bounds(a).alias("l"), bounds(b).alias("r")), meet)
    return F.when(near, footprints.parts_meet(a, b)).otherwise(F.lit(False))


def latest_time(*candidates: Column) -> Column:
    """Aggregate: newest acquisition time, with fallbacks per row."""
    return F.max(F.coalesce(*candidates))


def first_item(items: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First item of each search in a stated order; ``order`` must sort ascending.

    A minimum over a struct, so groups combine map-side.
    """
    rest = [c for c in items.columns if c not in keys]
    ranks = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    return (
        items.groupBy(*keys)
        .agg(F.min(F.struct(*ranks, *rest)).alias("first"))
        .select(*keys, *[f"first.{c}" for c in rest])
    )


def circular_day(days_sin: Column, days_cos: Column, low: float = 1.0, high: float = 365.0) -> Column:
    """Circular mean from the sums of sine and cosine, rounded half to even.

    Noise below 1e-9 days is cut first, so halves round the same way in any summation order.
    """
    angle = F.atan2(days_sin, days_cos)
    turn = F.when(angle < 0, angle + 2 * F.pi()).otherwise(angle)
    return F.rint(F.round(turn * (high - low) / (2 * F.pi()) + low, 9)).cast("int")


def circular_mean_day(day: Column, low: float = 1.0, high: float = 365.0) -> Column:
    """Aggregate: circular mean day of year; a single value is truncated instead."""
    theta = (day - low) * (2 * F.pi() / (high - low))
    return F.when(F.count(day) == 1, F.max(day).cast("int")).otherwise(
        circular_day(F.sum(F.sin(theta)), F.sum(F.cos(theta)), low, high)
    )


def calendar_days(calendar: DataFrame, aois: DataFrame, rows: str = "first", cell: float = 1.0) -> DataFrame:
    """Crop-calendar day per area and kind from the grid points inside its box.

    ``calendar``: ``lon, lat, kind, doy``. ``rows='first'`` uses only the northernmost row.
    """
    pts = calendar.withColumn("cx", F.floor(F.col("lon") / cell)).withColumn("cy", F.floor(F.col("lat") / cell))
    boxes = (
        aois.select("aoi_id", "x0", "y0", "x1", "y1")
        .withColumn("cx", F.explode(_cells(F.col("x0"), F.col("x1"), cell)))
        .withColumn("cy", F.explode(_cells(F.col("y0"), F.col("y1"), cell)))
    )
    inside = bucket_join(pts, boxes, ["cx", "cy"]).filter(
        F.col("lon").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1"))
    )
    theta = (F.col("doy") - 1.0) * (2 * F.pi() / 364.0)
    per_row = inside.groupBy("aoi_id", "kind", "lat").agg(
        F.count("doy").alias("n"), F.max("doy").alias("only"),
        F.sum(F.sin(theta)).alias("s"), F.sum(F.cos(theta)).alias("c"),
    )
    fields = F.struct("n", "only", "s", "c")
    if rows == "first":
        merged = per_row.groupBy("aoi_id", "kind").agg(F.max_by(fields, "lat").alias("r"))
    else:
        merged = per_row.groupBy("aoi_id", "kind").agg(
            F.struct(F.sum("n").alias("n"), F.max("only").alias("only"),
                     F.sum("s").alias("s"), F.sum("c").alias("c")).alias("r")
        )
    return merged.select(
        "aoi_id", "kind",
        F.when(F.col("r.n") == 1, F.col("r.only").cast("int"))
        .otherwise(circular_day(F.col("r.s"), F.col("r.c"))).alias("day"),
    )
