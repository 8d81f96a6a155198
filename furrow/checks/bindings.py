"""The given tables seen as rasters, scenes, areas, detections and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import rings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; one of fewer files than cores is spread over them first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def div(c: Column, n: int) -> Column:
    return F.floor(c / n)


def cells(spark: SparkSession, sf_dir: str, side: int = 64) -> DataFrame:
    """Class rasters of side x side cells from line items; their number grows with the table.

    Raster = block of orders, row = order, column = part. Cells no line item falls on are
    filled: a field on alternate 8 x 8 blocks, else background. The grid is exploded from a few rows,
    so its size is underestimated and must not decide the join.
    """
    per = side * side // 4
    li = table(spark, sf_dir, "lineitem")
    hits = li.groupBy(
        div(F.col("l_orderkey"), per).alias("raster_id"),
        (F.col("l_orderkey") % side).cast("int").alias("y"),
        (F.col("l_partkey") % side).cast("int").alias("x"),
    ).agg(F.sum("l_linenumber").alias("s"), F.count(F.lit(1)).alias("n"))
    span = F.sequence(F.lit(0), F.lit(side - 1))
    grid = (
        li.select(div(F.col("l_orderkey"), per).alias("raster_id")).distinct()
        .withColumn("y", F.explode(span)).withColumn("x", F.explode(span))
    )
    s = F.col("s")
    fill = F.when((div(F.col("y"), 8) + div(F.col("x"), 8)) % 2 == 0, 1).otherwise(0)
    cls = (
        F.when(s.isNull(), fill).when(s % 8 < 4, 1).when(s % 8 < 6, 2).when(s % 8 == 6, 0).otherwise(3)
    )
    flip = (F.col("y") * 7 + F.col("x") * 13 + F.col("raster_id")) % 11 == 0
    pred = F.when(flip, (F.col("cls") + 1) % 3).when(F.col("cls") == 3, 0).otherwise(F.col("cls"))
    return (
        grid.hint("merge").join(hits, ["raster_id", "y", "x"], "left")
        .withColumn("cls", cls)
        .withColumn("pred", pred)
        .withColumn("edge", F.coalesce(F.col("n") % 2, F.lit(0)))
        .withColumn("s", F.coalesce(s, F.lit(0)))
        .withColumn("n", F.coalesce(F.col("n"), F.lit(0)))
    )


def cells_sql(side: int = 64, name: str = "cells") -> str:
    per = side * side // 4
    return f"""
{name}_hits AS (
  SELECT l_orderkey // {per} AS raster_id, l_orderkey % {side} AS y, l_partkey % {side} AS x,
         sum(l_linenumber) AS s, count(*) AS n
  FROM lineitem GROUP BY 1, 2, 3),
{name}_cls AS (
  SELECT r.raster_id, gy.y, gx.x, coalesce(h.s, 0)::BIGINT AS s, coalesce(h.n, 0)::BIGINT AS n,
         CASE WHEN h.s IS NULL THEN CASE WHEN (gy.y // 8 + gx.x // 8) % 2 = 0 THEN 1 ELSE 0 END
              WHEN h.s % 8 < 4 THEN 1 WHEN h.s % 8 < 6 THEN 2 WHEN h.s % 8 = 6 THEN 0 ELSE 3 END AS cls
  FROM (SELECT DISTINCT raster_id FROM {name}_hits) r, range({side}) gy(y), range({side}) gx(x)
  LEFT JOIN {name}_hits h ON h.raster_id = r.raster_id AND h.y = gy.y AND h.x = gx.x),
{name} AS (
  SELECT *, CASE WHEN (y * 7 + x * 13 + raster_id) % 11 = 0 THEN (cls + 1) % 3
                 WHEN cls = 3 THEN 0 ELSE cls END AS pred, n % 2 AS edge
  FROM {name}_cls)"""


def chip_country(df: DataFrame, nation: DataFrame) -> DataFrame:
    names = nation.select(F.col("n_nationkey").cast("bigint").alias("nk"), F.col("n_name").alias("country"))
    return df.withColumn("nk", F.col("raster_id") % 25).join(names, "nk").drop("nk")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    x0, y0 = (F.col("o_custkey") % 30).cast("double"), (F.col("o_custkey") % 20).cast("double")
    return o.select(
        F.col("o_orderkey").alias("scene_id"),
        F.col("o_orderdate").cast("timestamp").alias("dt"),
        ((F.round(F.col("o_totalprice") * 100).cast("bigint") % 10000) / 100.0).alias("cloud"),
        F.concat(F.lit("T"), (F.col("o_custkey") % 20).cast("string")).alias("tile"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 1.2).alias("x1"), (y0 + 1.2).alias("y1"),
        (2 + F.col("o_orderkey") % 3).cast("string").alias("processing"),
    ).withColumn("footprint", rings.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


SCENES_SQL = """
scenes AS (
  SELECT o_orderkey AS scene_id, o_orderdate::TIMESTAMP AS dt,
         (round(o_totalprice * 100)::BIGINT % 10000) / 100.0::DOUBLE AS cloud,
         'T' || (o_custkey % 20) AS tile, (o_custkey % 30)::DOUBLE AS x0, (o_custkey % 20)::DOUBLE AS y0,
         (o_custkey % 30)::DOUBLE + 1.2::DOUBLE AS x1, (o_custkey % 20)::DOUBLE + 1.2::DOUBLE AS y1,
         (2 + o_orderkey % 3)::VARCHAR AS processing
  FROM orders)"""


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    x0 = (c % 30) + F.lit(0.1) * (div(c, 30) % 12)
    y0 = (c % 20) + F.lit(0.1) * (div(c, 20) % 12)
    return table(spark, sf_dir, "customer").select(
        c.alias("aoi_id"), x0.alias("x0"), y0.alias("y0"), (x0 + 0.5).alias("x1"), (y0 + 0.5).alias("y1"),
        (1995 + c % 6).cast("int").alias("year"),
        (1 + (c * 37) % 365).cast("int").alias("sday"), (1 + (c * 53) % 365).cast("int").alias("eday"),
    )


AREAS_SQL = """
areas AS (
  SELECT c_custkey AS aoi_id, (c_custkey % 30) + 0.1::DOUBLE * ((c_custkey // 30) % 12) AS x0,
         (c_custkey % 20) + 0.1::DOUBLE * ((c_custkey // 20) % 12) AS y0,
         (c_custkey % 30) + 0.1::DOUBLE * ((c_custkey // 30) % 12) + 0.5::DOUBLE AS x1,
         (c_custkey % 20) + 0.1::DOUBLE * ((c_custkey // 20) % 12) + 0.5::DOUBLE AS y1,
         (1995 + c_custkey % 6)::INT AS year, (1 + (c_custkey * 37) % 365)::INT AS sday,
         (1 + (c_custkey * 53) % 365)::INT AS eday
  FROM customer),
windows AS (
  SELECT *, 'a' AS win, make_date(year, 1, 1) + (sday - 1) AS center FROM areas
  UNION ALL
  SELECT *, 'b', make_date(CASE WHEN eday < sday THEN year + 1 ELSE year END, 1, 1) + (eday - 1) FROM areas),
candidates AS (
  SELECT w.*, s.scene_id, s.dt, s.cloud, s.tile, s.x0 AS sx0, s.y0 AS sy0, s.x1 AS sx1, s.y1 AS sy1
  FROM windows w JOIN scenes s
    ON s.x0 <= w.x1 AND s.x1 >= w.x0 AND s.y0 <= w.y1 AND s.y1 >= w.y0
   AND s.dt >= (w.center - 14)::TIMESTAMP AND s.dt < (w.center + 15)::TIMESTAMP AND s.cloud < 20)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as boxes: chains of three shifted boxes."""
    p = F.col("p_partkey")
    g = div(p, 3)
    x0 = ((g % 40) * 40 + (p % 3) * (1 + g % 7)).cast("double")
    y0 = (div(g, 40) * 20).cast("double")
    return table(spark, sf_dir, "part").select(
        p.alias("id"), (p % 16).alias("patch_id"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 10).alias("x1"), (y0 + 10).alias("y1"),
        ((F.round(F.col("p_retailprice") * 100).cast("bigint") % 100) / 100.0).alias("conf"),
    )


BOXES_SQL = """
boxes AS (
  SELECT p_partkey AS id, p_partkey % 16 AS patch_id,
         (((p_partkey // 3) % 40) * 40 + (p_partkey % 3) * (1 + (p_partkey // 3) % 7))::DOUBLE AS x0,
         ((p_partkey // 120) * 20)::DOUBLE AS y0,
         (((p_partkey // 3) % 40) * 40 + (p_partkey % 3) * (1 + (p_partkey // 3) % 7) + 10)::DOUBLE AS x1,
         ((p_partkey // 120) * 20 + 10)::DOUBLE AS y1,
         (round(p_retailprice * 100)::BIGINT % 100) / 100.0::DOUBLE AS conf
  FROM part)"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slanted quadrilaterals of many sizes in piles of three, a quarter of them with a triangular hole."""
    p = F.col("p_partkey")
    g = div(p, 3)
    rows = table(spark, sf_dir, "part").select(
        p.alias("id"), ((g % 40) * 40 + (p % 3) * (1 + g % 7)).cast("double").alias("cx"), (div(g, 40) * 40).cast("double").alias("cy"),
        (4 + p % 13).cast("double").alias("s"), (p % 5 - 2).cast("double").alias("k"), (p % 4 == 0).alias("holed"))
    cx, cy, s, k = (F.col(c) for c in ("cx", "cy", "s", "k"))
    first = rings.point(cx - s, cy - s)
    outer = F.array(first, rings.point(cx + s, cy - s + k), rings.point(cx + s + k, cy + s), rings.point(cx - s + 1, cy + s - k), first)
    low = rings.point(cx - s / 2, cy - s / 2)
    hole = F.array(low, rings.point(cx + s / 2, cy - s / 2 + k / 4), rings.point(cx, cy + s / 2), low)
    return rows.select("id", outer.alias("exterior"), F.when(F.col("holed"), F.array(hole)).otherwise(F.slice(F.array(hole), 1, 0)).alias("interiors"))


SHAPES_SQL = """
sized AS (
  SELECT p_partkey AS id, (((p_partkey // 3) % 40) * 40 + (p_partkey % 3) * (1 + (p_partkey // 3) % 7))::DOUBLE AS cx,
         ((p_partkey // 120) * 40)::DOUBLE AS cy, (4 + p_partkey % 13)::DOUBLE AS s, (p_partkey % 5 - 2)::DOUBLE AS k, p_partkey % 4 = 0 AS holed
  FROM part),
ring_sides AS (
  SELECT id, cx - s AS px, cy - s AS py, cx + s AS qx, cy - s + k AS qy FROM sized
  UNION ALL SELECT id, cx + s, cy - s + k, cx + s + k, cy + s FROM sized
  UNION ALL SELECT id, cx + s + k, cy + s, cx - s + 1, cy + s - k FROM sized
  UNION ALL SELECT id, cx - s + 1, cy + s - k, cx - s, cy - s FROM sized
  UNION ALL SELECT id, cx - s / 2, cy - s / 2, cx + s / 2, cy - s / 2 + k / 4 FROM sized WHERE holed
  UNION ALL SELECT id, cx + s / 2, cy - s / 2 + k / 4, cx, cy + s / 2 FROM sized WHERE holed
  UNION ALL SELECT id, cx, cy + s / 2, cx - s / 2, cy - s / 2 FROM sized WHERE holed),
bounds AS (SELECT id, min(least(px, qx)) AS x0, max(greatest(px, qx)) AS x1, min(least(py, qy)) AS y0, max(greatest(py, qy)) AS y1 FROM ring_sides GROUP BY 1)"""


def shape_cells_sql(step: float) -> str:
    """Grid cells whose centres have an odd number of sides to their left."""
    return f"""
shape_cells AS (
  SELECT id, r, c FROM (
    SELECT b.id, r, c FROM bounds b, unnest(range(floor(y0 / {step})::BIGINT - 1, ceil(y1 / {step})::BIGINT + 1)) t(r), unnest(range(floor(x0 / {step})::BIGINT - 1, ceil(x1 / {step})::BIGINT + 1)) u(c)) g
  JOIN ring_sides e USING (id)
  WHERE least(py, qy) <= (r + 0.5::DOUBLE) * {step} AND (r + 0.5::DOUBLE) * {step} < greatest(py, qy)
    AND px + ((r + 0.5::DOUBLE) * {step} - py) * (qx - px) / (qy - py) <= (c + 0.5::DOUBLE) * {step}
  GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)"""


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    split = F.when(d % 10 < 8, "train").when(d % 10 == 8, "val").otherwise("test")
    return table(spark, sf_dir, "documents").select(
        d.alias("aoi_id"), F.col("lang").alias("country"), split.alias("split"), "n_chars", "source"
    )


CHIPS_SQL = """
chips AS (
  SELECT doc_id AS aoi_id, lang AS country, n_chars, source,
         CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split
  FROM documents)"""


def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File inventory: long documents have both windows, labelled ones a mask."""
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("aoi_id"), F.col("lang").alias("country"), "n_chars"
    )
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("aoi_id"), "quality")
    kinds = F.array_compact(F.array(
        F.lit("window_a"),
        F.when(F.col("n_chars") >= 100, "window_b"),
        F.when(F.col("quality").isNotNull(), "semantic_2class"),
        F.when(F.col("quality") == 1, "semantic_3class"),
    ))
    return (
        d.join(marks, "aoi_id", "left").withColumn("kind", F.explode(kinds))
        .select("country", "aoi_id", "kind",
                F.concat_ws("/", "country", "kind", F.concat(F.col("aoi_id").cast("string"), F.lit(".tif"))).alias("path"))
    )


FILES_SQL = """
files AS (
  WITH d AS (SELECT doc_id AS aoi_id, lang AS country, n_chars, l.quality
             FROM documents LEFT JOIN labels l USING (doc_id)),
  k AS (SELECT aoi_id, country, 'window_a' AS kind FROM d
        UNION ALL SELECT aoi_id, country, 'window_b' FROM d WHERE n_chars >= 100
        UNION ALL SELECT aoi_id, country, 'semantic_2class' FROM d WHERE quality IS NOT NULL
        UNION ALL SELECT aoi_id, country, 'semantic_3class' FROM d WHERE quality = 1)
  SELECT *, country || '/' || kind || '/' || aoi_id || '.tif' AS path FROM k)"""


def skip_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad samples: documents marked toxic."""
    marks = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id")
    return table(spark, sf_dir, "documents").join(marks, "doc_id").select(
        F.col("lang").alias("country"), F.col("doc_id").alias("aoi_id")
    )


SKIP_SQL = """
skips AS (SELECT lang AS country, doc_id AS aoi_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small image chips: 64 values, quantised copy ``q`` (8 bands x 8 pixels or 8 x 8 cells)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label"
    ).withColumn("q", F.transform("v", lambda e: F.round(e * 1000).cast("int")))


VECTORS_SQL = """
vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, label,
         list_transform(embedding, lambda e: round(e::DOUBLE * 1000)::INT) AS q
  FROM embeddings),
qcells AS (SELECT vec_id, i, q[i + 1]::BIGINT AS q, v[i + 1] AS v, i // 8 AS y, i % 8 AS x
           FROM vectors, range(64) t(i))"""


def vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, i, q, v`` with y = i // 8, x = i % 8."""
    return (
        vectors(spark, sf_dir)
        .select("vec_id", F.posexplode(F.arrays_zip("q", "v")).alias("i", "z"))
        .select("vec_id", "i", F.col("z.q").alias("q"), F.col("z.v").alias("v"),
                div(F.col("i"), 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"))
    )
