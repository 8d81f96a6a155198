"""Spatial self-join of boxed features and pair measures on axis-aligned boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.skew import bucket_join


def intersecting_pairs(boxes: DataFrame, base: float = 16.0, keys: list[str] | None = None) -> DataFrame:
    """All pairs ``a < b`` of features whose boxes meet, each once.

    ``boxes``: ``id, x0, y0, x1, y1``. Features go to a grid level of their own size (cells twice
    as wide per level), so each covers at most four cells there. Each feature is looked up from
    its own level upwards and meets only features native to that level, so small features never
    pair with each other in a large one's cells. A pair is kept in the cell holding the
    lower-left corner of the overlap. Hot cells are salted. Only features with equal ``keys`` meet.
    """
    keys = keys or []
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(base))
    sized = boxes.select(*keys, "id", "x0", "y0", "x1", "y1").withColumn(
        "native", F.ceil(F.log2(extent / base)).cast("int")
    )
    top = sized.select(F.max("native").alias("top")).scalar()
    cell = F.lit(base) * F.pow(F.lit(2.0), F.col("level"))

    def covering(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("cx", covering("x0", "x1")).withColumn("cy", covering("y0", "y1"))

    native = placed(sized.withColumn("level", F.col("native")))
    lifted = placed(sized.withColumn("level", F.explode(F.sequence(F.col("native"), top))))
    keep = [*keys, "level", "cx", "cy"]
    a = native.select(*keep, *[F.col(c).alias("a_" + c) for c in ("id", "x0", "y0", "x1", "y1")])
    b = lifted.select(*keep, "native", *[F.col(c).alias("b_" + c) for c in ("id", "x0", "y0", "x1", "y1")])
    once = (F.col("native") < F.col("level")) | (F.col("a_id") < F.col("b_id"))
    met = bucket_join(a, b, keep).filter(
        once
        & (F.col("a_x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1"))
        & (F.col("a_y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1"))
        & (F.col("cx") == F.floor(F.greatest("a_x0", "b_x0") / cell))
        & (F.col("cy") == F.floor(F.greatest("a_y0", "b_y0") / cell))
    ).drop("level", "cx", "cy", "native")
    swap = F.col("a_id") > F.col("b_id")
    out = []
    for c in ("id", "x0", "y0", "x1", "y1"):
        out.append(F.when(swap, F.col("b_" + c)).otherwise(F.col("a_" + c)).alias("a_" + c))
        out.append(F.when(swap, F.col("a_" + c)).otherwise(F.col("b_" + c)).alias("b_" + c))
    return met.select(*out)


def _side(p: str, axis: str) -> Column:
    return F.col(f"{p}_{axis}1") - F.col(f"{p}_{axis}0")


def _overlap(axis: str) -> Column:
    return F.least(f"a_{axis}1", f"b_{axis}1") - F.greatest(f"a_{axis}0", f"b_{axis}0")


def box_pair_measures(pairs: DataFrame) -> DataFrame:
    """Overlap area, IoU, containment and shared side length of two boxes."""
    ox, oy = _overlap("x"), _overlap("y")
    inter = F.greatest(ox, F.lit(0.0)) * F.greatest(oy, F.lit(0.0))
    a, b = _side("a", "x") * _side("a", "y"), _side("b", "x") * _side("b", "y")
    floor = F.lit(1e-12)
    shared = F.when((ox == 0) & (oy > 0), oy).when((oy == 0) & (ox > 0), ox).otherwise(F.lit(0.0))
    return (
        pairs.withColumn("inter", inter)
        .withColumn("iou", F.col("inter") / F.greatest(a + b - F.col("inter"), floor))
        .withColumn("containment", F.col("inter") / F.greatest(F.least(a, b), floor))
        .withColumn("shared", shared)
        .withColumn(
            "min_perimeter",
            F.least(2 * (_side("a", "x") + _side("a", "y")), 2 * (_side("b", "x") + _side("b", "y"))),
        )
    )


def merges_adjacent(inter: Column, shared: Column, min_perimeter: Column, ratio: float) -> Column:
    """Overlap merges; a touch merges when the shared boundary is long enough.

    Contact at corners only shares no length and never merges.
    """
    enough = (min_perimeter > 0) & (shared / min_perimeter >= F.lit(float(ratio)))
    return (inter > 0) | ((shared > 0) & (enough | F.lit(ratio == 0)))


def merges_duplicates(iou: Column, containment: Column, iou_min: float = 0.2, contain_min: float = 0.8) -> Column:
    return (iou >= F.lit(float(iou_min))) | (containment >= F.lit(float(contain_min)))
