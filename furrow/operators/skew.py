"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows one key may have before it is handled on its own. The table of such keys has at most
# (all rows / HOT_ROWS) rows, which bounds every broadcast below.
HOT_ROWS = 1_000_000


def attach_group(rows: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, **aggs: Column) -> DataFrame:
    """Add aggregates of each row's own group (a window without gathering groups).

    Groups are combined map-side. Rows of hot groups get theirs from a broadcast of the hot
    groups and are not shuffled at all; the rest takes an ordinary join.
    """
    groups = rows.groupBy(*keys).agg(
        *[a.alias(n) for n, a in aggs.items()], F.count(F.lit(1)).alias("_rows")
    )
    hot = F.broadcast(groups.filter(F.col("_rows") > hot_rows).drop("_rows"))
    cold = groups.filter(F.col("_rows") <= hot_rows).drop("_rows")
    return rows.join(hot, keys).unionByName(
        rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys)
    )


def bucket_join(left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Equi-join on bucket keys that splits buckets whose pairs would be too many for one task.

    A bucket of more than ``hot_rows`` x 100 pairs, or rows on a side, is cut along its larger side; the
    rows of the other side are repeated once per part, so each pair still meets once. The salt is a
    hash of the row, so a recomputed task sends its rows where it sent them before.

    Sides often end in an explode, which size estimates leave out, so neither side nor its counts may be broadcast.
    Only the table of cut buckets is: a bucket in it has more than 10 x sqrt(``hot_rows``) rows on one side.
    """
    n_left = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l"))
    n_right = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r"))
    larger = F.greatest("_l", "_r")
    wanted = F.greatest(F.ceil(F.col("_l") * F.col("_r") / (hot_rows * 100)), F.ceil(larger / hot_rows))
    parts = n_left.hint("merge").join(n_right, keys).filter(wanted > 1).select(
        *keys, F.least(wanted, larger).cast("int").alias("_parts"), (F.col("_l") > F.col("_r")).alias("_cut_left")
    )

    def split(rows: DataFrame, own: Column) -> DataFrame:
        placed = rows.join(F.broadcast(parts), keys, "left")
        one = F.coalesce("_parts", F.lit(1))
        salt = F.pmod(F.xxhash64(*rows.columns), one.cast("bigint")).cast("int")
        everywhere = F.sequence(F.lit(0), one - 1)
        return placed.withColumn("_salt", F.explode(F.when(own, F.array(salt)).otherwise(everywhere))).drop("_parts", "_cut_left")

    cut_left = F.coalesce("_cut_left", F.lit(False))
    return split(left, cut_left).hint("merge").join(split(right, ~cut_left), [*keys, "_salt"]).drop("_salt")
