"""Connected components of an edge table, and dense numbering, as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.skew import HOT_ROWS, attach_group
from furrow.session import cut


def root_labels(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` local nodes (hook to minimum, then jump)."""
    label = np.arange(n)
    while len(src):
        low = np.minimum(label[src], label[dst])
        np.minimum.at(label, label[src], low)
        np.minimum.at(label, label[dst], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        open_ = label[src] != label[dst]
        src, dst = src[open_], dst[open_]
    return label


# Edges that are contracted together in one task.
BATCH = 1 << 18


def _stars(pairs: np.ndarray) -> pd.DataFrame:
    """Stars on the components of these edges alone."""
    nodes, flat = np.unique(pairs.ravel(), return_inverse=True)
    ends = flat.reshape(-1, 2)
    label = root_labels(len(nodes), ends[:, 0], ends[:, 1])
    moved = label != np.arange(len(nodes))
    return pd.DataFrame({"src": nodes[moved], "dst": nodes[label[moved]]})


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace each ``BATCH`` edges or so by stars on their own components."""
    held, rows = [], 0
    for pdf in batches:
        held.append(pdf[["src", "dst"]].to_numpy())
        rows += len(pdf)
        if rows >= BATCH:
            yield _stars(np.concatenate(held))
            held, rows = [], 0
    if held:
        yield _stars(np.concatenate(held))


def components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``src, dst`` (bigint) -> ``node, comp`` with comp the smallest node of the component.

    Rounds of large-star and small-star. Each is a map-side combined minimum per node, given
    back to the node's edges; a hub never gathers its neighbours in one task. Edges are first contracted
    batch by batch, which leaves only links between batches to the loop, which ends when every node
    points at one root.
    """
    both = cut(edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")))
    batches = both.count() // BATCH + 1
    stars = cut(both.coalesce(batches).mapInPandas(_contract, "src bigint, dst bigint").distinct())
    while not _settled(stars):
        stars = cut(_small_star(_large_star(stars, hot_rows), hot_rows))
    return stars.select(F.col("src").alias("node"), F.col("dst").alias("comp")).unionByName(
        stars.select(F.col("dst").alias("node"), F.col("dst").alias("comp")).distinct()
    )


def _settled(edges: DataFrame) -> bool:
    """True when every node points at one root and no root points on."""
    ends = edges.select(F.col("src").alias("n"), F.lit(1).alias("s"), F.lit(0).alias("d")).unionByName(
        edges.select(F.col("dst").alias("n"), F.lit(0).alias("s"), F.lit(1).alias("d"))
    )
    per_node = ends.groupBy("n").agg(F.sum("s").alias("s"), F.max("d").alias("d"))
    loose = (F.col("s") > 1) | ((F.col("s") == 1) & (F.col("d") == 1))
    return per_node.agg(F.count_if(loose)).first()[0] == 0


def _star(links: DataFrame, keep: Column, hot_rows: int) -> DataFrame:
    """Link kept neighbours of ``u`` to the smallest node among ``u`` and its neighbours."""
    return (
        attach_group(links, ["u"], hot_rows, low=F.min("v")).filter(keep)
        .select(F.col("v").alias("src"), F.least("low", "u").alias("dst"))
        .filter(F.col("src") != F.col("dst"))
        .distinct()
    )


def _large_star(edges: DataFrame, hot_rows: int) -> DataFrame:
    links = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(
        edges.select(F.col("dst").alias("u"), F.col("src").alias("v"))
    )
    return _star(links, F.col("v") > F.col("u"), hot_rows)


def _small_star(edges: DataFrame, hot_rows: int) -> DataFrame:
    down = edges.select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    )
    both = attach_group(down, ["u"], hot_rows, low=F.min("v"))
    return (
        both.select(F.explode(F.array("u", "v")).alias("src"), F.col("low").alias("dst"))
        .filter(F.col("src") != F.col("dst")).distinct()
    )


def with_components(nodes: DataFrame, edges: DataFrame, key: str, name: str = "comp") -> DataFrame:
    """Add the component of ``key``; nodes without an edge are their own component."""
    found = components(edges).withColumnRenamed("node", key).withColumnRenamed("comp", "_comp")
    return nodes.join(found, key, "left").withColumn(
        name, F.coalesce("_comp", key)
    ).drop("_comp")


def dense_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """0-based position of each row in a total order, without one task seeing all rows.

    Range-sorted, written once, then numbered from per-partition offsets. The offset table has
    one row per partition, which bounds it.
    """
    placed = cut(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_mid", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid", "_part", "_off")
    )
