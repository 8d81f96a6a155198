"""Nearest neighbours by a forest of sorted hash strings.

Each tree gives a vector a string of ``BITS`` bits: on which side of random cuts its projections fall. The
strings of a tree, sorted, are its array. A search goes down to the place of its own string, where the
longest common prefixes are, and up again level by level in all trees at the same time until ``SHARE`` of
all vectors have been met (repeats counted) and ``MEETINGS`` at least; all that share the last level's prefix take part. Exact
distances decide among them.

Equal vectors are one class in the index. Arrays are cut into blocks of ``SLICE`` places and a search visits the
blocks around its place; distances are worked out for blocks of queries against parts of the classes, so
every group that a task holds has a fixed size. The cuts are fitted on at most ``SAMPLE`` vectors.

Defined results: rows without an id, and vectors that are null, zero, of another than the commonest
length, or hold null or non-finite numbers, take no part; rows that repeat id and vector count once; ties
go to the smaller id; with no more than ten candidates all are returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.graph import dense_index
from furrow.session import cut

TREES, BITS = 64, 48
SAMPLE = 4096
SHARE = 0.4  # of all vectors, met by one search, repeats counted
MEETINGS = 16384  # at least, where that is more
REACH = 1 / 48  # of an array, looked at on either side of a place
SLICE = 4096  # places of an array in one group
QUERIES, PART = 256, 4096  # queries and classes in one group
NEAREST = 10


def usable(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``vec_id, vector`` of the rows that take part."""
    values = F.col("vector")
    good = rows.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).alias("vector")).filter(
        F.col("vec_id").isNotNull() & values.isNotNull()
        & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(values, lambda x: x != 0)
    )
    length = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.filter(F.size("vector") == (length["n"] if length else 0))


def classes_of(good: DataFrame, kept: int = NEAREST + 1) -> DataFrame:
    """``vec_id, vector, class_id, nth``: the ``kept`` smallest ids of each class of equal vectors."""
    own = Window.partitionBy("vector").orderBy("vec_id")
    ranked = good.dropDuplicates(["vec_id", "vector"]).withColumn("nth", F.row_number().over(own)).filter(F.col("nth") <= kept)
    return ranked.withColumn("class_id", F.min("vec_id").over(Window.partitionBy("vector")))


def fit_cuts(classes: DataFrame, trees: int = TREES, bits: int = BITS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Projections and, for each, a cut near the middle of the sample's values."""
    rows = classes.orderBy(F.xxhash64("class_id"), "class_id").limit(SAMPLE).select("vector").collect()
    sample = np.array([r["vector"] for r in rows], np.float32)
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(sample.shape[1], trees * bits)).astype(np.float32)
    seen = np.sort(sample @ planes, axis=0)
    at = (rng.uniform(0.4, 0.6, trees * bits) * (len(seen) - 1)).astype(int)
    return planes, seen[at, np.arange(trees * bits)]


def index(classes: DataFrame, planes: np.ndarray, cuts: np.ndarray, trees: int, bits: int) -> DataFrame:
    """``tree, place, key, class_id``: the sorted arrays of hash strings."""
    weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)

    def strings(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = part.column("class_id").to_numpy(zero_copy_only=False)
                vectors = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                sides = (vectors.astype(np.float32) @ planes > cuts).reshape(len(ids), trees, bits)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.tile(np.arange(trees, dtype=np.int32), len(ids))), pa.array((sides @ weights).ravel()), pa.array(np.repeat(ids, trees)),
                ], names=["tree", "key", "class_id"])

    keys = classes.select("class_id", "vector").mapInArrow(strings, "tree int, key bigint, class_id bigint")
    total = classes.count()
    sorted_keys = dense_index(keys, [F.col("tree"), F.col("key"), F.col("class_id")], "place")
    return sorted_keys.withColumn("place", F.col("place") - F.col("tree") * F.lit(total))


def _visits(arrays: DataFrame, asked: DataFrame, total: int) -> tuple[DataFrame, DataFrame, int]:
    """The arrays with their blocks, and one row per search, tree and block around its place."""
    reach = max(SLICE // 8, int(total * REACH))
    blocks = arrays.withColumn("block", F.expr(f"place div {SLICE}"))
    around = F.sequence(
        F.expr(f"greatest(0, place - {reach}) div {SLICE}"), F.expr(f"least({total - 1}, place + {reach}) div {SLICE}")
    )
    visits = arrays.join(asked, "class_id").select(
        F.col("class_id").alias("query"), F.col("tree").alias("at_tree"), F.explode(around).alias("at_block"), F.col("place").alias("at"), F.col("key").alias("own")
    )
    return blocks, visits, reach


def _common(keys: np.ndarray, key: int, bits: int) -> np.ndarray:
    """Length of the common prefix of each string with one."""
    differ = keys ^ key
    exact = np.frexp(differ.astype(np.float64))[1]  # 48 bits keep every digit
    return bits - exact


def _near(index_rows: pd.DataFrame, searches: pd.DataFrame, reach: int):
    """For each search of a block: its class, and keys and ids of the places within reach."""
    rows = index_rows.sort_values("place")
    places, keys, ids = rows["place"].to_numpy(), rows["key"].to_numpy(), rows["class_id"].to_numpy()
    for s in searches.itertuples(index=False):
        lo, hi = np.searchsorted(places, [s.at - reach, s.at + reach + 1])
        yield s, keys[lo:hi], ids[lo:hi]


def candidates(arrays: DataFrame, asked: DataFrame, total: int, bits: int, share: float = SHARE) -> DataFrame:
    """``query, class_id`` pairs met by going up all trees at the same time; a pair may come more than once."""
    blocks, visits, reach = _visits(arrays, asked, total)
    wanted = max(MEETINGS, int(share * total))

    def count(index_rows: pd.DataFrame, searches: pd.DataFrame) -> pd.DataFrame:
        found = [(s.query, np.bincount(_common(keys, s.own, bits), minlength=bits + 1)) for s, keys, _ in _near(index_rows, searches, reach)]
        return pd.DataFrame({"query": [f[0] for f in found], "met": [f[1].tolist() for f in found]})

    counted = blocks.groupBy("tree", "block").cogroup(visits.groupBy("at_tree", "at_block")).applyInPandas(count, "query bigint, met array<bigint>")
    levels = counted.select("query", F.posexplode("met").alias("level", "n")).filter("n > 0").groupBy("query", "level").agg(F.sum("n").alias("n"))
    up = Window.partitionBy("query").orderBy(F.desc("level"))
    reached = levels.withColumn("met", F.sum("n").over(up)).groupBy("query").agg(
        F.coalesce(F.max(F.when(F.col("met") >= wanted, F.col("level"))), F.lit(0)).alias("level")
    )

    def take(index_rows: pd.DataFrame, searches: pd.DataFrame) -> pd.DataFrame:
        queries, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, keys, ids in _near(index_rows, searches, reach):
            met = ids[_common(keys, s.own, bits) >= s.level]
            queries.append(np.full(len(met), s.query))
            found.append(met)
        return pd.DataFrame({"query": np.concatenate(queries), "class_id": np.concatenate(found)})

    level_of = visits.join(reached, "query")
    return blocks.groupBy("tree", "block").cogroup(level_of.groupBy("at_tree", "at_block")).applyInPandas(take, "query bigint, class_id bigint")


def _distances(pairs: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
    """The nearest classes of one part for each query of one block."""
    empty = pd.DataFrame({"query": pd.Series(dtype="int64"), "class_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if pairs.empty:
        return empty
    asked = vectors["asked"].to_numpy(bool)
    ids = vectors["class_id"].to_numpy()
    values = np.stack(vectors["vector"].to_numpy()).astype(np.float64)
    by_query = {i: v for i, v in zip(ids[asked], values[asked], strict=True)}
    order = np.argsort(ids[~asked])
    own, own_values = ids[~asked][order], values[~asked][order]
    out = []
    for query, wanted in pairs.groupby("query")["class_id"]:
        wanted = np.unique(wanted.to_numpy())
        score = np.sqrt(((own_values[np.searchsorted(own, wanted)] - by_query[query]) ** 2).sum(1))
        best = np.lexsort((wanted, score))[:NEAREST + 1]
        out.append(pd.DataFrame({"query": query, "class_id": wanted[best], "score": score[best]}))
    return pd.concat(out)


def search(rows: DataFrame, is_query, trees: int = TREES, bits: int = BITS, share: float = SHARE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found of each row for which ``is_query(vec_id)`` holds."""
    members = cut(classes_of(usable(rows)))
    classes = cut(members.filter("nth = 1").select("class_id", "vector"))
    # every query row, also beyond the ids that a class keeps
    queries = cut(usable(rows).filter(is_query(F.col("vec_id"))).distinct().join(classes, "vector").select(F.col("vec_id").alias("query_id"), "class_id"))
    total = classes.count()
    schema = "query bigint, class_id bigint, score double"
    if not total or queries.isEmpty():
        best = rows.sparkSession.createDataFrame([], schema)
    else:
        planes, cuts = fit_cuts(classes, trees, bits)
        arrays = cut(index(classes, planes, cuts, trees, bits))
        asked = queries.select("class_id").distinct()
        pairs = candidates(arrays, asked, total, bits, share)
        blocks, parts = asked.count() // QUERIES + 1, total // PART + 1
        block_of = F.pmod(F.xxhash64(F.lit(1), "query"), F.lit(blocks)).cast("int")
        part_of = F.pmod(F.xxhash64(F.lit(2), "class_id"), F.lit(parts)).cast("int")
        keyed = pairs.withColumns({"block": block_of, "part": part_of})
        everywhere = F.sequence(F.lit(0), F.lit(blocks - 1))
        stored = classes.select("class_id", "vector", F.lit(False).alias("asked"), part_of.alias("in_part"), F.explode(everywhere).alias("in_block"))
        queried = classes.join(asked, "class_id").select(
            "class_id", "vector", F.lit(True).alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("in_part"),
            F.pmod(F.xxhash64(F.lit(1), "class_id"), F.lit(blocks)).cast("int").alias("in_block"),
        )
        near = keyed.groupBy("block", "part").cogroup(stored.unionByName(queried).groupBy("in_block", "in_part")).applyInPandas(_distances, schema)
        first = Window.partitionBy("query").orderBy("score", "class_id")
        best = near.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= NEAREST + 1).drop("nth")
    found = best.join(queries.withColumnRenamed("class_id", "query"), "query").join(members.select("vec_id", "class_id"), "class_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.filter("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEAREST)
    return ranked.select("query_id", "rank", "vec_id", "score")
