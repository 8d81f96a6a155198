"""Merging boxes: the cases with known answers, odd shapes, and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import graph, merging, spatial


def boxes(spark, rows):
    return spark.createDataFrame(
        [(i + 1, *map(float, r)) for i, r in enumerate(rows)], "id long, x0 double, y0 double, x1 double, y1 double")


def merged(spark, rows, ratio):
    return {r["ids"]: r for r in merging.merge_adjacent_boxes(boxes(spark, rows), ratio, base=1.0).collect()}


@pytest.mark.parametrize("rows, ratio, expected", [
    ([], 0.0, set()),
    ([(0, 0, 1, 1)], 0.0, {"1"}),
    ([(0, 0, 1, 1), (5, 5, 6, 6)], 0.0, {"1", "2"}),
    ([(0, 0, 2, 2), (1, 1, 3, 3)], 0.5, {"1,2"}),
    ([(0, 0, 1, 1), (1, 0, 2, 1)], 0.2, {"1,2"}),
    ([(0, 0, 1, 1), (1, 0, 2, 1)], 0.5, {"1", "2"}),
    ([(0, 0, 1, 1), (1, 0, 2, 1)], 0.0, {"1,2"}),
    ([(0, 0, 1, 1), (1, 0, 2, 1), (5, 5, 6, 6), (6, 5, 7, 6), (10, 10, 11, 11)], 0.0, {"1,2", "3,4", "5"}),
    ([(0, 0, 1, 1), (1, 0, 2, 1), (2, 0, 3, 1)], 0.0, {"1,2,3"}),
    ([(0, 0, 1, 1), (1, 1, 2, 2)], 0.0, {"1", "2"}),
    ([(0, 0, 1, 1), (3, 3, 3, 3), (5, 5, 6, 6)], 0.0, {"1", "3"}),
])
def test_known_answers(spark, rows, ratio, expected):
    assert set(merged(spark, rows, ratio)) == expected


def test_many_apart(spark):
    rows = [(10 * i, 10 * i, 10 * i + 1, 10 * i + 1) for i in range(100)]
    assert len(merged(spark, rows, 0.0)) == 100


def test_grid_with_gaps_stays_apart(spark):
    rows = [(2 * c, 2 * r, 2 * c + 0.9, 2 * r + 0.9) for r in range(32) for c in range(32)]
    assert len(merged(spark, rows, 0.0)) == 1024


def test_measures_of_a_union(spark):
    out = merged(spark, [(0, 0, 2, 2), (1, 1, 3, 3)], 0.0)["1,2"]
    assert (out["area"], out["perimeter"]) == (7.0, 12.0)


def test_copies_of_one_box(spark):
    out = merged(spark, [(0, 0, 4, 4)] * 500 + [(9, 9, 10, 10)], 0.0)
    assert sorted(len(k.split(",")) for k in out) == [1, 500]


def random_boxes(seed, n=150, span=60):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, span, n), rng.integers(0, span, n)
    w = np.where(rng.random(n) < 0.05, rng.integers(20, 50, n), rng.integers(1, 6, n))
    h = np.where(rng.random(n) < 0.05, rng.integers(20, 50, n), rng.integers(1, 6, n))
    return np.stack([x, y, x + w, y + h], 1)


@pytest.mark.parametrize("seed", [0, 1])
def test_pairs_of_mixed_sizes(spark, seed):
    b = random_boxes(seed)
    want = {(i + 1, j + 1) for i in range(len(b)) for j in range(i + 1, len(b))
            if b[i, 0] <= b[j, 2] and b[j, 0] <= b[i, 2] and b[i, 1] <= b[j, 3] and b[j, 1] <= b[i, 3]}
    got = [(r["a_id"], r["b_id"]) for r in spatial.intersecting_pairs(boxes(spark, b.tolist()), base=2.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("seed", [2, 3])
def test_union_measures_against_cells(spark, seed):
    b = random_boxes(seed, n=40)
    for r in merged(spark, b.tolist(), 0.0).values():
        canvas = np.zeros((140, 140), dtype=int)
        for i in map(int, r["ids"].split(",")):
            x0, y0, x1, y1 = b[i - 1]
            canvas[y0 + 1:y1 + 1, x0 + 1:x1 + 1] = 1
        sides = np.abs(np.diff(canvas, axis=0)).sum() + np.abs(np.diff(canvas, axis=1)).sum()
        assert (r["area"], r["perimeter"]) == (canvas.sum(), sides)


def test_bands_do_not_change_a_tall_union(spark):
    out = merged(spark, [(0, -500, 1, 5000), (1, 3000, 2, 3001)], 0.0)["1,2"]
    assert (out["area"], out["perimeter"]) == (5501.0, 2 * 5500 + 2 + 2)


def components(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    return {r["node"]: r["comp"] for r in graph.components(df).collect()}


def brute(edges):
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components_chain_hub_and_random(spark):
    rng = np.random.default_rng(7)
    order = rng.permutation(600).tolist()
    chain = [(a, b) for a, b in zip(order, order[1:])]
    hub = [(5000, 5001 + i) for i in range(400)]
    loose = [tuple(map(int, rng.integers(10000, 10400, 2))) for _ in range(250)]
    edges = chain + hub + [e for e in loose if e[0] != e[1]]
    rng.shuffle(edges)
    edges = [tuple(map(int, e)) for e in edges]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert components(spark, edges) == brute(edges)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_components_of_nothing(spark):
    assert components(spark, []) == {}


def test_dense_index(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    got = graph.dense_index(df.repartition(7), [F.col("k")]).orderBy("k").collect()
    assert [r["idx"] for r in got] == list(range(1000))


def test_hot_groups_take_the_broadcast_path(spark):
    from furrow.operators import skew

    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 7), (3, 8)], "k int, v int")
    got = skew.attach_group(rows, ["k"], 10, low=F.min("v"), n=F.count("v"))
    assert {(r["k"], r["low"], r["n"]) for r in got.collect()} == {(1, 0, 50), (2, 7, 1), (3, 8, 1)}
    assert got.count() == 52


def test_hot_buckets_are_salted_without_losing_pairs(spark):
    from furrow.operators import skew

    left = spark.createDataFrame([(1, 100 + i) for i in range(9)] + [(2, 5), (4, 6)], "k int, a int")
    right = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 7), (3, 8)], "k int, b int")
    got = [(r["k"], r["a"], r["b"]) for r in skew.bucket_join(left, right, ["k"], 10).collect()]
    assert sorted(got) == sorted((r["k"], r["a"], r["b"]) for r in left.join(right, "k").collect())


def test_buckets_with_a_hot_left_side(spark):
    from furrow.operators import skew

    left = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 5)], "k int, a int")
    right = spark.createDataFrame([(1, i) for i in range(9)] + [(2, 7), (3, 8)], "k int, b int")
    got = [(r["k"], r["a"], r["b"]) for r in skew.bucket_join(left, right, ["k"], 10).collect()]
    assert sorted(got) == sorted((r["k"], r["a"], r["b"]) for r in left.join(right, "k").collect())


def test_components_with_hot_nodes(spark):
    hub = [(1, 10 + i) for i in range(300)] + [(10 + i, 1000 + i) for i in range(0, 300, 3)]
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(hub, "src long, dst long"), hot_rows=20).collect()}
    assert got == brute(hub)


def brute_groups(b, rule):
    edges = [(i + 1, j + 1) for i in range(len(b)) for j in range(i + 1, len(b)) if rule(b[i], b[j])]
    label = brute(edges)
    groups = {}
    for i in range(1, len(b) + 1):
        groups.setdefault(label.get(i, i), []).append(i)
    return {",".join(map(str, g)) for g in groups.values()}


def overlap(p, q):
    return max(0, min(p[2], q[2]) - max(p[0], q[0])) * max(0, min(p[3], q[3]) - max(p[1], q[1]))


def piles(seed):
    """Near-copies in piles, some far apart, some barely overlapping."""
    rng = np.random.default_rng(seed)
    rows = []
    for cx, cy, spread, n in ((0, 0, 0.4, 60), (9, 0, 0.4, 40), (300, 0, 6.0, 60), (600, 5, 2.0, 30)):
        x, y = cx + rng.normal(0, spread, n), cy + rng.normal(0, spread, n)
        rows += [(a, b, a + 10, b + 10) for a, b in zip(np.round(x, 2), np.round(y, 2))]
    return [tuple(map(float, r)) for r in rows]


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("iou, contain", [(0.2, 0.8), (0.6, 0.95), (0.9, 0.99)])
def test_piles_of_near_copies(spark, seed, iou, contain):
    b = piles(seed)

    def rule(p, q):
        i = overlap(p, q)
        return i / (200 - i) >= iou or i / 100 >= contain

    accept = spatial.merges_duplicates(F.col("iou"), F.col("containment"), iou, contain)
    got = merging.box_components(boxes(spark, b), accept)
    ids = {r["ids"] for r in got.groupBy("comp").agg(merging.merged_id(F.col("id"), F.col("id")).alias("ids")).collect()}
    assert ids == brute_groups(b, rule)


def test_piles_that_overlap(spark):
    b = piles(3)
    accept = spatial.merges_adjacent(F.col("inter"), F.col("shared"), F.col("min_perimeter"), 0.3)
    got = merging.box_components(boxes(spark, b), accept)
    ids = {r["ids"] for r in got.groupBy("comp").agg(merging.merged_id(F.col("id"), F.col("id")).alias("ids")).collect()}
    assert ids == brute_groups(b, lambda p, q: overlap(p, q) > 0)
