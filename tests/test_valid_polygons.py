"""Rings judged many at a time, and where Spark runs the test."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from furrow.operators import outlines


def crosses(ring):
    """Brute force in whole numbers: two sides that are no neighbours share a point, or a neighbour turns back."""
    sides = list(zip(ring, ring[1:]))

    def turn(p, q, r):
        return int(np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])))

    def on(p, a, b):
        return turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])

    for i, (a, b) in enumerate(sides):
        for j in range(i + 1, len(sides)):
            c, d = sides[j]
            if j == i + 1 or (i == 0 and j == len(sides) - 1):
                if turn(a, b, c) == turn(a, b, d) == 0 and (b[0] - a[0]) * (d[0] - c[0]) + (b[1] - a[1]) * (d[1] - c[1]) < 0:
                    return True
            elif (turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0) or any((on(a, c, d), on(b, c, d), on(c, a, b), on(d, a, b))):
                return True
    return False


def test_rings_of_many_lengths_against_brute_force(monkeypatch):
    monkeypatch.setattr(outlines, "RING_POINTS", 64)  # several groups of one length
    draw = np.random.default_rng(5)
    rows = []
    for _ in range(600):
        points = []
        while len(points) < draw.integers(3, 7):
            p = tuple(int(v) for v in draw.integers(0, 6, 2))
            if not points or points[-1] != p:
                points.append(p)
        rows.append([*points, points[0]] if points[0] != points[-1] else points)
    want = [len(r) > 3 and not crosses(r) for r in rows]
    assert 50 < sum(want) < 550
    held = [None, [], *rows, rows[0][:-1] + [(9, 9)]]
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    made = pa.array([None if r is None else [{"x": x, "y": y} for x, y in r] for r in held], kind)
    assert outlines._simple_rings(made).to_pylist() == [False, False, *want, False]
    assert outlines._simple_rings(made[2:]).to_pylist() == [*want, False]


def test_the_rings_are_judged_after_the_rows_are_spread(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1, 0), (1, 1), (0, 0))])
    one = spark.range(0, 100, 1, 1).repartition(4).select("id", ring.alias("exterior"))
    valid = outlines.valid_polygons(one)
    assert valid.rdd.getNumPartitions() == 4 and valid.count() == 100
    lines = valid._jdf.queryExecution().executedPlan().toString().splitlines()
    at = {word: next(i for i, line in enumerate(lines) if word in line) for word in ("ArrowEvalPython", "Exchange")}
    assert at["ArrowEvalPython"] < at["Exchange"]
