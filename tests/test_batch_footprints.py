"""Footprints judged and clipped a batch at a time, against the same steps row by row."""

import random

from pyspark.sql import functions as F

from furrow.functions import footprints as P
from furrow.functions import rings


def drawn(seed):
    draw = random.Random(seed)

    def ring():
        points = [(float(draw.randint(-6, 6)), float(draw.randint(-6, 6))) for _ in range(draw.choice((0, 1, 3, 3, 4, 5, 8)))]
        return points + points[:1] if draw.random() < 0.9 else points

    def part():
        big = [(-6.0, -6.0), (6.0, -6.0), (5.0, 6.0), (-6.0, 6.0), (-6.0, -6.0)]
        return (big if draw.random() < 0.5 else ring(), [ring() for _ in range(draw.choice((0, 0, 1, 2)))])

    rows = [(None, 0.0, 0.0, 1.0, 1.0), ([], 0.0, 0.0, 1.0, 1.0)]
    for _ in range(400):
        x, y = draw.randint(-5, 2), draw.randint(-5, 2)
        rows.append(([part() for _ in range(draw.choice((1, 1, 2, 3)))], float(x), float(y), x + 0.5 + draw.randint(0, 5), y + 0.5 + draw.randint(0, 5)))
    return [(i, *r) for i, r in enumerate(rows)]


def test_clipping_is_that_of_one_ring_after_the_other(spark):
    rows = spark.createDataFrame(drawn(1), f"id long, parts {P._PARTS.simpleString()}, x0 double, y0 double, x1 double, y1 double").repartition(3)
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    made = rows.select("parts", P.clip_parts_to_box(F.col("parts"), *box).alias("got"), P.clip_parts(F.col("parts"), lambda r: P.clip_ring(r, *box)).alias("want")).collect()
    assert all(r["got"] == r["want"] for r in made)
    assert sum(1 for r in made if r["want"]) > 50 and sum(1 for r in made if r["want"] and len(r["want"][0]["interiors"])) > 5


def test_validity_is_that_of_one_pair_of_sides_after_the_other(spark):
    def ring_valid(ring):
        crossed = F.exists(P.ring_sides(ring), lambda s: F.exists(P.ring_sides(ring), lambda t: P._cross(s, t)))
        closed = (F.size(ring) > 3) & (F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1))
        return F.coalesce(closed & (rings.ring_area(ring) > 0) & ~crossed, F.lit(False))

    def part_valid(p):
        inside = F.forall(p["interiors"], lambda r: ring_valid(r) & P.contains_point(P.single(p["exterior"]), F.get(r, F.lit(0))))
        return ring_valid(p["exterior"]) & inside

    want = F.coalesce((F.size("parts") > 0) & F.forall("parts", part_valid), F.lit(False))
    rows = spark.createDataFrame(drawn(2), f"id long, parts {P._PARTS.simpleString()}, x0 double, y0 double, x1 double, y1 double").repartition(3)
    made = rows.select(P.parts_valid(F.col("parts")).alias("got"), want.alias("want")).collect()
    assert all(r["got"] == r["want"] for r in made)
    assert 40 < sum(r["want"] for r in made) < 360


def test_whole_batches_pass_one_function(spark):
    rows = spark.createDataFrame(drawn(3), f"id long, parts {P._PARTS.simpleString()}, x0 double, y0 double, x1 double, y1 double")
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    plan = rows.select(P.parts_valid(F.col("parts")), P.clip_parts_to_box(F.col("parts"), *box))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "exists(" not in plan
