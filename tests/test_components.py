"""Principal components, pooling, feature columns, simplification of rings with holes."""

import numpy as np
from pyspark.sql import functions as F

from furrow.functions import raster_math
from furrow.operators import components, outlines
from furrow.sources import features


def test_components_solve_the_covariance(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 100
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>").repartition(5)
    mean, matrix, n = components.covariance(rows.union(spark.createDataFrame([(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0])], rows.schema)), "v")
    assert n == 300 and np.allclose(mean, x.mean(0)) and np.allclose(matrix, np.cov(x.T))
    values, found = components.directions(matrix, 6)
    assert np.allclose(matrix @ found.T, found.T * values) and np.allclose(found @ found.T, np.eye(6))
    assert (found[np.arange(6), np.abs(found).argmax(1)] > 0).all()
    made, shares = components.principal_components(rows, "v", 2)
    got = np.array([r["pc"] for r in made.orderBy("i").collect()])
    assert np.allclose(got, (x - x.mean(0)) @ found[:2].T) and np.allclose(shares, values[:2] / values.sum())


def test_no_rows(spark):
    rows = spark.createDataFrame([], "v array<double>")
    mean, matrix, n = components.covariance(rows, "v")
    assert n == 0 and len(mean) == 0 and matrix.shape == (0, 0)


def test_mean_pool(spark):
    row = spark.createDataFrame([([1.0, 3.0, 5.0, 7.0, 10.0],), ([],)], "v array<double>").select(raster_math.mean_pool(F.col("v"), 2).alias("p")).collect()
    assert [r["p"] for r in row] == [[2.0, 6.0, 10.0], []]


def test_feature_columns(spark):
    texts = ['{"properties":{"id":"a","metrics:area":1.5}}', '{"properties":{"id":"b","metrics:area":"x"}}', "no json", None, "{}"]
    rows = spark.createDataFrame([(t,) for t in texts], "value string")
    got = features.feature_columns(rows, {"id": "string", "metrics:area": "double"}).collect()
    assert [tuple(r) for r in got] == [("a", 1.5), ("b", None), (None, None), (None, None), (None, None)]


def ring(*points):
    return [tuple(map(float, p)) for p in [*points, points[0]]]


def test_a_hole_stays_inside_its_ring(spark):
    """A bump of height 10 with a hole in it: a tolerance of 15 would cut the bump off below the hole."""
    outer = ring((0, 0), (100, 0), (100, 50), (55, 50), (55, 60), (45, 60), (45, 50), (0, 50))
    hole = ring((48, 53), (52, 53), (52, 57), (48, 57))
    schema = "exterior array<struct<x: double, y: double>>, interiors array<array<struct<x: double, y: double>>>"
    got = outlines.simplify(spark.createDataFrame([(outer, [hole]), (outer, [])], schema), 15).collect()
    kept = [(p["x"], p["y"]) for p in got[0]["exterior"]]
    inner = [(p["x"], p["y"]) for p in got[0]["interiors"][0]]
    assert outlines._has_inside(np.array(kept), np.array(inner)) and (50 < max(y for _, y in kept))
    assert len(got[1]["exterior"]) == 5  # without the hole the bump goes
