"""Shared cells of truth and predicted runs, counted without a row per cell."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from furrow.operators import evaluation, labelling


def test_overlaps_against_cells(spark):
    rng = np.random.default_rng(3)
    rows = [(k, int(y), int(x), int(a), int(b)) for k in range(3) for y in range(14) for x in range(14) for a, b in [rng.integers(0, 2, 2)]]
    pixels = spark.createDataFrame(rows, "raster_id long, y int, x int, cls int, pred int")
    layers = F.array_compact(F.array(F.when(F.col("cls") == 1, "t"), F.when(F.col("pred") == 1, "p")))
    runs = labelling.label_fields(pixels.select("raster_id", "y", "x", F.explode(layers).alias("layer")), ["raster_id", "layer"], 5)
    got = evaluation.tile_overlaps(runs, ["raster_id"]).groupBy("raster_id", "t", "p").agg(F.sum("both")).collect()
    seen, want = {}, {}
    for r in labelling.run_cells(runs).collect():
        seen.setdefault((r["raster_id"], r["y"], r["x"]), {})[r["layer"]] = r["comp"]
    for (k, _, _), at in seen.items():
        key = (k, at.get("t"), at.get("p"))
        want[key] = want.get(key, 0) + 1
    assert {tuple(r)[:3]: r[3] for r in got} == want


def test_one_layer_alone():
    runs = pa.table({"layer": ["p", "p"], "comp": [4, 4], "y": [0, 1], "x0": [4, 3], "x1": [5, 6]})
    assert evaluation._overlap_tile(runs).to_pylist() == [{"t": None, "p": 4, "both": 6}]


def test_no_row_per_cell(spark):
    pixels = spark.range(64).select(F.lit(1).alias("raster_id"), (F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"),
                                    F.lit(1).alias("cls"), F.lit(1).alias("pred"))
    met = evaluation.object_overlaps(pixels, ["raster_id"])
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence" not in plan
    assert [r["iou"] for r in met.collect()] == [1.0]
