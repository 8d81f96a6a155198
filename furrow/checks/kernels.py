"""Array kernels and user hooks: model scoring, detection, edges, augmentation, projection, hooks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from furrow.checks import bindings as B
from furrow.checks.registry import query, with_
from furrow.functions import raster_math as M
from furrow.functions import rings
from furrow.operators import components, sampling, scoring, stencil


def _toy_model():
    """Stands for a network: class scores from band sums."""
    def predict(images: np.ndarray) -> np.ndarray:
        return np.stack([images[:, 0:3].sum((1, 2)), images[:, 3:6].sum((1, 2)), images[:, 6:8].sum((1, 2))], axis=1)

    return predict


@query("U1_batch_scoring", with_(B.VECTORS_SQL, """
z AS (SELECT vec_id, sum(CASE WHEN y < 3 THEN q END) AS z0, sum(CASE WHEN y BETWEEN 3 AND 5 THEN q END) AS z1, sum(CASE WHEN y > 5 THEN q END) AS z2 FROM qcells GROUP BY 1)""", body="""
SELECT vec_id, CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END::BIGINT AS cls FROM z"""))
def batch_scoring(spark, sf_dir):
    """A batch model over every chip, then the class."""
    v = B.vectors(spark, sf_dir).select("vec_id", F.col("q").cast("array<double>").alias("image"))
    scored = scoring.score_patches(v, "image", [8, 8], _toy_model)
    return scored.select("vec_id", M.argmax(F.col("logits")).alias("cls"))


@query("U2_detection_scoring", with_(B.VECTORS_SQL, body="SELECT vec_id, y AS row, x AS col, round(q / 1000.0::DOUBLE, 6) AS conf FROM qcells WHERE q > 100"))
def detection_scoring(spark, sf_dir):
    """Each chip becomes as many detections as it has bright cells."""
    def bright(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.stack(pdf["q"].to_list()).reshape(-1, 8, 8)
        i, r, c = np.nonzero(grid > 100)
        return pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy()[i], "row": r, "col": c, "conf": grid[i, r, c] / 1000.0})

    return scoring.detect(B.vectors(spark, sf_dir), ["vec_id", "q"], bright, "vec_id bigint, row int, col int, conf double")


@query("U3_geometry_hook", with_(B.BOXES_SQL, body="SELECT id, (x1 - x0) * (y1 - y0) * 6 AS area FROM boxes"))
def geometry_hook(spark, sf_dir):
    """A user's coordinate function applied before measuring."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    moved = rings.map_ring(rings.box_ring(x0, y0, x1, y1), lambda x, y: (x * 2 + 5, y * 3 - 1))
    return B.boxes(spark, sf_dir).select("id", rings.ring_area(moved).alias("area"))


@query("U6_sample_transforms", with_(B.VECTORS_SQL, body="SELECT vec_id, i, round(least(greatest((63 - 2 * i + q) / 3000.0::DOUBLE, 0), 1), 6) AS v FROM qcells"))
def sample_transforms(spark, sf_dir):
    """A chain of user transforms on samples."""
    def shift(df):
        return df.withColumn("q", F.transform("q", lambda v, i: v + 63 - 2 * i))

    def scale(df):
        return df.withColumn("q", M.normalise(F.col("q")))

    def clip(df):
        return df.withColumn("q", F.transform("q", lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))))

    v = B.vectors(spark, sf_dir).transform(shift).transform(scale).transform(clip)
    return v.select("vec_id", F.posexplode("q").alias("i", "v"))


def _bands(spark, sf_dir):
    """Chips of 8 bands x 8 x 8: band b is the chip shifted by b cells."""
    v = B.vectors(spark, sf_dir)
    shifted = [F.concat(F.slice("q", b + 1, 64 - b), F.slice("q", 1, b)) for b in range(8)]
    return v.select("vec_id", F.array(*shifted).alias("bands"))


@query("U5_A20_edge_sum")
def edge_sum(spark, sf_dir):
    return stencil.edge_sum(_bands(spark, sf_dir), "vec_id", "bands", 8, 8).select("vec_id", F.posexplode("edges").alias("i", "v"))


@query("R4_augmentation")
def augmentation(spark, sf_dir):
    chips = B.vectors(spark, sf_dir).select("vec_id", "v", F.transform("q", lambda q: F.abs(q) % 3).alias("mask"))
    out = sampling.augment_chips(chips, "vec_id", "v", 1, 8, 8, mask="mask", crop=True)
    return out.select("vec_id", F.posexplode(F.arrays_zip("v", "mask")).alias("i", "z")).select("vec_id", "i", "z.v", "z.mask")


@query("U9_principal_components")
def principal_components(spark, sf_dir):
    """Two principal components of the embeddings, centred first."""
    made, shares = components.principal_components(B.vectors(spark, sf_dir), "v", 2)
    return made.select("vec_id", F.get("pc", F.lit(0)).alias("pc0"), F.get("pc", F.lit(1)).alias("pc1"), F.lit(float(shares.sum())).alias("explained"))


@query("U9_component_variances", with_(B.VECTORS_SQL, """
flat AS (SELECT vec_id, i, v[i + 1] - avg(v[i + 1]) OVER (PARTITION BY i) AS x FROM vectors, range(64) t(i)),
cov AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / (count(*) - 1) AS c FROM flat a JOIN flat b USING (vec_id) GROUP BY 1, 2)""", body="""
SELECT round(sum(c) FILTER (i = j), 6) AS trace, round(sum(c * c), 6) AS squares, (SELECT count(*) FROM vectors)::BIGINT AS n FROM cov"""))
def component_variances(spark, sf_dir):
    """The variances of all components: their sum is the trace of the covariance, their squares sum to its squared entries."""
    mean, matrix, n = components.covariance(B.vectors(spark, sf_dir), "v")
    values, _ = components.directions(matrix, len(mean))
    own = B.vectors(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    return own.select(F.lit(float(values.sum())).alias("trace"), F.lit(float((values ** 2).sum())).alias("squares"), "n").filter(F.col("n") == n)
