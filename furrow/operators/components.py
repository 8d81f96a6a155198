"""Principal components of array columns by a centred Gramian."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covariance(rows: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean vector, covariance matrix and number of rows of an array column of one length.

    Each task sums the products of its centred rows; only these d x d sums are added up over the table and
    reach the driver. Arrays that are null or hold nulls take no part.
    """
    full = rows.filter(F.col(column).isNotNull() & ~F.exists(column, lambda v: v.isNull())).select(F.col(column).cast("array<double>").alias("v"))
    means = [r["m"] for r in full.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()]
    mean, d = np.array(means), len(means)

    def gramian(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((d, d)), 0
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - mean
            total += x.T @ x
            n += len(x)
        at = np.arange(d * d)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()), pa.array(np.full(d * d, n))], names=["at", "total", "n"])

    if not d:
        return mean, np.zeros((0, 0)), 0
    sums = full.mapInArrow(gramian, "at bigint, total double, n bigint").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("at").collect()
    n = sums[0]["n"]
    return mean, np.array([r["total"] for r in sums]).reshape(d, d) / max(1, n - 1), n


def directions(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their directions as rows; the entry of greatest size of each is positive."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:k]
    found = vectors[:, order].T
    sign = np.sign(found[np.arange(len(found)), np.abs(found).argmax(1)]) if found.size else np.ones(len(found))
    return values[order], found * sign[:, None]


def principal_components(rows: DataFrame, column: str, k: int, name: str = "pc") -> tuple[DataFrame, np.ndarray]:
    """Add the ``k`` coordinates of each row along the components; and each component's share of the variance."""
    mean, matrix, _ = covariance(rows, column)
    values, found = directions(matrix, k)

    def along(direction: np.ndarray):
        steps = F.zip_with(F.zip_with(column, F.lit(mean.tolist()), lambda v, m: v.cast("double") - m), F.lit(direction.tolist()), lambda v, w: v * w)
        return F.aggregate(steps, F.lit(0.0), lambda acc, v: acc + v)

    return rows.withColumn(name, F.array(*[along(f) for f in found])), values / max(np.trace(matrix), 1e-300)
