"""Ring assembly, simplification and validity for polygons leaving the cell form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.operators import boundary

RING = "array<struct<x:double,y:double>>"


def _trace(name: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directed outlines of the fields of a tile, field on the left: corners of all rings, ring sizes, field of each ring.

    Rings are in order of their field and first corner, the leftmost one. Each is closed.
    """
    n, one = np.concatenate([name] * 4), np.ones(len(name), np.int64)
    y, x0, x1 = (v.astype(np.int64) for v in (y, x0, x1))
    right, below = x1 + 1, y + 1
    flat = boundary.line_sides(n, np.concatenate((y, y, below, below)), np.concatenate((x0, right, x0, right)), np.concatenate((one, -one, -one, one)))
    steep = boundary.line_sides(n, np.concatenate((x0, x0, right, right)), np.concatenate((y, below, y, below)), np.concatenate((-one, one, one, -one)))
    of = np.concatenate((flat[0], steep[0]))
    a = np.stack((np.concatenate((flat[2], steep[1])), np.concatenate((flat[1], steep[2]))), 1)
    b = np.stack((np.concatenate((flat[3], steep[1])), np.concatenate((flat[1], steep[3]))), 1)
    # the leftmost corner of a ring is never a corner touch
    order = np.lexsort((a[:, 1], a[:, 0], of))
    of, a, b = of[order], a[order], b[order]
    placed, bounds, _ = boundary.walked(boundary.followers(of, a, b))
    placed, bounds = np.array(placed, np.int64), np.array(bounds, np.int64)
    first = placed[bounds[:-1]]
    return np.insert(a[placed], bounds[1:], a[first], axis=0), np.diff(bounds) + 1, of[first]


def field_polygons(runs: DataFrame, group: list[str], field: str = "comp",
                   affine: tuple[float, ...] = (1, 0, 0, 0, 1, 0)) -> DataFrame:
    """Runs of each field -> ``exterior`` and ``interiors`` in map coordinates.

    ``group`` is the tile for fields cut at tiles, which keeps the partitioning of the labelling
    and the group bounded by the tile; a field's outline has to end up in one row anyway.
    """
    a, b, c, d, e, f = affine
    types = ", ".join(f"`{s.name}` {s.dataType.simpleString()}" for s in runs.select(*group, field).schema.fields)

    def run(tile: pa.Table) -> pa.Table:
        names, row, code = np.unique(tile[field].to_numpy(), return_index=True, return_inverse=True)
        points, sizes, of = _trace(code, *[tile[n].to_numpy() for n in ("y", "x0", "x1")])
        start = np.cumsum(sizes) - sizes
        p, q = points[:-1], points[1:]
        across = np.append(p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1], 0)
        across[start[1:] - 1] = 0
        outer = np.add.reduceat(across, start) > 0
        if not np.array_equal(of[outer], np.arange(len(names))):
            raise ValueError(f"a field of {[tile[k][0].as_py() for k in group]} is not one connected region")
        x, y = points[:, 0], points[:, 1]
        moved = pa.StructArray.from_arrays([pa.array(a * x + b * y + c, pa.float64()), pa.array(d * x + e * y + f, pa.float64())], ["x", "y"])
        traced = pa.ListArray.from_arrays(pa.array(np.append(start, len(points)), pa.int32()), moved)
        holes = np.bincount(of[~outer], minlength=len(names))
        inner = pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum(holes))), pa.int32()), traced.take(pa.array(np.flatnonzero(~outer))))
        held = tile.select([*group, field]).take(pa.array(row)).combine_chunks()
        return held.append_column("exterior", traced.take(pa.array(np.flatnonzero(outer)))).append_column("interiors", inner)

    return runs.select(*group, field, "y", "x0", "x1").groupBy(*group).applyInArrow(
        run, f"{types}, exterior {RING}, interiors array<{RING}>"
    )


def rejoin_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs cut at tile edges -> maximal runs of each ``label``."""
    row = Window.partitionBy(*keys, "label", "y").orderBy("x0")
    opens = F.when(F.lag("x1").over(row) + 1 == F.col("x0"), 0).otherwise(1)
    return (
        runs.withColumn("_o", opens)
        .withColumn("_p", F.sum("_o").over(row.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "label", "y", "_p").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_p")
    )


def _thin_line(pts: np.ndarray, tolerance: float) -> np.ndarray:
    """Farthest-point subdivision of one open or closed line; True where a vertex stays."""
    keep = np.zeros(len(pts), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(pts) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        base, inner = pts[hi] - pts[lo], pts[lo + 1:hi] - pts[lo]
        length = np.hypot(*base)
        if length == 0:
            dist = np.hypot(inner[:, 0], inner[:, 1])
        else:
            t = ((inner @ base) / length**2).clip(0, 1)
            dist = np.hypot(*(inner - t[:, None] * base).T)
        far = int(dist.argmax())
        if dist[far] > tolerance:
            keep[lo + 1 + far] = True
            todo += [(lo, lo + 1 + far), (lo + 1 + far, hi)]
    return keep


_RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def _thinned(rings: list[np.ndarray], tolerance: float) -> list[np.ndarray]:
    """All rings of a polygon with fewer vertices; a ring that would collapse stays as it is.

    The tolerance is halved until no ring crosses itself or another one and every hole lies inside the outer ring
    and outside the other holes; at last all stay.
    """
    while tolerance > 1e-9:
        out = []
        for pts in rings:
            keep = _thin_line(pts, tolerance)
            out.append(pts[keep] if keep.sum() >= 4 else pts)
        if all(len(a) == len(b) for a, b in zip(out, rings, strict=True)):
            break
        alone = all(_ring_is_simple(r[:, 0], r[:, 1]) for r in out)
        apart = alone and not any(_rings_cross(out[i], out[j]) for i in range(len(out)) for j in range(i))
        # rings that do not cross lie inside or outside each other as a whole
        if apart and all(_has_inside(out[0], h) for h in out[1:]) and not any(
                _has_inside(g, h) for i, g in enumerate(out[1:]) for j, h in enumerate(out[1:]) if i != j):
            return out
        tolerance /= 2
    return rings


def _has_inside(ring: np.ndarray, other: np.ndarray) -> bool:
    """True if most vertices of ``other`` lie inside a ring that it does not cross; those on the ring itself say nothing."""
    a, b, p = ring[:-1, None], ring[1:, None], other[None, :-1]
    spans = (np.minimum(a[..., 1], b[..., 1]) <= p[..., 1]) & (p[..., 1] < np.maximum(a[..., 1], b[..., 1]))
    rise = np.where(b[..., 1] == a[..., 1], 1.0, b[..., 1] - a[..., 1])
    left = a[..., 0] + (p[..., 1] - a[..., 1]) * (b[..., 0] - a[..., 0]) / rise <= p[..., 0]
    odd = (spans & left).sum(0) % 2 == 1
    cross = (b[..., 0] - a[..., 0]) * (p[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (p[..., 0] - a[..., 0])
    box = (np.minimum(a, b) <= p).all(-1) & (p <= np.maximum(a, b)).all(-1)
    clear = ~((cross == 0) & box).any(0)
    return bool(2 * odd[clear].sum() > clear.sum()) if clear.any() else True


def _rings_cross(a: np.ndarray, b: np.ndarray) -> bool:
    """True if a side of one ring properly crosses a side of the other."""
    p, q, r, s = a[:-1, None], a[1:, None], b[None, :-1], b[None, 1:]

    def turn(u, v, w):
        return np.sign((v[..., 0] - u[..., 0]) * (w[..., 1] - u[..., 1]) - (v[..., 1] - u[..., 1]) * (w[..., 0] - u[..., 0]))

    return bool(((turn(p, q, r) * turn(p, q, s) < 0) & (turn(r, s, p) * turn(r, s, q) < 0)).any())


def simplify(polygons: DataFrame, tolerance: float, column: str = "exterior", holes: str = "interiors") -> DataFrame:
    """Vertex reduction of the outer ring and, where the column exists, of the holes."""
    if tolerance <= 0:
        return polygons

    def array(ring) -> np.ndarray:
        return np.array([(p["x"], p["y"]) for p in ring], dtype=float)

    def points(ring: np.ndarray) -> list[dict]:
        return [{"x": x, "y": y} for x, y in ring.tolist()]

    ring = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    @F.arrow_udf(T.StructType([T.StructField("outer", _RING), T.StructField("inner", T.ArrayType(_RING))]))
    def reduced(outer: pa.Array, inner: pa.Array) -> pa.Array:
        made = [_thinned([array(o), *map(array, i or [])], tolerance) for o, i in zip(outer.to_pylist(), inner.to_pylist(), strict=True)]
        return pa.array([{"outer": points(m[0]), "inner": [points(r) for r in m[1:]]} for m in made],
                        pa.struct([("outer", ring), ("inner", pa.list_(ring))]))

    inner = F.col(holes) if holes in polygons.columns else F.array().cast(T.ArrayType(_RING))
    done = polygons.withColumn("_rings", reduced(F.col(column), inner)).withColumn(column, F.col("_rings.outer"))
    if holes in polygons.columns:
        done = done.withColumn(holes, F.col("_rings.inner"))
    return done.drop("_rings")


def _ring_is_simple(xs: np.ndarray, ys: np.ndarray) -> bool:
    """No two sides of the closed ring cross or overlap."""
    return bool(_rings_are_simple(xs[None], ys[None])[0])


def _rings_are_simple(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """The same for rings of equally many points, one a row."""
    if xs.shape[1] < 4:
        return np.zeros(len(xs), bool)
    ax, ay, bx, by = xs[:, :-1], ys[:, :-1], xs[:, 1:], ys[:, 1:]
    n = ax.shape[1]
    simple = (xs[:, 0] == xs[:, -1]) & (ys[:, 0] == ys[:, -1])
    for i in range(n - 1):
        at = np.flatnonzero(simple)
        j = np.arange(i + 1, n)
        ax1, ay1, bx1, by1 = (v[at, i, None] for v in (ax, ay, bx, by))
        ax2, ay2, bx2, by2 = (v[at, i + 1:] for v in (ax, ay, bx, by))

        def turn(px, py, qx, qy, rx, ry):
            return np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))

        o1, o2 = turn(ax1, ay1, bx1, by1, ax2, ay2), turn(ax1, ay1, bx1, by1, bx2, by2)
        o3, o4 = turn(ax2, ay2, bx2, by2, ax1, ay1), turn(ax2, ay2, bx2, by2, bx1, by1)
        apart = (
            (np.maximum(ax1, bx1) < np.minimum(ax2, bx2)) | (np.maximum(ax2, bx2) < np.minimum(ax1, bx1))
            | (np.maximum(ay1, by1) < np.minimum(ay2, by2)) | (np.maximum(ay2, by2) < np.minimum(ay1, by1))
        )
        meet = (o1 * o2 <= 0) & (o3 * o4 <= 0) & ~apart
        neighbour = (j == i + 1) | ((i == 0) & (j == n - 1))
        flat = (o1 == 0) & (o2 == 0)
        back = flat & ((bx1 - ax1) * (bx2 - ax2) + (by1 - ay1) * (by2 - ay2) < 0)
        simple[at] = ~((meet & ~neighbour) | (meet & neighbour & back)).any(1)
    return simple


# Points of rings that are judged together.
RING_POINTS = 1 << 17


def _simple_rings(rings: pa.Array) -> pa.Array:
    """Rings with the same number of points are judged together; a null is no ring."""
    sizes = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    points = rings.flatten()
    x, y = (pc.struct_field(points, c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
    first = np.cumsum(sizes) - sizes
    simple = np.zeros(len(sizes), bool)
    for size in np.unique(sizes[sizes > 0]):
        like = np.flatnonzero(sizes == size)
        for some in np.array_split(like, len(like) * int(size) // RING_POINTS + 1):
            at = first[some, None] + np.arange(size)
            simple[some] = _rings_are_simple(x[at].astype(float), y[at].astype(float))
    return pa.array(simple)


def valid_polygons(polygons: DataFrame, column: str = "exterior") -> DataFrame:
    """Keep polygons whose outer ring is closed, does not cross itself and has area.

    The test of the rings is the dear one. It is marked so that Spark does not move it below an exchange, to
    the few tasks that read a small file.
    """
    from furrow.functions.rings import ring_area

    simple = F.arrow_udf(_simple_rings, T.BooleanType()).asNondeterministic()
    solid = polygons.filter(F.col(column).isNotNull() & (ring_area(F.col(column)) > 0))
    return solid.filter(simple(F.col(column)))


def explode_parts(polygons: DataFrame, parts: str) -> DataFrame:
    """Multi-part shapes (array of rings) -> one row per part."""
    return polygons.withColumn("exterior", F.explode(parts)).drop(parts)
