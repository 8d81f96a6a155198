"""Footprints of several parts with holes: reading, validity, clipping, meeting, covered area.

A footprint is ``ARRAY<STRUCT<exterior, interiors>>``; rings are closed. All functions are Columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions import rings
from furrow.functions.rings import let

_POLYGON = "array<array<array<double>>>"


def _ring(coordinates: Column) -> Column:
    return F.transform(coordinates, lambda c: rings.point(F.get(c, F.lit(0)), F.get(c, F.lit(1))))


def _part(polygon: Column) -> Column:
    """Coordinates of a polygon: its outer ring first, then its holes."""
    return F.struct(
        _ring(F.get(polygon, F.lit(0))).alias("exterior"),
        F.transform(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), _ring).alias("interiors"),
    )


def from_geojson(kind: Column, coordinates: Column) -> Column:
    """``type`` and ``coordinates`` (as JSON text) of a geometry -> parts; null for other kinds and bad text."""
    polygon, several = F.from_json(coordinates, _POLYGON), F.from_json(coordinates, f"array<{_POLYGON}>")
    return F.when(kind == "Polygon", F.array(_part(polygon))).when(kind == "MultiPolygon", F.transform(several, _part))


def single(exterior: Column) -> Column:
    """One ring as a footprint."""
    return F.when(exterior.isNotNull(), F.array(F.struct(exterior.alias("exterior"), F.slice(F.array(exterior), 1, 0).alias("interiors"))))


def map_parts(parts: Column, fn: rings.XY) -> Column:
    return F.transform(parts, lambda p: F.struct(
        rings.map_ring(p["exterior"], fn).alias("exterior"), F.transform(p["interiors"], lambda r: rings.map_ring(r, fn)).alias("interiors")))


def all_rings(parts: Column) -> Column:
    return F.flatten(F.transform(parts, lambda p: F.concat(F.array(p["exterior"]), p["interiors"])))


def ring_sides(ring: Column) -> Column:
    return F.when(F.size(ring) > 1, F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(
        F.get(ring, i - 1).alias("a"), F.get(ring, i).alias("b")))).otherwise(F.slice(F.array(F.struct(F.get(ring, F.lit(0)).alias("a"), F.get(ring, F.lit(0)).alias("b"))), 1, 0))


def _sides(parts: Column) -> Column:
    return F.flatten(F.transform(all_rings(parts), ring_sides))


def _turn(a: Column, b: Column, c: Column) -> Column:
    """Positive if c lies to the left of the line from a to b."""
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def _cross(s: Column, t: Column) -> Column:
    """Sides pass through each other inside both."""
    return (_turn(s["a"], s["b"], t["a"]) * _turn(s["a"], s["b"], t["b"]) < 0) & (_turn(t["a"], t["b"], s["a"]) * _turn(t["a"], t["b"], s["b"]) < 0)


def _within(p: Column, s: Column) -> Column:
    """A point on a side, its ends included."""
    a, b = s["a"], s["b"]
    return (
        (_turn(a, b, p) == 0) & p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))
        & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
    )


def sides_meet(s: Column, t: Column) -> Column:
    """Sides share a point."""
    return _cross(s, t) | _within(s["a"], t) | _within(s["b"], t) | _within(t["a"], s) | _within(t["b"], s)


def contains_point(parts: Column, p: Column) -> Column:
    """Even-odd test over all rings."""
    def left_of(s: Column) -> Column:
        a, b = s["a"], s["b"]
        spans = (F.least(a["y"], b["y"]) <= p["y"]) & (p["y"] < F.greatest(a["y"], b["y"]))
        return spans & (a["x"] + (p["y"] - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) <= p["x"])

    return F.size(F.filter(_sides(parts), lambda s: F.coalesce(left_of(s), F.lit(False)))) % 2 == 1


def _split(parts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All rings of a batch, outer ones first, the part of each, which ones are outer, and the row of each part."""
    row = np.repeat(np.arange(len(parts)), parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = parts.flatten()
    outer, inner = pc.struct_field(flat, "exterior"), pc.struct_field(flat, "interiors")
    part = np.repeat(np.arange(len(row)), inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    rings_ = pa.concat_arrays([outer, inner.flatten()])
    return rings_, np.concatenate((np.arange(len(row)), part)), np.arange(len(rings_)) < len(row), row


def _points(rings_: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points of rings one after the other, and the number of points of each."""
    points = rings_.flatten()
    x, y = (pc.struct_field(points, c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
    return x, y, rings_.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _side_starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first points of all sides, and their rings."""
    ring = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(ring[:-1] == ring[1:]) if len(ring) else np.zeros(0, np.int64)
    return at, ring[at]


def _areas(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    at, ring = _side_starts(sizes)
    return np.abs(np.bincount(ring, weights=x[at] * y[at + 1] - x[at + 1] * y[at], minlength=len(sizes))) / 2


# Pairs of a side and a point that are looked at together.
POINTS = 1 << 17


def _rings_valid(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Closed, with area, and no two sides that cross; rings of equally many points are judged together."""
    start = _starts(sizes)
    valid = (sizes > 3) & (_areas(x, y, sizes) > 0)
    at = np.flatnonzero(valid)
    valid[at] = (x[start[at]] == x[start[at] + sizes[at] - 1]) & (y[start[at]] == y[start[at] + sizes[at] - 1])
    for size in np.unique(sizes[valid]).tolist():
        like = np.flatnonzero(valid & (sizes == size))
        for some in np.array_split(like, len(like) * size // POINTS + 1):
            own = start[some, None] + np.arange(size)
            px, py = x[own], y[own]

            def turn(i, j, k):
                return (px[:, j] - px[:, i]) * (py[:, k] - py[:, i]) - (py[:, j] - py[:, i]) * (px[:, k] - px[:, i])

            crossed = np.zeros(len(some), bool)
            for i in range(size - 2):
                one, two, c, d = slice(i, i + 1), slice(i + 1, i + 2), slice(i + 1, size - 1), slice(i + 2, size)
                crossed |= ((turn(one, two, c) * turn(one, two, d) < 0) & (turn(c, d, one) * turn(c, d, two) < 0)).any(1)
            valid[some] = ~crossed
    return valid


@F.arrow_udf(T.BooleanType())
def _parts_valid(parts: pa.Array) -> pa.Array:
    rings_, part, outer, row = _split(parts)
    x, y, sizes = _points(rings_)
    good, start = _rings_valid(x, y, sizes), _starts(sizes)
    # sides of the outer ring of each hole, for the even-odd test of the hole's first point
    holes = np.flatnonzero(~outer & good)
    n = np.maximum(sizes[part[holes]] - 1, 0)
    of = np.repeat(np.arange(len(holes)), n)
    a = np.repeat(start[part[holes]] - _starts(n), n) + np.arange(len(of))
    px, py = x[start[holes]][of], y[start[holes]][of]
    spans = (np.minimum(y[a], y[a + 1]) <= py) & (py < np.maximum(y[a], y[a + 1]))
    rise = np.where(y[a + 1] == y[a], 1.0, y[a + 1] - y[a])
    left = spans & (x[a] + (py - y[a]) * (x[a + 1] - x[a]) / rise <= px)
    good[holes] = np.bincount(of, weights=left, minlength=len(holes)) % 2 == 1
    known = pc.is_valid(pc.struct_field(parts.flatten(), "interiors")).to_numpy(zero_copy_only=False)
    bad = np.bincount(row[part], weights=~good, minlength=len(parts)) + np.bincount(row, weights=~known, minlength=len(parts))
    return pa.array((np.bincount(row, minlength=len(parts)) > 0) & (bad == 0))


def parts_valid(parts: Column) -> Column:
    """At least one part, valid rings (closed, with area, no two sides that cross), and each hole starts inside its outer ring."""
    return _parts_valid(parts)


def parts_area(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + rings.polygon_area(p["exterior"], p["interiors"]))


def _kept_side(ring: Column, away: Callable[[Column], Column]) -> Column:
    """Half-plane clip: the part of a ring where ``away(point)`` is not negative."""
    def cut(a: Column, b: Column, da: Column, db: Column) -> Column:
        share = da / (da - db)
        return rings.point(a["x"] + share * (b["x"] - a["x"]), a["y"] + share * (b["y"] - a["y"]))

    def step(s: Column) -> Column:
        a, b, da, db = s["a"], s["b"], away(s["a"]), away(s["b"])
        crossing = cut(a, b, da, db)
        none = F.slice(F.array(b), 1, 0)
        return F.when((da >= 0) & (db >= 0), F.array(b)).when((da >= 0) & (db < 0), F.array(crossing)).when(
            (da < 0) & (db >= 0), F.array(crossing, b)).otherwise(none)

    return let(let(ring, lambda r: F.flatten(F.transform(ring_sides(r), step))), lambda p: F.concat(p, F.slice(p, 1, 1)))


def clip_ring(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A ring inside a box; a ring that enters several times keeps joining stretches along the box, without area."""
    for away in (lambda p: p["x"] - x0, lambda p: x1 - p["x"], lambda p: p["y"] - y0, lambda p: y1 - p["y"]):
        ring = _kept_side(ring, away)
    return ring


def clip_ring_to(ring: Column, convex: Column) -> Column:
    """A ring inside a convex ring that runs counter-clockwise: one half-plane after the other."""
    return F.aggregate(ring_sides(convex), ring, lambda left, s: _kept_side(left, lambda p: _turn(s["a"], s["b"], p)))


def clip_parts(parts: Column, clip: Callable[[Column], Column]) -> Column:
    """All rings clipped; parts and holes that lose their area fall away."""
    def solid(ring: Column) -> Column:
        return (F.size(ring) > 3) & (rings.ring_area(ring) > 0)

    cut = F.transform(parts, lambda p: F.struct(
        clip(p["exterior"]).alias("exterior"), F.filter(F.transform(p["interiors"], clip), solid).alias("interiors")))
    return F.filter(cut, lambda p: solid(p["exterior"]))


def _kept_points(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_kept_side`` of all rings at once."""
    a, ring = _side_starts(sizes)
    da, db = away[a], away[a + 1]
    crossing = (da >= 0) != (db >= 0)
    share = da / np.where(crossing, da - db, 1.0)
    kept = np.stack((crossing, db >= 0), 1).ravel()
    px, py = (np.stack((v[a] + share * (v[a + 1] - v[a]), v[a + 1]), 1).ravel()[kept] for v in (x, y))
    n = np.bincount(np.repeat(ring, 2)[kept], minlength=len(sizes))
    some = n > 0
    first, end = _starts(n)[some], np.cumsum(n)[some]
    return np.insert(px, end, px[first]), np.insert(py, end, py[first]), n + some


_RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
_PARTS = T.ArrayType(T.StructType([T.StructField("exterior", _RING), T.StructField("interiors", T.ArrayType(_RING))]))


@F.arrow_udf(_PARTS)
def _clipped(parts: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
    rings_, part, outer, row = _split(parts)
    x, y, sizes = _points(rings_)
    for side, sign, of_x in ((x0, 1, True), (x1, -1, True), (y0, 1, False), (y1, -1, False)):
        limit = side.to_numpy(zero_copy_only=False).astype(float)[np.repeat(row[part], sizes)]
        x, y, sizes = _kept_points(x, y, sizes, sign * ((x if of_x else y) - limit))
    solid = (sizes > 3) & (_areas(x, y, sizes) > 0)
    kept = solid[part] & solid
    on = np.repeat(kept, sizes)
    points = pa.StructArray.from_arrays([pa.array(x[on]), pa.array(y[on])], ["x", "y"])
    made = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes[kept]))), pa.int32()), points)
    n, held = int((kept & outer).sum()), kept[outer]
    holes = np.bincount(part[kept & ~outer], minlength=len(row))[held]
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(holes))), pa.int32()), made[n:])
    each = pa.StructArray.from_arrays([made[:n], inner], ["exterior", "interiors"])
    counts = np.bincount(row[held], minlength=len(parts))
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), each, mask=pc.is_null(parts))


def clip_parts_to_box(parts: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """``clip_parts`` by ``clip_ring``, for all rows of a batch at once."""
    return _clipped(parts, x0, y0, x1, y1)


def covered_area(parts: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of a footprint inside a box, without building the clipped rings."""
    def inside(ring: Column) -> Column:
        return rings.clip_area(ring, x0, y0, x1, y1)

    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + inside(p["exterior"]) - F.aggregate(
        p["interiors"], F.lit(0.0), lambda hole, r: hole + inside(r)))


def separated(a: Column, b: Column) -> Column:
    """Some side of either ring has the two rings strictly on different sides of its line (separating axis)."""
    def parted(own: Column, other: Column) -> Column:
        return F.exists(ring_sides(own), lambda s: (
            F.forall(own, lambda p: _turn(s["a"], s["b"], p) >= 0) & F.forall(other, lambda p: _turn(s["a"], s["b"], p) < 0)
        ) | (F.forall(own, lambda p: _turn(s["a"], s["b"], p) <= 0) & F.forall(other, lambda p: _turn(s["a"], s["b"], p) > 0)))

    return parted(a, b) | parted(b, a)


def parts_meet(a: Column, b: Column) -> Column:
    """Two footprints share a point: exact for any rings, parts and holes.

    Pairs of outer rings that an axis separates are left at once; else sides meet, or one footprint lies in the other.
    """
    def meet(own: Column, other: Column) -> Column:
        near = F.exists(own, lambda p: F.exists(other, lambda q: ~separated(p["exterior"], q["exterior"])))
        touching = let(_sides(other), lambda sides: F.exists(_sides(own), lambda s: F.exists(sides, lambda t: sides_meet(s, t))))
        inside = F.exists(own, lambda p: contains_point(other, F.get(p["exterior"], F.lit(0)))) | F.exists(
            other, lambda q: contains_point(own, F.get(q["exterior"], F.lit(0))))
        return near & (touching | inside)

    return F.coalesce(let(a, lambda x: let(b, lambda y: meet(x, y))), F.lit(False))
