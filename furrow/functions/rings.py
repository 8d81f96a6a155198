"""Planar geometry on rings held as ``ARRAY<STRUCT<x, y>>`` (closed: first point repeated last)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

XY = Callable[[Column, Column], tuple[Column, Column]]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for a body that names it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Counter-clockwise closed ring of an axis-aligned box."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def close_ring(xs: Column, ys: Column) -> Column:
    """Two coordinate arrays -> closed ring."""
    return let(
        F.zip_with(xs, ys, point),
        lambda p: F.when(F.get(p, F.lit(0)) == F.get(p, F.size(p) - 1), p).otherwise(
            F.concat(p, F.slice(p, 1, 1))
        ),
    )


def _fold(ring: Column, term: Callable[[Column, Column], Column]) -> Column:
    """Sum ``term`` over consecutive vertex pairs; the ring is walked once."""
    return let(
        ring,
        lambda r: F.aggregate(
            F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))),
            F.struct(F.lit(0.0).alias("total"), F.get(r, F.lit(0)).alias("prev")),
            lambda acc, p: F.struct(
                (acc["total"] + term(acc["prev"], p)).alias("total"), p.alias("prev")
            ),
            lambda acc: acc["total"],
        ),
    )


def signed_area(ring: Column) -> Column:
    return _fold(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def ring_length(ring: Column) -> Column:
    return _fold(ring, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))


def polygon_area(exterior: Column, interiors: Column) -> Column:
    """Area with holes taken out."""
    return ring_area(exterior) - F.aggregate(
        interiors, F.lit(0.0), lambda acc, r: acc + ring_area(r)
    )


def polygon_length(exterior: Column, interiors: Column) -> Column:
    """Length of all rings, holes included."""
    return ring_length(exterior) + F.aggregate(
        interiors, F.lit(0.0), lambda acc, r: acc + ring_length(r)
    )


def ring_bbox(ring: Column) -> Column:
    def axis(r: Column, name: str) -> Column:
        return F.transform(r, lambda p: p[name])

    return let(
        ring,
        lambda r: F.struct(
            F.array_min(axis(r, "x")).alias("xmin"), F.array_min(axis(r, "y")).alias("ymin"),
            F.array_max(axis(r, "x")).alias("xmax"), F.array_max(axis(r, "y")).alias("ymax"),
        ),
    )


def map_ring(ring: Column, fn: XY) -> Column:
    """Apply a coordinate function (affine, projection, user hook) to every vertex."""
    return F.transform(ring, lambda p: point(*fn(p["x"], p["y"])))


def affine_ring(ring: Column, a, b, c, d, e, f) -> Column:
    return map_ring(ring, lambda x, y: (a * x + b * y + c, d * x + e * y + f))


def drop_interiors(interiors: Column) -> Column:
    """An empty list of holes of the same type."""
    return F.slice(interiors, 1, 0)


def clip_area(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of a closed simple ring inside an axis-aligned box.

    Walking the ring, each side adds the area under it with x kept to [x0, x1] and y to
    [y0, y1]; sides running back take the rest off again. One pass, no clipped ring is built.
    """
    def between(v: Column, low: Column, high: Column) -> Column:
        return F.least(F.greatest(v, low), high)

    def under(a: Column, b: Column) -> Column:
        cut = F.struct(between(a["x"], x0, x1).alias("xa"), between(b["x"], x0, x1).alias("xb"))

        def clipped(c: Column) -> Column:
            slope = (b["y"] - a["y"]) / (b["x"] - a["x"])
            ua = a["y"] - y0 + slope * (c["xa"] - a["x"])
            ub = a["y"] - y0 + slope * (c["xb"] - a["x"])
            span = F.struct(
                F.least(ua, ub).alias("lo"), F.greatest(ua, ub).alias("hi"), (c["xb"] - c["xa"]).alias("dx"))
            return F.when(c["xa"] == c["xb"], F.lit(0.0)).otherwise(let(span, strip))

        return let(cut, clipped)

    def strip(s: Column) -> Column:
        height, zero = y1 - y0, F.lit(0.0)
        low, high = between(s["lo"], zero, height), between(s["hi"], zero, height)
        above = F.greatest(s["hi"] - F.greatest(s["lo"], height), zero)
        mean = F.when(s["hi"] == s["lo"], low).otherwise(
            ((low + high) / 2 * (high - low) + height * above) / (s["hi"] - s["lo"]))
        return s["dx"] * mean

    return F.abs(_fold(ring, under))
