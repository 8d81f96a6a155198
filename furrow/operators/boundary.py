"""Outlines of unions as rings: edge cancellation, then list ranking.

A region is a set of disjoint rectangles under one label (runs of cells, strips of dissolved boxes). Its sides
are what is left after opposite sides on one line cancel, so a line with many rectangles costs a sum over its
events. Sides are linked to chains tile by tile; chains that leave their tile are linked by joins, and their
place in the ring is found by pointer jumping: with every round a chain knows the least chain among twice
as many followers. No group holds a region, only its finished ring is one row.

Directions are those of rows counted downwards: an outer ring has a positive area there, a hole a negative one.
Where two rectangles of a region meet in a corner only, the ring keeps to the same rectangle, so parts that touch
in a point are parts of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import rings
from furrow.session import cut

BAND = 64.0  # height of the bands in which holes look for the side to their left


def run_boxes(runs: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Runs of cells as rectangles in cell corners."""
    return runs.select(
        *keys, label, F.col("x0").cast("double").alias("x0"), F.col("y").cast("double").alias("y0"),
        (F.col("x1") + 1).cast("double").alias("x1"), (F.col("y") + 1).cast("double").alias("y1"),
    )


def boundary_sides(boxes: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``keys, label, ax, ay, bx, by``: straight sides from corner to corner, region to the left.

    Every rectangle opens and closes an interval on each of its four lines; where a neighbour continues,
    the sums are 0 and nothing is left. Sums are combined map-side.
    """
    def event(axis: str, line: str, pos: str, sign: int) -> Column:
        return F.struct(F.lit(axis).alias("axis"), F.col(line).alias("line"), F.col(pos).alias("pos"), F.lit(sign).alias("sign"))

    events = F.array(
        event("h", "y0", "x0", 1), event("h", "y0", "x1", -1), event("h", "y1", "x0", -1), event("h", "y1", "x1", 1),
        event("v", "x0", "y0", -1), event("v", "x0", "y1", 1), event("v", "x1", "y0", 1), event("v", "x1", "y1", -1),
    )
    solid = boxes.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    return _left_over(solid.select(*keys, label, F.explode(events).alias("e")).select(*keys, label, "e.*"), keys, label)


def _left_over(events: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Ends of intervals ``axis, line, pos, sign`` -> the sides that are left."""
    line = [*keys, label, "axis", "line"]
    left = events.groupBy(*line, "pos").agg(F.sum("sign").alias("sign")).filter("sign <> 0")
    along = Window.partitionBy(*line).orderBy("pos")
    sides = left.withColumns({"level": F.sum("sign").over(along), "end": F.lead("pos").over(along)}).filter("level <> 0")
    low, high = F.struct(F.col("pos").alias("p")), F.struct(F.col("end").alias("p"))
    sides = sides.withColumns({"a": F.when(F.col("level") > 0, low).otherwise(high)["p"], "b": F.when(F.col("level") > 0, high).otherwise(low)["p"]})
    flat = F.col("axis") == "h"
    return sides.select(
        *keys, label, F.when(flat, F.col("a")).otherwise(F.col("line")).alias("ax"), F.when(flat, F.col("line")).otherwise(F.col("a")).alias("ay"),
        F.when(flat, F.col("b")).otherwise(F.col("line")).alias("bx"), F.when(flat, F.col("line")).otherwise(F.col("b")).alias("by"),
    )


def line_sides(name: np.ndarray, line: np.ndarray, pos: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, ...]:
    """What is left of opposite sides on each line of a field: its name, the line, from and to."""
    order = np.lexsort((pos, line, name))
    name, line, pos, sign = (v[order] for v in (name, line, pos, sign))
    new = np.concatenate(([True], (np.diff(name) != 0) | (np.diff(line) != 0) | (np.diff(pos) != 0)))
    left = np.add.reduceat(sign, np.flatnonzero(new))
    name, line, pos = (v[new][left != 0] for v in (name, line, pos))
    level = np.cumsum(left[left != 0])  # back at 0 at the end of each line
    at = np.flatnonzero(level)
    ahead = level[at] > 0
    return name[at], line[at], np.where(ahead, pos[at], pos[at + 1]), np.where(ahead, pos[at + 1], pos[at])


def _block_sides(boxes: pa.Table, label: str, tile: float) -> pa.Table:
    """Sides of the boxes of one block; those that end on its edge or lie in it are open: a neighbour may go on there."""
    _, row, code = np.unique(boxes[label].to_numpy(), return_index=True, return_inverse=True)
    x0, y0, x1, y1 = (boxes[c].to_numpy() for c in ("x0", "y0", "x1", "y1"))
    n, one = np.concatenate([code] * 4), np.ones(len(code), np.int64)
    flat = line_sides(n, np.concatenate((y0, y0, y1, y1)), np.concatenate((x0, x1, x0, x1)), np.concatenate((one, -one, -one, one)))
    steep = line_sides(n, np.concatenate((x0, x0, x1, x1)), np.concatenate((y0, y1, y0, y1)), np.concatenate((-one, one, one, -one)))
    of, line, a, b = (np.concatenate(pair) for pair in zip(flat, steep, strict=True))
    level = np.arange(len(of)) < len(flat[0])
    edge = (line % tile == 0) | (a % tile == 0) | (b % tile == 0)
    held = boxes.drop_columns(["x0", "y0", "x1", "y1"]).take(pa.array(row[of]))
    for name, c in {"flat": level, "line": line, "a": a, "b": b, "open": edge}.items():
        held = held.append_column(name, pa.array(c))
    return held


def boundary_sides_in_blocks(boxes: DataFrame, keys: list[str], label: str, tile: float) -> DataFrame:
    """``boundary_sides`` of boxes that each lie in one square of side ``tile``.

    Opposite sides cancel square by square, and only what meets the edge of a square is summed up over the table.
    """
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in boxes.select(*keys, label).schema.fields)
    block = {"_by": F.floor(F.col("y0") / tile), "_bx": F.floor(F.col("x0") / tile)}
    held = [*keys, label, "x0", "y0", "x1", "y1"]
    solid = boxes.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).select(*held, *[c.alias(n) for n, c in block.items()])
    found = cut(solid.groupBy(*keys, *block).applyInArrow(
        lambda t: _block_sides(t.select(held), label, tile), f"{types}, flat boolean, line double, a double, b double, open boolean"))
    axis = F.when(F.col("flat"), F.lit("h")).otherwise(F.lit("v")).alias("axis")
    ends = F.explode(F.array(F.struct(F.col("a").alias("pos"), F.lit(1).alias("sign")), F.struct(F.col("b").alias("pos"), F.lit(-1).alias("sign")))).alias("e")
    events = found.filter("open").select(*keys, label, axis, "line", ends).select(*keys, label, "axis", "line", "e.*")
    flat = F.col("flat")
    done = found.filter("NOT open").select(
        *keys, label, F.when(flat, F.col("a")).otherwise(F.col("line")).alias("ax"), F.when(flat, F.col("line")).otherwise(F.col("a")).alias("ay"),
        F.when(flat, F.col("b")).otherwise(F.col("line")).alias("bx"), F.when(flat, F.col("line")).otherwise(F.col("b")).alias("by"))
    return done.unionByName(_left_over(events, keys, label))


def followers(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each side from ``a`` to ``b`` the one that goes on there, -1 if it is in another tile."""
    n = len(label)
    names = np.concatenate((label, label))
    x, y = np.concatenate((a[:, 0], b[:, 0])), np.concatenate((a[:, 1], b[:, 1]))
    order = np.lexsort((y, x, names))
    new = np.concatenate(([False], (np.diff(names[order]) != 0) | (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)))
    vertex = np.empty(2 * n, np.int64)
    vertex[order] = np.cumsum(new)
    starts, ends = vertex[:n], vertex[n:]
    by = np.argsort(starts, kind="stable")
    first = np.searchsorted(starts[by], ends, "left")
    count = np.searchsorted(starts[by], ends, "right") - first
    one = by[np.minimum(first, n - 1)]
    two = by[np.minimum(first + 1, n - 1)]
    way = b - a

    def turn(other: np.ndarray) -> np.ndarray:
        return way[:, 0] * way[other, 1] - way[:, 1] * way[other, 0]

    return np.where(count == 0, -1, np.where((count > 1) & (turn(two) > turn(one)), two, one))


def walked(follower: np.ndarray) -> tuple[list[int], list[int], list[bool]]:
    """Sides in the order of their chains, the bounds of these, and which of them close. Rings begin at their first side."""
    led = np.zeros(len(follower), bool)
    led[follower[follower >= 0]] = True
    after, seen = follower.tolist(), bytearray(len(follower))
    placed, bounds, closed = [], [0], []
    for start in [*np.flatnonzero(~led).tolist(), *range(len(follower))]:
        if seen[start]:
            continue
        i = start
        while i >= 0 and not seen[i]:
            seen[i] = 1
            placed.append(i)
            i = after[i]
        bounds.append(len(placed))
        closed.append(i == start)
    return placed, bounds, closed


def _chains(sides: pa.Table, keys: list[str], label: str) -> pa.Table:
    """Sides of one tile -> chains in the order of their sides; rings that close in the tile are done."""
    a = np.stack((sides["ax"].to_numpy(), sides["ay"].to_numpy()), 1)
    b = np.stack((sides["bx"].to_numpy(), sides["by"].to_numpy()), 1)
    codes = sides[label].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    placed, bounds, closed = walked(followers(codes, a, b))
    order, heads = np.array(placed, np.int64), np.array(bounds[:-1], np.int64)
    first, last = order[heads], order[np.array(bounds[1:], np.int64) - 1]
    p, q = a[order], b[order]
    way = b - a
    rows = [sides[k].take(pa.array(first)) for k in (*keys, label)]
    offsets = pa.array(bounds, pa.int32())
    points = pa.StructArray.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["x", "y"])
    columns = {
        "hx": a[first, 0], "hy": a[first, 1], "hdx": way[first, 0], "hdy": way[first, 1],
        "tx": b[last, 0], "ty": b[last, 1], "tdx": way[last, 0], "tdy": way[last, 1],
        "closed": np.array(closed, bool),
        "twice": np.add.reduceat(p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1], heads),
        "across": np.add.reduceat(np.abs(q[:, 0] - p[:, 0]), heads), "down": np.add.reduceat(np.abs(q[:, 1] - p[:, 1]), heads),
    }
    return pa.table([*rows, *[pa.array(c) for c in columns.values()], pa.ListArray.from_arrays(offsets, points)],
                    names=[*keys, label, *columns, "points"])


_CHAIN = ", ".join(f"{c} double" for c in ("hx", "hy", "hdx", "hdy", "tx", "ty", "tdx", "tdy")) + (
    ", closed boolean, twice double, across double, down double, points array<struct<x: double, y: double>>")


def ring_places(links: DataFrame) -> DataFrame:
    """List ranking on cycles: ``id, nxt`` -> ``id, low, at``.

    ``low`` is the least id of the cycle and ``at`` the steps from a node to it. The last round changed nothing,
    which on cycles means that every node has seen its whole cycle.
    """
    state = cut(links.select("id", "nxt", F.col("id").alias("low"), F.lit(0).cast("bigint").alias("at")))
    width = 1
    while True:
        ahead = state.select(F.col("id").alias("nxt"), F.col("nxt").alias("n2"), F.col("low").alias("l2"), F.col("at").alias("a2"))
        better = F.col("l2") < F.col("low")
        state = cut(state.join(ahead, "nxt").select(
            "id", F.col("n2").alias("nxt"), F.least("low", "l2").alias("low"),
            F.when(better, F.col("a2") + width).otherwise(F.col("at")).alias("at"), better.alias("better"),
        ))
        if state.filter("better").isEmpty():
            return state.select("id", "low", "at")
        width *= 2


def outline_rings(boxes: DataFrame, keys: list[str], label: str, tile: float, inside: bool = False) -> DataFrame:
    """Rings of each region: ``keys, label, ring, points, twice, across, down``.

    ``points`` is closed and holds corners only; ``twice`` is twice the signed area, ``across`` and ``down`` the
    lengths of the level and the upright sides. ``tile`` is the side of the squares that are linked in one task;
    ``inside`` says that each box lies in one of them.
    """
    sides = boundary_sides_in_blocks(boxes, keys, label, tile) if inside else boundary_sides(boxes, keys, label)
    placed = sides.withColumns({"sx": F.floor(F.col("ax") / tile), "sy": F.floor(F.col("ay") / tile)})
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sides.select(*keys, label).schema.fields)
    chains = placed.groupBy(*keys, "sx", "sy").applyInArrow(lambda t: _chains(t, keys, label), f"{types}, {_CHAIN}")
    chains = cut(chains.withColumn("id", F.monotonically_increasing_id()))
    closed = chains.filter("closed").select(*keys, label, "id", "points", "twice", "across", "down")
    open_ = chains.filter("NOT closed")
    if not open_.isEmpty():
        closed = closed.unionByName(_joined(open_, keys, label))
    return closed.withColumn("points", F.concat("points", F.slice("points", 1, 1))).withColumnRenamed("id", "ring")


def _joined(open_: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Rings of the chains that cross tiles."""
    # two chains start in one corner at most
    heads = open_.groupBy(*keys, label, F.col("hx").alias("tx"), F.col("hy").alias("ty")).agg(
        F.collect_list(F.struct("hdx", "hdy", "id")).alias("heads"))
    turned = F.transform("heads", lambda h: F.struct((F.col("tdx") * h["hdy"] - F.col("tdy") * h["hdx"]).alias("turn"), h["id"].alias("id")))
    links = open_.select(*keys, label, "id", "tx", "ty", "tdx", "tdy").join(heads, [*keys, label, "tx", "ty"]).select(
        "id", F.array_max(turned)["id"].alias("nxt"))
    ranked = open_.join(ring_places(links), "id")
    # the least chain comes first, then the one farthest from it
    piece = F.struct((F.col("at") > 0).alias("rest"), (-F.col("at")).alias("order"), "points")
    return ranked.groupBy(*keys, label, F.col("low").alias("id")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["points"])).alias("points"),
        *[F.sum(c).alias(c) for c in ("twice", "across", "down")],
    )


def _owners(found: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``hole, ring``: the outer ring around each hole, for regions of several parts.

    The first side to the left of a hole's leftmost corner belongs to its outer ring or to another hole of
    the same part, whose own answer is then taken over by pointer jumping.
    """
    name = [*keys, label]
    side = F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda i: F.struct(
        F.col("points")[i - 1].alias("a"), F.col("points")[i].alias("b")))
    sides = found.select(*name, "ring", F.explode(side).alias("s")).filter("s.a.x = s.b.x").select(
        *name, F.col("ring").alias("of"), F.col("s.a.x").alias("x"), F.least("s.a.y", "s.b.y").alias("top"), F.greatest("s.a.y", "s.b.y").alias("bottom"))
    banded = sides.withColumn("band", F.explode(F.sequence(
        F.floor(F.col("top") / BAND).cast("bigint"), (F.ceil(F.col("bottom") / BAND) - 1).cast("bigint"))))
    corner = F.array_min(F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    holes = found.filter("twice < 0").select(*name, F.col("ring").alias("hole"), corner.alias("c"))
    holes = holes.withColumn("band", F.floor(F.col("c.y") / BAND).cast("bigint"))
    left = holes.join(banded, [*name, "band"]).filter("x < c.x AND top <= c.y AND c.y < bottom")
    owner = left.groupBy("hole").agg(F.max(F.struct("x", "of")).alias("nearest")).select("hole", F.col("nearest.of").alias("ring"))
    owner = cut(owner)
    while True:
        onward = owner.select(F.col("hole").alias("ring"), F.col("ring").alias("beyond"))
        jumped = owner.join(onward, "ring", "left")
        if jumped.filter("beyond IS NOT NULL").isEmpty():
            return owner
        owner = cut(jumped.select("hole", F.coalesce("beyond", "ring").alias("ring")))


def region_polygons(found: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Rings -> one row per part: ``keys, label, ring, exterior, interiors, cells, across, down``.

    ``cells`` is the area without the holes; lengths count all rings. ``interiors`` come in order of their points.
    """
    name = [*keys, label]
    found = cut(found)
    outer = found.filter("twice > 0")
    several = outer.groupBy(*name).agg(F.count(F.lit(1)).alias("n"), F.min("ring").alias("only"))
    holes = found.filter("twice < 0").select(*name, F.col("ring").alias("hole"), "points", "twice", "across", "down").join(several, name)
    many = found.join(several.filter("n > 1").select(*name), name, "left_semi")
    of = holes.filter("n = 1").select("hole", F.col("only").alias("ring"))
    if not holes.filter("n > 1").isEmpty():
        of = of.unionByName(_owners(many, keys, label))
    inner = holes.join(of, "hole").groupBy("ring").agg(
        F.array_sort(F.collect_list("points")).alias("interiors"), *[F.sum(c).alias(f"_{c}") for c in ("twice", "across", "down")])
    empty = F.slice(F.array("points"), 1, 0)
    joined = outer.join(inner, "ring", "left")

    def total(c: str) -> Column:
        return F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0.0))

    return joined.select(
        *name, "ring", F.col("points").alias("exterior"), F.coalesce("interiors", empty).alias("interiors"),
        (total("twice") / 2).alias("cells"), total("across").alias("across"), total("down").alias("down"),
    )


def outlines_of(boxes: DataFrame, keys: list[str], label: str, tile: float,
                affine: tuple[float, ...] = (1, 0, 0, 0, 1, 0), inside: bool = False) -> DataFrame:
    """Regions -> polygons in map coordinates with ``area`` and ``perimeter``, one row per part."""
    made = region_polygons(outline_rings(boxes, keys, label, tile, inside), keys, label)
    a, b, c, d, e, f = affine
    moved = made.withColumns({
        "exterior": rings.affine_ring(F.col("exterior"), a, b, c, d, e, f),
        "interiors": F.transform("interiors", lambda r: rings.affine_ring(r, a, b, c, d, e, f)),
        "area": F.col("cells") * abs(a * e - b * d),
        "perimeter": F.col("across") * float(np.hypot(a, d)) + F.col("down") * float(np.hypot(b, e)),
    })
    return moved.drop("cells", "across", "down")

