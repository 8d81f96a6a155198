"""Merging fields: adjacent fields of a raster, boxes that touch, duplicate detections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators import boundary, labelling, spatial
from furrow.operators.graph import with_components
from furrow.operators.skew import attach_group
from furrow.session import cut


def adjacent_labels(
    runs: DataFrame, stats: DataFrame, keys: list[str], stride: int, ratio: float,
    pixel_w: float = 10.0, pixel_h: float = 10.0,
) -> tuple[DataFrame, DataFrame]:
    """Contacts of kept fields of neighbouring tiles, and the merged label of each field.

    Inside a tile two fields never share a side, so only tile edges are compared.
    """
    contacts = labelling.tile_contacts(
        runs.join(stats.select(*keys, "ty", "tx", "comp"), [*keys, "ty", "tx", "comp"], "left_semi"),
        keys, stride,
    ).withColumn("shared", F.col("sides_v") * F.lit(pixel_h) + F.col("sides_h") * F.lit(pixel_w))
    perims = stats.select(*keys, F.col("comp").alias("c"), "perimeter")
    pairs = (
        contacts.join(perims.withColumnsRenamed({"c": "a", "perimeter": "pa"}), [*keys, "a"])
        .join(perims.withColumnsRenamed({"c": "b", "perimeter": "pb"}), [*keys, "b"])
    )
    accepted = pairs.filter(
        spatial.merges_adjacent(F.lit(0.0), F.col("shared"), F.least("pa", "pb"), ratio)
    )
    return contacts, labelling.merge_labels(stats, accepted, keys)


def merge_adjacent_fields(
    runs: DataFrame, stats: DataFrame, keys: list[str], stride: int, ratio: float,
    pixel_w: float = 10.0, pixel_h: float = 10.0,
) -> DataFrame:
    """Merge fields of neighbouring tiles whose shared boundary is long enough.

    ``stats`` holds the kept fields with ``id, perimeter`` and cell counts; fields dropped before
    do not take part. Gives one row per merged field: ids in order, exact area and perimeter.
    """
    contacts, labels = adjacent_labels(runs, stats, keys, stride, ratio, pixel_w, pixel_h)
    inner = (
        contacts.join(labels.withColumnsRenamed({"comp": "a", "label": "la"}), [*keys, "a"])
        .join(labels.withColumnsRenamed({"comp": "b", "label": "lb"}), [*keys, "b"])
        .filter(F.col("la") == F.col("lb"))
        .groupBy(*keys, F.col("la").alias("label"))
        .agg(F.sum("shared").alias("inner"))
    )
    members = stats.join(labels, [*keys, "comp"]).groupBy(*keys, "label").agg(
        merged_id(F.col("id"), F.col("id")).alias("ids"),
        F.count(F.lit(1)).alias("parts"),
        F.sum("cells").alias("cells"),
        F.sum("area").alias("area"),
        F.sum("perimeter").alias("outline"),
    )
    return (
        members.join(inner, [*keys, "label"], "left")
        .withColumn("perimeter", F.col("outline") - 2 * F.coalesce("inner", F.lit(0.0)))
        .drop("outline", "inner")
    )


def merged_field_polygons(
    runs: DataFrame, stats: DataFrame, keys: list[str], stride: int, ratio: float,
    affine: tuple[float, ...] = (10.0, 0.0, 0.0, 0.0, -10.0, 0.0),
) -> DataFrame:
    """Merged fields as polygons: ``keys, label, ids, fields, exterior, interiors, area, perimeter``.

    The rings are those of the union, so common sides of merged fields are gone from them. Sides are linked in blocks of
    small tiles, so only rings that leave a block are joined piece by piece.
    """
    a, b, _, d, e, _ = affine
    _, labels = adjacent_labels(runs, stats, keys, stride, ratio, math.hypot(a, d), math.hypot(b, e))
    labels = cut(labels)
    shapes = boundary.outlines_of(
        boundary.run_boxes(runs.join(labels, [*keys, "comp"]), keys, "label"), keys, "label", labelling.block_side(stride), affine, inside=True)
    members = stats.join(labels, [*keys, "comp"]).groupBy(*keys, "label").agg(
        merged_id(F.col("id"), F.col("id")).alias("ids"), F.count(F.lit(1)).alias("fields"))
    return shapes.join(members, [*keys, "label"]).drop("ring")


def merged_id(order: Column, ident: Column) -> Column:
    """Aggregate: ids joined by commas in input order, blanks left out."""
    shown = F.when(ident.cast("string") != "", F.struct(order.alias("o"), ident.cast("string").alias("s")))
    return F.concat_ws(",", F.transform(F.array_sort(F.collect_list(shown)), lambda t: t["s"]))


EDGES = ("x0", "y0", "x1", "y1")
BIN_STEPS = 16


def shape_bins(boxes: DataFrame, steps: int = BIN_STEPS) -> DataFrame:
    """Add ``bin``, the smallest id among boxes of nearly the same shape and place.

    All four sides of the boxes of a bin agree to a fraction of their size, so copies and
    near-copies, however many, enter the pair join as one row.
    """
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    grain = F.pow(F.lit(2.0), F.ceil(F.log2(side))) / steps
    keys = [f"_q{c}" for c in EDGES]
    binned = boxes.withColumn("_g", grain)
    binned = binned.withColumns({k: F.floor(F.col(c) / F.col("_g")) for k, c in zip(keys, EDGES)})
    return attach_group(binned, ["_g", *keys], bin=F.min("id")).drop("_g", *keys)


def _bin_extents(boxes: DataFrame) -> DataFrame:
    """Outer extents of each bin as ``x0 .. y1`` and inner ones as ``i_x0 .. i_y1``."""
    return boxes.groupBy(F.col("bin").alias("id")).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.max("x0").alias("i_x0"), F.max("y0").alias("i_y0"), F.min("x1").alias("i_x1"), F.min("y1").alias("i_y1"),
        F.count(F.lit(1)).alias("n"),
    )


def _bounded_pairs(bins: DataFrame, base: float, accept: Column) -> DataFrame:
    """Bin pairs that meet with ``sure`` (every pair of members merges) and ``maybe`` (some could).

    Overlap is smallest between the inner extents and largest between the outer ones; areas the
    other way round. ``accept`` must only grow with overlap, IoU, containment and shared length.
    For bins of one box both bounds are the exact measures.
    """
    inner = bins.select("id", *[f"i_{c}" for c in EDGES], "n")
    met = spatial.box_pair_measures(spatial.intersecting_pairs(bins, base))
    for side in ("a", "b"):
        met = met.join(inner.select(F.col("id").alias(f"{side}_id"), *[
            F.col(f"i_{c}").alias(f"{side}_i_{c}") for c in EDGES], F.col("n").alias(f"{side}_n")), f"{side}_id")
    own = inner.filter(F.col("n") > 1).join(bins.select("id", *EDGES), "id")
    itself = own.select(*[F.col("id").alias(f"{s}_id") for s in "ab"], *[
        F.col(f"{p}{c}").alias(f"{s}_{p}{c}") for s in "ab" for p in ("", "i_") for c in EDGES
    ], *[F.col("n").alias(f"{s}_n") for s in "ab"])
    every = met.unionByName(spatial.box_pair_measures(itself))
    single = (F.col("a_n") == 1) & (F.col("b_n") == 1)

    def overlap(prefix: str) -> Column:
        def axis(v: str) -> Column:
            low = F.greatest(f"a_{prefix}{v}0", f"b_{prefix}{v}0")
            return F.greatest(F.least(f"a_{prefix}{v}1", f"b_{prefix}{v}1") - low, F.lit(0.0))

        return axis("x") * axis("y")

    def area(side: str, prefix: str) -> Column:
        def axis(v: str) -> Column:
            return F.greatest(F.col(f"{side}_{prefix}{v}1") - F.col(f"{side}_{prefix}{v}0"), F.lit(0.0))

        return axis("x") * axis("y")

    def bounds(inter: Column, areas: str, touch: float) -> dict[str, Column]:
        a, b, floor = area("a", areas), area("b", areas), F.lit(1e-12)
        made = {
            "inter": inter, "iou": inter / F.greatest(a + b - inter, floor),
            "containment": inter / F.greatest(F.least(a, b), floor),
            "shared": F.lit(touch), "min_perimeter": F.lit(1.0),
        }
        return {k: F.when(single, F.col(k)).otherwise(v) for k, v in made.items()}

    exact = ["inter", "iou", "containment", "shared", "min_perimeter"]
    kept = every.withColumns({f"_{k}": F.col(k) for k in exact})
    low = kept.withColumns(bounds(overlap("i_"), "", 0.0)).withColumn("sure", accept)
    high = low.withColumns({k: F.col(f"_{k}") for k in exact}).withColumns(bounds(overlap(""), "i_", 1.0)).withColumn("maybe", accept)
    return high.select("a_id", "b_id", "sure", "maybe")


def box_components(boxes: DataFrame, accept: Column, base: float = 16.0) -> DataFrame:
    """Add ``comp`` to boxes by an accepted-pair rule over the pair measures.

    Pairs are decided bin by bin where bounds allow. Members are only compared for undecided bin
    pairs that sure pairs have not already put in one component, so piles of near-copies cost
    their number of bins, not their number of pairs. The result is that of testing every pair.
    """
    solid = boxes.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    binned = cut(shape_bins(solid))
    pairs = cut(_bounded_pairs(_bin_extents(binned), base, accept))
    sure = pairs.filter(F.col("sure") & (F.col("a_id") != F.col("b_id")))
    open_self = pairs.filter((F.col("a_id") == F.col("b_id")) & ~F.col("sure"))
    edges = sure.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))
    grouped = with_components(binned.select("bin").distinct(), edges, "bin")
    label = cut(grouped)
    unsure = (
        pairs.filter(F.col("maybe") & ~F.col("sure") & (F.col("a_id") != F.col("b_id"))).select("a_id", "b_id")
        .join(label.select(F.col("bin").alias("a_id"), F.col("comp").alias("ca")), "a_id")
        .join(label.select(F.col("bin").alias("b_id"), F.col("comp").alias("cb")), "b_id")
        .filter(F.col("ca") != F.col("cb")).select("a_id", "b_id")
        .unionByName(open_self.select("a_id", "b_id"))
    )
    if unsure.isEmpty():
        return binned.join(label, "bin").drop("bin")
    return _refine(binned, label, unsure, open_self, edges, accept)


def _refine(binned: DataFrame, label: DataFrame, unsure: DataFrame, open_self: DataFrame, edges: DataFrame,
            accept: Column) -> DataFrame:
    """Settle undecided bin pairs by their members.

    Graph nodes are boxes; a bin whose members all merge stands for them by its smallest id.
    """
    loose = open_self.select(F.col("a_id").alias("bin")).withColumn("_loose", F.lit(True))
    node = F.when(F.col("_loose"), F.col("id")).otherwise(F.col("bin"))
    members = cut(binned.join(loose, "bin", "left").withColumn("node", node).drop("_loose"))

    def side(s: str) -> DataFrame:
        return members.select(F.col("bin").alias(f"{s}_id"), F.col("id").alias(f"{s}_box"), F.col("node").alias(f"{s}_node"), *[
            F.col(c).alias(f"{s}_{c}") for c in EDGES])

    tested = spatial.box_pair_measures(
        unsure.join(side("a"), "a_id").join(side("b"), "b_id")
        .filter((F.col("a_id") != F.col("b_id")) | (F.col("a_box") < F.col("b_box")))
    ).filter(accept)
    found = tested.select(F.col("a_node").alias("src"), F.col("b_node").alias("dst"))
    # a sure bin pair holds for every member, so a loose bin is tied to the other bin as a whole
    nodes = members.select("bin", "node").distinct()
    tied = (
        edges.join(nodes.withColumnsRenamed({"bin": "src", "node": "s"}), "src")
        .join(members.groupBy(F.col("bin").alias("dst")).agg(F.min("node").alias("d")), "dst").select("s", "d")
        .unionByName(
            edges.join(members.groupBy(F.col("bin").alias("src")).agg(F.min("node").alias("s")), "src")
            .join(nodes.withColumnsRenamed({"bin": "dst", "node": "d"}), "dst").select("s", "d"))
    )
    both = found.unionByName(tied.select(F.col("s").alias("src"), F.col("d").alias("dst"))).filter(F.col("src") != F.col("dst"))
    return with_components(members, both, "node").drop("bin", "node")


def merge_adjacent_boxes(boxes: DataFrame, ratio: float, base: float = 16.0) -> DataFrame:
    """Merge boxes that overlap or share enough boundary: one row per component."""
    accept = spatial.merges_adjacent(F.col("inter"), F.col("shared"), F.col("min_perimeter"), ratio)
    return dissolve_boxes(box_components(boxes, accept, base), snap=None)


def merge_duplicate_boxes(
    boxes: DataFrame, iou_min: float = 0.2, contain_min: float = 0.8, grid: float = 10.0,
    base: float = 16.0,
) -> DataFrame:
    """Merge detections by IoU or containment and dissolve them on the snap grid."""
    accept = spatial.merges_duplicates(F.col("iou"), F.col("containment"), iou_min, contain_min)
    return dissolve_boxes(box_components(boxes, accept, base), snap=grid)


def _solid(boxes: DataFrame, snap: float | None) -> tuple[DataFrame, DataFrame]:
    """Ids and number of the boxes of each ``comp``, and its distinct boxes with area on the snap grid."""
    if snap is not None:
        for c in ("x0", "y0", "x1", "y1"):
            boxes = boxes.withColumn(c, F.floor(F.col(c) / snap + 0.5) * snap)
    ids = boxes.groupBy("comp").agg(
        merged_id(F.col("id"), F.col("id")).alias("ids"), F.count(F.lit(1)).alias("parts")
    )
    return ids, (
        boxes.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
        .select("comp", "x0", "y0", "x1", "y1").distinct()
    )


def dissolve_boxes(boxes: DataFrame, snap: float | None) -> DataFrame:
    """Union of the boxes of each ``comp``: exact area and perimeter.

    Components without area, also those that the grid takes it from, fall away. Without a snap grid the plane is cut at the distinct edges of the component itself, so the
    measure is exact for any coordinates. Horizontal strips keep the work near the number of
    edges rather than the area.
    """
    ids, solid = _solid(boxes, snap)
    return ids.join(_strip_measures(_strip_intervals(solid)), "comp")


def dissolved_polygons(boxes: DataFrame, snap: float | None, tile: float = 4096.0) -> DataFrame:
    """Union of the boxes of each ``comp`` as polygons, one row per part.

    ``comp, ids, boxes, exterior, interiors, area, perimeter``; rings run in the plane of the boxes and
    ``tile`` is the side of the squares whose sides are linked in one task.
    """
    ids, solid = _solid(boxes, snap)
    strips = _strip_intervals(solid).select("comp", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    shapes = boundary.outlines_of(strips, [], "comp", tile)
    return shapes.join(ids.withColumnRenamed("parts", "boxes"), "comp").drop("ring")


def _strip_intervals(solid: DataFrame, band_height: float = 1024.0) -> DataFrame:
    """Disjoint x intervals of each union per horizontal strip: ``comp, y0, y1, x0, x1``.

    Boxes are first cut at fixed bands, so no window ever spans a whole component.
    """
    low, high = F.floor(F.col("y0") / band_height), F.ceil(F.col("y1") / band_height) - 1
    cutup = solid.withColumn("band", F.explode(F.sequence(low, high))).withColumns({
        "y0": F.greatest("y0", F.col("band") * F.lit(band_height)),
        "y1": F.least("y1", (F.col("band") + 1) * F.lit(band_height)),
    })
    by_y = Window.partitionBy("comp", "band").orderBy("y")
    levels = (
        cutup.select("comp", "band", F.explode(F.array("y0", "y1")).alias("y")).distinct()
        .withColumn("top", F.lead("y").over(by_y))
        .filter(F.col("top").isNotNull())
    )
    strips = cutup.alias("b").join(levels.alias("l"), ["comp", "band"]).filter(
        (F.col("b.y0") <= F.col("l.y")) & (F.col("l.top") <= F.col("b.y1"))
    ).select("comp", "band", F.col("l.y").alias("y0"), F.col("l.top").alias("y1"), "x0", "x1")
    strip = Window.partitionBy("comp", "band", "y0").orderBy("x0", "x1")
    seen = F.max("x1").over(strip.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(seen.isNull() | (F.col("x0") > seen), 1).otherwise(0)
    return (
        strips.withColumn("opens", opens)
        .withColumn("part", F.sum("opens").over(strip.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("comp", "band", "y0", "part")
        .agg(F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
        .drop("part", "band")
    )


def _strip_measures(merged: DataFrame) -> DataFrame:
    length = F.col("x1") - F.col("x0")
    own = merged.groupBy("comp").agg(
        F.sum(length * (F.col("y1") - F.col("y0"))).alias("area"),
        F.sum(2 * length + 2 * (F.col("y1") - F.col("y0"))).alias("outline"),
    )
    above = merged.select("comp", F.col("y0").alias("y1"), F.col("x0").alias("u0"), F.col("x1").alias("u1"))
    shared = (
        merged.join(above, ["comp", "y1"])
        .withColumn("o", F.least("x1", "u1") - F.greatest("x0", "u0"))
        .filter(F.col("o") > 0)
        .groupBy("comp").agg(F.sum("o").alias("shared"))
    )
    return own.join(shared, "comp", "left").select(
        "comp", "area",
        (F.col("outline") - 2 * F.coalesce("shared", F.lit(0.0))).alias("perimeter"),
    )
