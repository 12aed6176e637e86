"""Points near other points: a dual-tree join.

Points fall into cubic cells of a tree with 8 children per axis; a node keeps the exact bounding box and
number of its points.  From the lowest level with at most ``TOP`` nodes down, pairs of nodes are compared by their boxes:
pairs further apart than the radius are discarded, pairs whose boxes lie wholly within it are accepted (and are not
tested again), the others are refined into pairs of children.  Leaves are cells about as wide as the radius; uncertain
pairs of leaves with more than ``CROWDED`` ** 2 pairs of points are refined further, by cells an eighth as wide each
time, so a crowded place becomes many keys.  What is still uncertain ends in exact distances between points.
Every step is an equi-join on cells, so it is spread over tasks by place, and AQE's skew join splits what is left of
hot keys; no cell's points are gathered, and nothing but the top nodes comes to the driver, where they are compared.
Places on the globe are taken to points in space first, so poles and the date line are nothing special.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.scratch import Scratch

EARTH_RADIUS = 6_371_000.0
FAR = float(1 << 50)  # metres; coordinates beyond it are not places
TOP = 2048  # nodes to begin with, at most, where a level has so few (the highest has 8)
CROWDED = 512  # a pair of leaves with more pairs of points than this squared is refined further
_BITS = 3  # children per axis: 2 ** _BITS
_AXES = ("x", "y", "z")


def on_globe(lat: Column, lng: Column, radius: float = EARTH_RADIUS) -> list[Column]:
    """Degrees to points in space, in metres."""
    a, b = F.radians(lat), F.radians(lng)
    return [F.cos(a) * F.cos(b) * radius, F.cos(a) * F.sin(b) * radius, F.sin(a) * radius]


def chord(arc: float, radius: float = EARTH_RADIUS) -> float:
    """The straight distance of two points of a sphere that are ``arc`` apart along it."""
    return 2 * radius * math.sin(arc / (2 * radius))


def _box_gap2(a: str, b: str) -> Column:
    """Square of the least distance between two boxes."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"{a}_lo_{k}") - F.col(f"{b}_hi_{k}"), F.col(f"{b}_lo_{k}") - F.col(f"{a}_hi_{k}")) for k in _AXES]
    return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]


def _box_span2(a: str, b: str) -> Column:
    """Square of the greatest distance between points of two boxes."""
    spans = [F.greatest(F.col(f"{a}_hi_{k}") - F.col(f"{b}_lo_{k}"), F.col(f"{b}_hi_{k}") - F.col(f"{a}_lo_{k}")) for k in _AXES]
    return spans[0] * spans[0] + spans[1] * spans[1] + spans[2] * spans[2]


def _side(nodes: DataFrame, side: str) -> DataFrame:
    """A level's nodes under names of one side, with the cell of their parent."""
    cells = [F.col(f"c{k}").alias(f"{side}_c{k}") for k in _AXES] + [F.shiftright(f"c{k}", _BITS).alias(f"{side}_p{k}") for k in _AXES]
    boxes = [F.col(f"{e}_{k}").alias(f"{side}_{e}_{k}") for e in ("lo", "hi") for k in _AXES]
    return nodes.select(*cells, *boxes, F.col("n").alias(f"{side}_n"))


def _cell_columns(width: Column | float) -> list[Column]:
    return [F.floor(F.col(k) / width).alias(f"c{k}") for k in _AXES]


def _nodes(cells: DataFrame, *keys: str) -> DataFrame:
    """Number and bounding box of the points or nodes of each cell."""
    own = "n" in cells.columns
    low, high = (("lo_", "hi_") if own else ("", ""))
    return cells.groupBy(*keys, *(f"c{k}" for k in _AXES)).agg(F.sum("n" if own else F.lit(1)).alias("n"), *(F.min(low + k).alias(f"lo_{k}") for k in _AXES), *(F.max(high + k).alias(f"hi_{k}") for k in _AXES))


def _top_pairs(rows: list, radius: float) -> list[tuple]:
    """Cells of the pairs of a few nodes that may be near, each pair once; compared by their boxes in blocks."""
    cells = [tuple(int(r[f"c{k}"]) for k in _AXES) for r in rows]
    low, high = (np.array([[r[f"{e}_{k}"] for k in _AXES] for r in rows], float) for e in ("lo", "hi"))
    order = sorted(range(len(rows)), key=lambda i: cells[i])
    out = []
    for at, i in enumerate(order):
        rest = np.array(order[at:])
        gap = np.maximum(np.maximum(low[i] - high[rest], low[rest] - high[i]), 0.0)
        out += [(*cells[i], *cells[j]) for j in rest[(gap * gap).sum(axis=1) <= radius * radius]]
    return out


def near_pairs(points: DataFrame, id: str, at: Sequence[Column], radius: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b, for all pairs of points at most ``radius`` apart.

    ``at``: two or three coordinates in metres.  A point with a null id, or a coordinate that is null, NaN,
    infinite or beyond ``FAR``, takes no part.  Rows alike count once; an id with several positions stands at all of
    them, and a pair comes up once however many of them are near.  No points, no rows.
    """
    if not radius > 0:
        raise ValueError("radius must be positive")
    spark = points.sparkSession
    scratch = Scratch(spark, "near")
    r2 = F.lit(float(radius) ** 2)
    leaf = 2.0 ** math.ceil(math.log2(radius))
    coords = [*at, *([F.lit(0.0)] * (3 - len(at)))]
    placed = points.select(F.col(id).alias("id"), *((c.cast("double") + 0.0).alias(k) for k, c in zip(_AXES, coords))).dropna()
    for k in _AXES:
        placed = placed.where(~F.isnan(k) & (F.abs(k) < FAR))
    placed = placed.distinct().select("id", *_AXES, *_cell_columns(leaf))
    placed = scratch.table(placed, extent=F.max(F.greatest(*(F.abs(k) for k in _AXES))))
    extent = placed.measured["extent"]
    if extent is None:
        return placed.select(F.col("id").alias("id_a"), F.col("id").alias("id_b"))
    several = placed.groupBy("id").count().where("count > 1").limit(1).count() > 0
    depth = 0
    while leaf * (1 << _BITS) ** depth <= extent:
        depth += 1

    levels = F.explode(F.array(*(F.struct(F.lit(d).alias("level"), *(F.shiftright(f"c{k}", _BITS * d).alias(f"c{k}") for k in _AXES)) for d in range(depth + 1))))
    leaves = _nodes(placed)
    boxes = [f"{e}_{k}" for e in ("lo", "hi") for k in _AXES]
    nodes = _nodes(leaves.select(levels.alias("node"), "n", *boxes).select("node.*", "n", *boxes), "level")
    nodes = scratch.table(nodes.sort("level"))  # sorted, so that a level is read by row-group statistics
    sizes = {r["level"]: r["count"] for r in nodes.groupBy("level").count().collect()}
    top = min((d for d in sizes if sizes[d] <= TOP), default=depth)

    kept_b = [f"b_{e}_{k}" for e in ("lo", "hi") for k in _AXES]
    cells = [f"{s}_c{k}" for s in "ab" for k in _AXES]
    same = F.lit(True)
    for k in _AXES:
        same = same & (F.col(f"a_c{k}") == F.col(f"b_c{k}"))
    ordered = F.struct(*(f"a_c{k}" for k in _AXES)) <= F.struct(*(f"b_c{k}" for k in _AXES))

    def judged(pairs: DataFrame) -> DataFrame:
        """Discard impossible pairs, and single points with themselves; mark pairs that are certainly near."""
        possible = (F.col("sure") | (_box_gap2("a", "b") <= r2)) & ~(same & (F.col("a_n") == 1))
        return pairs.where(possible).withColumn("sure", F.col("sure") | (_box_span2("a", "b") <= r2)).select(*cells, *kept_b, "sure", "a_n", "b_n")

    def refined(pairs: DataFrame, children: DataFrame) -> DataFrame:
        up = pairs.select(*(F.col(c).alias(f"up_{c}") for c in cells), *kept_b, "sure", same.alias("within"))
        half = up.join(_side(children, "a"), [F.col(f"up_a_c{k}") == F.col(f"a_p{k}") for k in _AXES]).where(F.col("sure") | (_box_gap2("a", "b") <= r2)).drop(*kept_b)
        return judged(half.join(_side(children, "b"), [F.col(f"up_b_c{k}") == F.col(f"b_p{k}") for k in _AXES]).where(~F.col("within") | ordered))

    level_top = nodes.where(F.col("level") == top)
    pairs = spark.createDataFrame(_top_pairs(level_top.collect(), radius), ", ".join(f"{c} long" for c in cells))
    for side in "ab":
        pairs = pairs.join(_side(level_top, side), [f"{side}_c{k}" for k in _AXES])
    pairs = judged(pairs.withColumn("sure", F.lit(False)))
    for d in range(top - 1, -1, -1):
        pairs = refined(pairs, nodes.where(F.col("level") == d))
        if (top - d) % 2 == 0 and d > 0:  # keeps the plan, which the driver plans anew after every stage, to a few joins
            pairs = scratch.table(pairs)

    def found(leaf_pairs: DataFrame, members: DataFrame) -> DataFrame:
        def member(side: str) -> DataFrame:
            return members.select(F.col("id").alias(f"{side}_id"), *(F.col(k).alias(f"{side}_{k}") for k in _AXES), *(F.col(f"c{k}").alias(f"{side}_c{k}") for k in _AXES))

        both = leaf_pairs.select(*cells, "sure", same.alias("within")).join(member("a"), [f"a_c{k}" for k in _AXES]).drop(*(f"a_c{k}" for k in _AXES)).join(member("b"), [f"b_c{k}" for k in _AXES])
        gap2 = sum(((F.col(f"a_{k}") - F.col(f"b_{k}")) * (F.col(f"a_{k}") - F.col(f"b_{k}")) for k in _AXES), F.lit(0.0))
        close = both.where((F.col("a_id") != F.col("b_id")) & (~F.col("within") | (F.col("a_id") < F.col("b_id"))) & (F.col("sure") | (gap2 <= r2)))
        return close.select(F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b"))

    crowded = ~F.col("sure") & (F.col("a_n") * F.col("b_n") > CROWDED * CROWDED)
    pairs = scratch.table(pairs, crowded=F.count_if(crowded))
    out = found(pairs.where(~crowded) if pairs.measured["crowded"] else pairs, placed)
    width = leaf
    while pairs.measured["crowded"]:  # ends: a box that shrinks to its points is near for certain or not at all
        open_pairs = pairs.where(crowded)
        width /= 1 << _BITS
        dense = open_pairs.select(*(F.col(f"a_c{k}").alias(f"c{k}") for k in _AXES)).unionAll(open_pairs.select(*(F.col(f"b_c{k}").alias(f"c{k}") for k in _AXES))).distinct()
        placed = placed.join(dense, [f"c{k}" for k in _AXES], "left_semi")
        placed = scratch.table(placed.select("id", *_AXES, *_cell_columns(width)))
        pairs = refined(open_pairs, _nodes(placed))
        pairs = scratch.table(pairs, crowded=F.count_if(crowded))
        out = out.unionAll(found(pairs.where(~crowded) if pairs.measured["crowded"] else pairs, placed))
    return out.distinct() if several else out
