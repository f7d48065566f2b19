"""Polygon masks: an edge table and scan lines instead of a test of every pixel.

A region may carry ``polygon``, an array of points ``x, y``. Points are rounded (half
to even) and moved into the canvas. A pixel is covered if its scan line passes through the closed
even-odd fill less than half a pixel from its centre, so edges and single lines leave no hole.
A polygon counts where at least three of its points are usable and the region has no
padding; every other region is its box, ends included. Missing points are skipped, a missing
coordinate is 0. Work grows with the height of the edges, not with the area.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import bankers, clamp
from ..functions.geometry import corners
from ..functions.ranking import crowding
from .pixels import merge_spans

c = F.col
#: Scan lines of region edges that one task holds.
TASK_LINES = 250_000


def _points(width: int, height: int) -> Column:
    def inside(value: Column, size: int) -> Column:
        return clamp(F.coalesce(bankers(value), F.lit(0)), 0, size - 1)
    usable = F.filter(c("polygon"), lambda p: p.isNotNull())
    return F.transform(usable, lambda p: F.struct(inside(p["x"], width).alias("x"), inside(p["y"], height).alias("y")))


def edge_table(regions: DataFrame, width: int, height: int, keys=("slide", "id")) -> DataFrame:
    """Edges ``x0, y0, x1, y1`` of all closed polygons, upper end first."""
    points = regions.select(*keys, _points(width, height).alias("p")).where(F.size("p") >= 3)
    following = F.concat(F.slice("p", 2, F.size("p") - 1), F.slice("p", 1, 1))
    edges = points.select(*keys, F.explode(F.arrays_zip(c("p").alias("a"), following.alias("b"))).alias("e"))
    down = (c("e.a.y") < c("e.b.y")) | ((c("e.a.y") == c("e.b.y")) & (c("e.a.x") <= c("e.b.x")))
    ends = F.when(down, F.struct(c("e.a").alias("s"), c("e.b").alias("t"))).otherwise(F.struct(c("e.b").alias("s"), c("e.a").alias("t")))
    return edges.select(*keys, ends.alias("e")).select(*keys, c("e.s.x").alias("x0"), c("e.s.y").alias("y0"), c("e.t.x").alias("x1"), c("e.t.y").alias("y1"))


def _floor_div(a: str, b: str) -> str:
    return f"((({a}) - pmod({a}, {b})) div ({b}))"


def polygon_spans(regions: DataFrame, width: int, height: int, keys=("slide", "id")) -> DataFrame:
    """``keys, y, x0, x1``: the covered pixels of each polygon as disjoint spans per scan line."""
    return merge_spans(_loose_spans(regions, width, height, keys), keys)


def _loose_spans(regions: DataFrame, width: int, height: int, keys) -> DataFrame:
    """The same pixels as spans that may overlap."""
    edges = edge_table(regions, width, height, keys)
    flat = edges.where("y0 = y1").select(*keys, c("y0").alias("y"), "x0", "x1")
    lines = edges.where("y0 < y1").select(*keys, "x0", "y0", "x1", "y1", F.explode(F.sequence("y0", "y1")).alias("y"))
    # where the edge crosses the line, as a fraction n / d in whole numbers
    at = lines.select(*keys, "y", (c("y") < c("y1")).alias("crosses"), F.expr("x0 * (y1 - y0) + (y - y0) * (x1 - x0)").alias("n"), (c("y1") - c("y0")).alias("d"))
    at = at.select(*keys, "y", "crosses", (c("n") / c("d")).alias("place"), F.expr(_floor_div("2 * n + d", "2 * d")).alias("x0"), (-F.expr(_floor_div("d - 2 * n", "2 * d"))).alias("x1"))
    # an edge holds the line of its upper end only, so the crossings of a line come in pairs
    w = W.partitionBy(*keys, "y").orderBy("place", "x0")
    pairs = at.where("crosses").select(*keys, "y", "x0", F.lead("x1").over(w).alias("x1"), (F.row_number().over(w) % 2 == 1).alias("opens")).where("opens").drop("opens")
    return pairs.unionByName(at.select(*keys, "y", "x0", "x1")).where("x0 <= x1").unionByName(flat)


def region_spans(regions: DataFrame, width: int, height: int, pad=0, keys=("slide", "id")) -> DataFrame:
    """``keys, y, x0, x1`` of each region: its polygon where it has a usable one and ``pad`` is 0, else its padded box."""
    drawn, rows = _shapes(regions, width, height, pad, keys)
    return polygon_spans(drawn, width, height, keys).unionByName(rows)


def _shapes(regions: DataFrame, width: int, height: int, pad, keys) -> tuple[DataFrame, DataFrame]:
    """The regions that are polygons, and ``keys, y, x0, x1`` of the others."""
    pad = pad if isinstance(pad, Column) else F.lit(pad)
    drawn = (pad == 0) & (F.coalesce(F.size(_points(width, height)), F.lit(0)) >= 3)
    marked = regions.withColumn("_drawn", F.coalesce(drawn, F.lit(False)))
    box = marked.where("not _drawn").select(*keys, *corners(*[c(n) for n in "xywh"], width, height, pad))
    rows = box.select(*keys, F.explode(F.sequence("y1", F.least(c("y2"), F.lit(height - 1)))).alias("y"), c("x1").alias("x0"), F.least(c("x2"), F.lit(width - 1)).alias("x1"))
    return marked.where("_drawn"), rows


def _lines(width: int, height: int) -> Column:
    """Scan lines of a region's edges: those of its polygon or of its box, whichever are more."""
    p = _points(width, height)
    along = F.zip_with(p, F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1)), lambda a, b: F.abs(a["y"] - b["y"]) + 1)
    drawn = F.aggregate(along, F.lit(0).cast("bigint"), lambda n, more: n + F.coalesce(more, F.lit(0)))
    return F.greatest(F.coalesce(drawn, F.lit(0)), clamp(F.coalesce(bankers(c("h")), F.lit(0)), 0, height) + 1)


def union_spans(regions: DataFrame, width: int, height: int, pad=0) -> DataFrame:
    """Disjoint spans of the union mask of all regions of a slide; copies of one region cost one row.

    Slides move once, into tasks of about ``TASK_LINES`` scan lines; the lines of a slide that holds very many are spread.
    """
    shape = ["slide", "x", "y", "w", "h", "polygon"]
    if isinstance(pad, Column):
        regions, pad = regions.withColumn("_pad", pad), F.col("_pad")
        shape.append("_pad")
    rows = regions.select(*shape)
    hot, lines = crowding(rows, ["slide"], TASK_LINES, _lines(width, height))

    def union(rows: DataFrame) -> DataFrame:
        # equal regions are one; the shape itself is the key
        distinct = rows.distinct().withColumn("_shape", F.unhex(F.sha2(F.to_json(F.struct(*shape)), 256)))
        drawn, boxes = _shapes(distinct, width, height, pad, ("slide", "_shape"))
        return merge_spans(_loose_spans(drawn, width, height, ("slide", "_shape")).unionByName(boxes), ("slide",))

    few = union((rows if hot is None else rows.where(~hot)).repartition(1 + lines // TASK_LINES, "slide"))
    return few if hot is None else few.unionByName(union(rows.where(hot)))
