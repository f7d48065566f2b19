"""Box arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import bankers, clamp


def corners(x: Column, y: Column, w: Column, h: Column, width, height, pad) -> list[Column]:
    """Padded corner form ``x1, y1, x2, y2`` (second corner outside the box)."""
    pad = pad if isinstance(pad, Column) else F.lit(pad)
    px, py = bankers(x) - pad, bankers(y) - pad
    pw, ph = bankers(w) + pad * 2, bankers(h) + pad * 2
    x1, y1 = clamp(px, 0, width - 1), clamp(py, 0, height - 1)
    return [x1.alias("x1"), y1.alias("y1"),
            F.greatest(x1 + 1, F.least(px + pw, F.lit(width))).alias("x2"),
            F.greatest(y1 + 1, F.least(py + ph, F.lit(height))).alias("y2")]


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes given as column prefixes."""
    def c(p, n):
        return F.col(p + n)
    iw = F.greatest(F.lit(0), F.least(c(a, "x") + c(a, "w"), c(b, "x") + c(b, "w")) - F.greatest(c(a, "x"), c(b, "x")))
    ih = F.greatest(F.lit(0), F.least(c(a, "y") + c(a, "h"), c(b, "y") + c(b, "h")) - F.greatest(c(a, "y"), c(b, "y")))
    inter = iw * ih
    union = c(a, "w") * c(a, "h") + c(b, "w") * c(b, "h") - inter
    return F.when(inter > 0, inter.cast("double") / union).otherwise(F.lit(0.0))


def with_cells(boxes: DataFrame, cell: int, x="x", y="y", w="w", h="h") -> DataFrame:
    """One row per grid cell a box touches (``cx``, ``cy``)."""
    def span(start, size):
        return F.sequence(F.floor(F.col(start) / cell), F.floor((F.col(start) + F.col(size) - 1) / cell))
    return boxes.withColumn("cx", F.explode(span(x, w))).withColumn("cy", F.explode(span(y, h)))
