"""Text regions: clamping, overlaps, merging, padding, ring statistics, risk."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions.columns import bankers, blank, clamp, contains_any, lookup, name_of, rank_of, round_even
from ..functions.geometry import corners, iou
from ..functions.quadtree import CELL, CROWD, LEAF, by_slide, leaves, meeting
from ..functions.quantiles import exact_quantile
from ..functions.ranking import crowded, crowding, running_number
from .pixels import mask_spans, with_bands
from .polygons import union_spans

X_CELL = 64
#: Boxes that one task orders.
TASK_ROWS = 200_000


def clamp_boxes(boxes: DataFrame, width: int = vocab.CANVAS_W, height: int = vocab.CANVAS_H, pad: int | None = None) -> DataFrame:
    """Whole-number boxes inside the canvas; with ``pad`` also the corner form."""
    c = F.col
    x = clamp(bankers(c("x")), 0, width - 1)
    y = clamp(bankers(c("y")), 0, height - 1)
    w = F.greatest(F.lit(1), F.least(bankers(c("w")), F.lit(width) - x))
    h = F.greatest(F.lit(1), F.least(bankers(c("h")), F.lit(height) - y))
    extra = [] if pad is None else corners(c("x"), c("y"), c("w"), c("h"), width, height, pad)
    others = [n for n in boxes.columns if n not in ("x", "y", "w", "h")]
    usable = c("x").isNotNull() & c("y").isNotNull() & c("w").isNotNull() & c("h").isNotNull()
    return boxes.where(usable).select(*others, x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), *extra)


def score_candidates(boxes: DataFrame, width: int = vocab.CANVAS_W, height: int = vocab.CANVAS_H,
                     min_area: int = 24, min_width: int = 4, min_height: int = 4) -> DataFrame:
    """Drop implausible components and score the rest; OCR scores are percentages."""
    c = F.col
    area = c("area") if "area" in boxes.columns else c("w") * c("h")
    small = (area < min_area) | (c("w") < min_width) | (c("h") < min_height)
    band = (c("w") > width * 0.98) & (c("h") > height * 0.20)
    aspect = c("w").cast("double") / F.greatest(c("h"), F.lit(1))
    shape = clamp(F.lit(0.20) + F.least(aspect, F.lit(12.0)) / 20 + F.least(area, F.lit(5000)) / 20000, 0.18, 0.72)
    ocr = clamp(c("confidence") * 100 / 100.0, 0.0, 1.0)
    return (boxes.where((c("detector") == "ocr") | ~(small | band))
            .withColumn("confidence", round_even(F.when(c("detector") == "ocr", ocr).otherwise(shape), 3)))


def iou_pairs(boxes: DataFrame, threshold: float, cell: int = CELL, crowd: int = CROWD) -> DataFrame:
    """Overlapping box pairs per slide with IoU >= ``threshold``.

    Copies of one box are folded first: a pair of distinct boxes is reported once
    with the number of row pairs it stands for, and a box with copies is paired
    with itself. A slide with at most ``crowd`` boxes is matched whole; distinct boxes of the others meet
    through grid cells, cut in four where they crowd; the
    cell that holds the corner of the intersection owns the pair, so it is found once.
    """
    box = ["x", "y", "w", "h"]

    def folded(rows):
        return rows.groupBy("slide", *box).agg(F.count(F.lit(1)).alias("n"))

    def side(rows, at, p):
        return rows.select(*at, *[F.col(c).alias(p + c) for c in [*box, "n"]])

    few, many = by_slide(boxes.select("slide", *box), crowd)
    distinct = folded(few)
    met = side(distinct, ["slide"], "a").join(side(distinct, ["slide"], "b"), "slide")
    if many is not None:
        more = folded(many)
        distinct = distinct.unionByName(more)
        spread, full = leaves(more, cell, crowd=crowd)
        a, b, on = meeting(side(spread, LEAF, "a"), side(spread, LEAF, "b"), full, crowd)
        owner = ((F.floor(F.greatest("ax", "bx") / F.col("size")) == F.col("cx")) & (F.floor(F.greatest("ay", "by") / F.col("size")) == F.col("cy")))
        met = met.unionByName(a.join(b, on).where(owner).select(*met.columns))
    ordered = F.struct("ay", "ax", "ah", "aw") < F.struct("by", "bx", "bh", "bw")
    pairs = (met.where(ordered).withColumn("iou", iou("a", "b"))
             .where(F.col("iou") >= threshold)
             .select("slide", *["a" + c for c in box], *["b" + c for c in box], (F.col("an") * F.col("bn")).alias("row_pairs"), "iou"))
    own = distinct.where("n > 1").select("slide", *[F.col(c).alias("a" + c) for c in box], *[F.col(c).alias("b" + c) for c in box],
                                         F.expr("n * (n - 1) div 2").alias("row_pairs"), F.lit(1.0).alias("iou"))
    return pairs.unionByName(own)


def islands(boxes: DataFrame) -> DataFrame:
    """Adds ``iy, ix``: boxes of different islands can never touch, even once merged.

    A slide is cut where no box crosses a horizontal line, then each strip where no
    box crosses a vertical line. On crowded slides only one row per distinct edge position is
    ordered, which the canvas bounds, so a slide with very many boxes is no hot task.
    """
    hot = crowded(boxes, ["slide"])
    few = _own_islands(boxes if hot is None else boxes.where(~hot))
    return few if hot is None else few.unionByName(_edge_islands(boxes.where(hot)))


def _own_islands(boxes: DataFrame) -> DataFrame:
    """Islands from the boxes themselves; a slide moves once."""
    def cut(df, keys, pos, size, out):
        w = W.partitionBy(*keys).orderBy(pos)
        reach = F.max(F.col(pos) + F.col(size)).over(w.rangeBetween(W.unboundedPreceding, -1))
        opened = df.withColumn("new", F.coalesce(F.col(pos) >= reach, F.lit(True)).cast("int"))
        # boxes of one place open an island together, so they see the same sum
        return opened.withColumn(out, F.sum("new").over(w.rangeBetween(W.unboundedPreceding, W.currentRow))).drop("new")

    placed = boxes.where(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumns({n: F.col(n).cast("bigint") for n in ("x", "y")})
    return cut(cut(placed, ["slide"], "y", "h", "iy"), ["slide", "iy"], "x", "w", "ix")


def _edge_islands(boxes: DataFrame) -> DataFrame:
    def cut(df, keys, pos, size, out):
        edges = df.groupBy(*keys, pos).agg(F.max(F.col(pos) + F.col(size)).alias("end"))
        w = W.partitionBy(*keys).orderBy(pos)
        reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
        opened = edges.withColumn("new", F.coalesce(F.col(pos) >= reach, F.lit(True)).cast("int"))
        named = opened.select(*keys, pos, F.sum("new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).alias(out))
        return df.join(named, [*keys, pos])

    rows = cut(boxes, ["slide"], "y", "h", "iy")
    return cut(rows, ["slide", "iy"], "x", "w", "ix")


#: Kept boxes of an island that are looked through without a grid.
FEW_KEPT = 16


class Kept:
    """Boxes kept so far in one island; where they are many a box meets only those of its grid cells, the first kept one first."""

    def __init__(self) -> None:
        self.boxes: list[tuple] = []
        self.cells: dict[tuple, list[int]] = {}

    @staticmethod
    def _cells(box: tuple) -> Iterator[tuple]:
        x, y, w, h = box
        for cx in range(x // CELL, (x + w) // CELL + 1):
            for cy in range(y // CELL, (y + h) // CELL + 1):
                yield cx, cy

    def _enter(self, at: int) -> None:
        for cell in self._cells(self.boxes[at]):
            held = self.cells.setdefault(cell, [])
            if at not in held[-1:]:
                held.append(at)

    def add(self, box: tuple) -> None:
        self.boxes.append(box)
        if len(self.boxes) == FEW_KEPT + 1:
            for at in range(FEW_KEPT):
                self._enter(at)
        if len(self.boxes) > FEW_KEPT:
            self._enter(len(self.boxes) - 1)

    def overlap(self, box: tuple, threshold: float) -> int:
        """Place of the first kept box that really overlaps, and enough, or -1."""
        x, y, w, h = box
        few = len(self.boxes) <= FEW_KEPT
        for at in range(len(self.boxes)) if few else sorted({i for cell in self._cells(box) for i in self.cells.get(cell, ())}):
            kx, ky, kw, kh = self.boxes[at]
            iw = min(kx + kw, x + w) - max(kx, x)
            ih = min(ky + kh, y + h) - max(ky, y)
            if iw > 0 and ih > 0 and iw * ih / (kw * kh + w * h - iw * ih) >= threshold:
                return at
        return -1

    def widen(self, at: int, box: tuple) -> bool:
        """Grow a kept box around ``box``; true when it grew."""
        x, y, w, h = box
        kx, ky, kw, kh = self.boxes[at]
        nx, ny = min(kx, x), min(ky, y)
        wide = (nx, ny, max(kx + kw, x + w) - nx, max(ky + kh, y + h) - ny)
        if wide == self.boxes[at]:
            return False
        self.boxes[at] = wide
        if len(self.boxes) > FEW_KEPT:
            self._enter(at)
        return True


def _in_order(boxes: DataFrame, attributes: list[str], order: list[str]) -> DataFrame:
    """Distinct rows with a copy count, placed by island and in visiting order.

    Slides with few boxes move once and stay whole; the islands of a crowded one are spread."""
    def folded(rows):
        return rows.groupBy("slide", "x", "y", "w", "h", *attributes).agg(F.count(F.lit(1)).alias("n"))

    hot, total = crowding(boxes, ["slide"])
    few = (boxes if hot is None else boxes.where(~hot)).repartition(1 + total // TASK_ROWS, "slide")
    placed = _own_islands(folded(few))
    if hot is not None:
        placed = placed.unionByName(_edge_islands(folded(boxes.where(hot))).repartition("slide", "iy", "ix"))
    return placed.sortWithinPartitions("slide", "iy", "ix", *order)


class _Merge:
    """One pass of greedy merging; ``facts`` per kept box: confidence, detector members, OCR members, text."""

    def __init__(self, threshold: float):
        self.threshold, self.kept, self.facts = threshold, Kept(), []

    def visit(self, box: tuple, confidence: float, cv: int, ocr: int, text: str, copies: int = 1) -> None:
        while copies:
            at = self.kept.overlap(box, self.threshold)
            if at < 0:
                self.kept.add(box)
                self.facts.append([confidence, 0, 0, text])
            grown = at >= 0 and self.kept.widen(at, box)
            # once a copy no longer changes its target, the other copies follow it
            took = 1 if grown else copies
            facts = self.facts[at]
            facts[0] = max(facts[0], confidence)
            facts[1] += cv * took
            facts[2] += ocr * took
            facts[3] = text or facts[3]
            copies -= took

    def rows(self) -> list[tuple]:
        """Kept boxes with their facts in reading order; equal places stay in kept order."""
        return sorted(((*box, *facts) for box, facts in zip(self.kept.boxes, self.facts)), key=lambda r: (r[1], r[0]))

    def again(self) -> _Merge:
        """The next pass, which has visited what this one kept."""
        out = _Merge(self.threshold)
        for x, y, w, h, confidence, cv, ocr, text in self.rows():
            out.visit((x, y, w, h), confidence, cv, ocr, text)
        return out


def merge_overlaps(candidates: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Greedy merge in two passes: each box joins the first kept box it overlaps enough.

    Boxes of the detector are merged in reading order; what is kept is ordered
    again and merged once more, now followed by the OCR boxes. The result depends on
    the order of visits, so an island is walked in order; islands run in parallel and
    rows are streamed, so a task holds only the kept boxes of its current island.
    """
    rows = candidates.select("slide", "x", "y", "w", "h", (F.col("detector") == "ocr").cast("int").alias("stage"),
                             F.round("confidence", 6).alias("confidence"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = _in_order(rows, ["stage", "confidence", "text"], ["stage", "y", "x", "h", "w", "confidence", "text"])

    names = ["slide", "x", "y", "w", "h", "confidence", "cv_members", "ocr_members", "text"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        island, stage_now, merge, done = None, 0, _Merge(threshold), []

        def close() -> None:
            last = merge if stage_now else merge.again()
            done.extend((island[0], *r) for r in last.rows())

        for batch in batches:
            for slide, x, y, w, h, stage, confidence, text, left, iy, ix in batch.itertuples(index=False, name=None):
                if (slide, iy, ix) != island:
                    if island:
                        close()
                    island, stage_now, merge = (slide, iy, ix), 0, _Merge(threshold)
                if stage and not stage_now:
                    merge, stage_now = merge.again(), 1
                merge.visit((x, y, w, h), confidence, 1 - stage, stage, text, left)
            yield pd.DataFrame(done, columns=names)
            done = []
        if island:
            close()
        yield pd.DataFrame(done, columns=names)

    ordered = ordered.select("slide", "x", "y", "w", "h", "stage", "confidence", "text", "n", "iy", "ix")
    return ordered.mapInPandas(walk, "slide bigint, x bigint, y bigint, w bigint, h bigint, confidence double, cv_members bigint, ocr_members bigint, text string")


def suppress(manual: DataFrame, candidates: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Manual boxes stay; a candidate stays unless it overlaps anything kept before."""
    base = ["slide", "x", "y", "w", "h"]
    rows = (manual.select(*base, F.lit(0).alias("stage"), "confidence")
            .unionByName(candidates.select(*base, F.lit(1).alias("stage"), "confidence")))
    ordered = _in_order(rows, ["stage", "confidence"], ["stage", "y", "x", "h", "w", "confidence"])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        island, kept = None, Kept()
        for batch in batches:
            keep = []
            for slide, x, y, w, h, stage, confidence, n, iy, ix in batch.itertuples(index=False, name=None):
                if (slide, iy, ix) != island:
                    island, kept = (slide, iy, ix), Kept()
                box = (x, y, w, h)
                if stage == 0 or kept.overlap(box, threshold) < 0:
                    # copies of a kept candidate overlap it fully and go
                    keep.append((slide, *box, "candidate" if stage else "manual", confidence, 1 if stage else n))
                    kept.add(box)
            yield pd.DataFrame(keep, columns=["slide", "x", "y", "w", "h", "origin", "confidence", "copies"])

    ordered = ordered.select("slide", "x", "y", "w", "h", "stage", "confidence", "n", "iy", "ix")
    return ordered.mapInPandas(walk, "slide bigint, x bigint, y bigint, w bigint, h bigint, origin string, confidence double, copies bigint")


def clear_of_manual(manual: DataFrame, candidates: DataFrame, threshold: float = 0.45, cell: int = CELL, crowd: int = CROWD) -> DataFrame:
    """Candidates that no manual box covers (the order-free half of ``suppress``)."""
    box = ["x", "y", "w", "h"]
    side = lambda rows, at, p, cond: rows.where(cond).select(*at, *[F.col(c).alias(p + c) for c in box])
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in candidates.schema]
    # a candidate finds its manual boxes on its slide; only crowded slides need a grid
    every = candidates.withColumn("_manual", F.lit(False)).unionByName(manual.select("slide", *box).withColumn("_manual", F.lit(True)), allowMissingColumns=True)
    few, many = by_slide(every, crowd)
    own = few.where("not _manual").select(*columns)
    clear = own.alias("b").join(few.where("_manual").select("slide", *[F.col(c).alias("a" + c) for c in box]).alias("a"), (F.col("a.slide") == F.col("b.slide")) & (iou("a.a", "b.") >= threshold), "left_anti")
    if many is None:
        return clear
    spread, full = leaves(many.select("slide", *box, "_manual").distinct(), cell, crowd=crowd)
    m, k, on = meeting(side(spread, LEAF, "a", "_manual"), side(spread, LEAF, "b", "not _manual"), full, crowd)
    hit = k.join(m, on).where(iou("a", "b") >= threshold).select("slide", *[F.col("b" + c).alias(c) for c in box]).distinct()
    return clear.unionByName(many.where("not _manual").select(*columns).join(hit, ["slide", *box], "left_anti"))


def inpaint_allowed(draft: bool = False) -> Column:
    approved = F.coalesce(F.col("exception_approved"), F.lit(False)) & ~blank(F.col("exception_reason"))
    known = ~F.col("class").eqNullSafe("unknown_text") | approved  # a region without class stays
    return F.coalesce(F.col("inpaint_allowed"), F.lit(True)) & (F.lit(draft) | known)


def join_background(regions: DataFrame, backgrounds: DataFrame, key: str = "id", draft: bool = False) -> DataFrame:
    """Regions that may be cleaned, with their background type (unknown if absent)."""
    wanted = regions.where(inpaint_allowed(draft))
    return (wanted.join(backgrounds, ["slide", key], "left")
            .withColumn("background_type", F.coalesce("background_type", F.lit("complex_unknown"))))


def route_repair(rows: DataFrame) -> DataFrame:
    """Repair method, status and leftover risk of a background type."""
    t = F.col("background_type")
    method = lookup(t, vocab.REPAIR_OF, "manual_review")
    unknown = t == "complex_unknown"
    status = (F.when(method.isin("redraw", "inpaint"), "pass").when(method == "native_reconstruct", "partial")
              .when(unknown, "fail").otherwise("partial"))
    risk = (F.when(method == "redraw", "low").when(method == "inpaint", F.when(t == "photo_texture", "medium").otherwise("low"))
            .when(unknown, "high").otherwise("medium"))
    return rows.withColumns({"repair_method": method, "repair_status": status, "residual": risk})


def repair_summary(routed: DataFrame) -> DataFrame:
    """Method counts and the deck's overall status and risk, per slide."""
    def count(m):
        return F.count_if(F.col("repair_method") == m)
    agg = routed.groupBy("slide").agg(
        count("redraw").alias("redraw"), count("inpaint").alias("inpaint"), count("manual_review").alias("manual_review"),
        count("native_reconstruct").alias("native_reconstruct"), F.bool_or(F.col("repair_status") == "fail").alias("failed"))
    partial = (F.col("manual_review") > 0) | (F.col("native_reconstruct") > 0)
    status = F.when(F.col("failed"), "fail").when(partial, "partial").otherwise("pass")
    risk = F.when(F.col("failed"), "high").when(partial | (F.col("inpaint") > F.col("redraw")), "medium").otherwise("low")
    return agg.select("slide", "redraw", "inpaint", "manual_review", "native_reconstruct", status.alias("status"), risk.alias("risk"))


def classify_background(regions: DataFrame) -> DataFrame:
    """Background type from words, else from colour spread and edge share."""
    meta, std, edge = F.col("meta"), F.col("color_std"), F.col("edge_density")
    rules = [(contains_any(meta, words), bg, conf) for bg, conf, words in vocab.BACKGROUND_WORDS]
    rules += [((std <= 5.5) & (edge <= 0.10), "flat_color", 0.86), ((std <= 22.0) & (edge <= 0.08), "gradient", 0.68),
              ((std >= 34.0) & (edge >= 0.16), "photo_texture", 0.66), (edge >= 0.22, "complex_unknown", 0.55),
              (std <= 18.0, "panel", 0.62), (F.lit(True), "complex_unknown", 0.50)]
    pick = None
    for cond, bg, conf in rules:
        row = F.struct(F.lit(bg).alias("t"), F.lit(conf).alias("c"))
        pick = F.when(cond, row) if pick is None else pick.when(cond, row)
    out = regions.withColumn("_p", pick)
    return (out.withColumn("background_type", F.col("_p.t")).withColumn("background_confidence", F.col("_p.c"))
            .withColumn("recommended_repair", lookup(F.col("background_type"), vocab.REPAIR_OF)).drop("_p"))


def region_padding(regions: DataFrame, min_pad: int = 2, dilate: int = 3, pseudo: int = 2, shadow: int = 5) -> DataFrame:
    """``base_pad, pad`` of each region. ``style``, ``visual``, ``notes`` and ``effects`` (struct ``shadow, glow``) are read where they are columns."""
    cls = F.col("class")
    meta = F.lower(F.concat_ws(" ", *[F.col(x).cast("string") for x in ("role", "style", "visual", "notes") if x in regions.columns]))
    shadowed = contains_any(meta, vocab.SHADOW_WORDS)
    if "effects" in regions.columns:
        shadowed |= F.coalesce(F.col("effects.shadow"), F.lit(False)) | F.coalesce(F.col("effects.glow"), F.lit(False))
    base = F.greatest(F.lit(min_pad), F.coalesce(F.col("padding_px"), F.lit(0)))
    by_class = (F.when(cls == "semantic_text", dilate).when(cls == "micro_text", max(1, min(dilate, 2)))
                .when(cls.isin(vocab.PSEUDO_CLASSES), pseudo).otherwise(max(dilate, pseudo)))
    title = contains_any(meta, vocab.TITLE_WORDS) | ((F.col("h") >= 34) & (cls == "semantic_text"))
    pad = (base + by_class + F.when(title, max(2, dilate // 2)).otherwise(0)
           + F.when(F.col("confidence") < 0.78, max(2, shadow // 2)).otherwise(0)
           + F.when(shadowed, shadow).otherwise(0))
    return regions.withColumn("base_pad", base.cast("bigint")).withColumn("pad", F.least(pad, F.lit(32)).cast("bigint"))


def reading_order(boxes: DataFrame, unique: str) -> DataFrame:
    """Place in reading order (y, then x) per slide; counts are summed per strip of 16 lines first."""
    tagged = boxes.withColumn("_h", F.md5(F.col(unique).cast("binary")))
    out = running_number(tagged, ["slide"], [(F.col("y"), False), (F.col("x"), False)], "_h", "place", F.substring("_h", 1, 2), F.floor(F.col("y") / 16))
    return out.drop("_h")


def free_numbers(asked: DataFrame, used: DataFrame) -> DataFrame:
    """``asked`` with ``num``, the ``_k``-th whole number from 1 on that ``used`` (``slide, num``) does not hold.

    The i-th used number u has u - i free ones below it, so the k-th free number is k plus how many used
    ones have fewer than k below them: a lookup among gaps, on crowded slides in bands of k. No number is written out.
    """
    hot = crowded(asked.select("slide").unionByName(used.select("slide")), ["slide"])
    part = lambda df, cond: df if hot is None else df.where(cond)
    few = _free_numbers(part(asked, hot is None or ~hot), part(used, hot is None or ~hot))
    return few if hot is None else few.unionByName(_free_numbers_in_bands(asked.where(hot), used.where(hot)))


def _gap_events(asked: DataFrame, gaps: DataFrame, *more: str) -> DataFrame:
    """Questions and gaps by place; at one place the question comes before the gap: only gaps with fewer than k free numbers below count."""
    rows = asked.withColumn("_at", F.col("_k")).withColumn("_band", F.floor(F.col("_k") / 4096)).withColumn("_i", F.lit(None).cast("bigint"))
    events = rows.select("slide", "_at", *more, "_i", F.struct(*asked.columns).alias("_row")).unionByName(gaps.select("slide", "_at", *more, "_i"), allowMissingColumns=True)
    upto = W.partitionBy("slide", *more).orderBy("_at", F.col("_i").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return events.withColumn("_seen", F.max("_i").over(upto)).where("_row is not null")


def _free_numbers(asked: DataFrame, used: DataFrame) -> DataFrame:
    """One window per slide."""
    own = F.row_number().over(W.partitionBy("slide").orderBy("num")).cast("bigint")
    gaps = used.select("slide", "num", own.alias("_i")).select("slide", (F.col("num") - F.col("_i")).alias("_at"), "_i")
    return _gap_events(asked, gaps).select("_row.*", (F.col("_row._k") + F.coalesce("_seen", F.lit(0))).alias("num"))


def _free_numbers_in_bands(asked: DataFrame, used: DataFrame) -> DataFrame:
    below = running_number(used, ["slide"], [], "num", "_i").select("slide", (F.col("num") - F.col("_i")).alias("_at"), "_i")
    gaps = below.groupBy("slide", "_at").agg(F.max("_i").alias("_i"))
    band = F.floor(F.col("_at") / 4096).alias("_band")
    marks = gaps.select("slide", "_at", band, "_i")
    carried = marks.groupBy("slide", "_band").agg(F.max("_i").alias("_i")).select("slide", "_band", "_i")
    # a band starts with the count that the bands before it have reached
    bands = asked.select("slide", F.floor(F.col("_k") / 4096).alias("_band")).distinct()
    earlier = W.partitionBy("slide").orderBy("_band", F.col("_i").isNotNull()).rowsBetween(W.unboundedPreceding, -1)
    both = bands.select("slide", "_band", F.lit(None).cast("bigint").alias("_i")).unionByName(carried)
    start = both.select("slide", "_band", F.col("_i").alias("_own"), F.max("_i").over(earlier).alias("_start")).where("_own is null").drop("_own")
    out = _gap_events(asked, marks, "_band").join(start, ["slide", "_band"], "left")
    return out.select("_row.*", (F.col("_row._k") + F.coalesce("_seen", "_start", F.lit(0))).alias("num"))


def assign_ids(regions: DataFrame, unique: str) -> DataFrame:
    """Give rows without id (null or empty) the lowest free ``r001..`` of their slide, in reading order."""
    regions = regions.withColumn("id", F.nullif("id", F.lit("")))
    used = (regions.where("id IS NOT NULL").select("slide", F.regexp_extract("id", "^r([0-9]{3,})$", 1).alias("d"))
            .where("d <> ''").select("slide", F.col("d").try_cast("bigint").alias("num"), "d")
            .where(F.format_string("%03d", "num") == F.col("d")).select("slide", "num").distinct())
    missing = regions.where("id IS NULL")
    numbered = reading_order(missing, unique).withColumnRenamed("place", "_k")
    filled = free_numbers(numbered, used).withColumn("id", F.format_string("r%03d", "num")).drop("num", "_k")
    return regions.where("id IS NOT NULL").unionByName(filled.select(*regions.columns))


def class_counts(regions: DataFrame) -> DataFrame:
    return regions.groupBy("slide", "class").agg(F.count(F.lit(1)).alias("regions"))


def union_detectors(manual: DataFrame, cv: DataFrame, ocr: DataFrame) -> DataFrame:
    """One region table from three detectors, with defaults where a field is absent."""
    both = (manual.withColumn("source", F.coalesce("source", F.lit("manual"))).withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
            .unionByName(cv.withColumn("source", F.lit("cv_candidate")), allowMissingColumns=True)
            .unionByName(ocr.withColumn("source", F.lit("ocr_candidate")), allowMissingColumns=True))
    def given(name, default, kind):
        return (F.coalesce(F.col(name), F.lit(default)) if name in both.columns else F.lit(default)).cast(kind).alias(name)
    return both.select("slide", "x", "y", "w", "h", "source", given("confidence", 0.0, "double"), given("class", "unknown_text", "string"),
                       given("corrected_text", "", "string"), given("role", "", "string"), given("ocr_text", "", "string"),
                       given("inpaint_allowed", True, "boolean"), given("padding_px", 2, "bigint"))


# ---- pixels of regions -------------------------------------------------------

def with_neighbours(pixels: DataFrame, value: str, prefix: str, band: int = 64) -> DataFrame:
    """Adds left, right, up and down values of ``value``; null outside the image."""
    return with_many_neighbours(pixels, {value: prefix}, band)


def with_many_neighbours(pixels: DataFrame, values: dict[str, str], band: int = 64) -> DataFrame:
    rows = with_bands(pixels, 1, band)
    wx = W.partitionBy("slide", "band", "y").orderBy("x")
    wy = W.partitionBy("slide", "band", "x").orderBy("y")
    cols = {}
    for v, p in values.items():
        cols |= {p + "_l": F.lag(v).over(wx), p + "_r": F.lead(v).over(wx), p + "_u": F.lag(v).over(wy), p + "_d": F.lead(v).over(wy)}
    return rows.withColumns(cols).where("owned").drop("band", "owned")


def region_pixels(pixels: DataFrame, boxes: DataFrame, pad, width: int, height: int, keys=("id",)) -> DataFrame:
    """Pixels of each padded box, with ``inner`` = inside the unpadded box.

    Boxes become scan lines, so pixels meet them on (slide, y, cell of x), not through a
    comparison of every pixel with every box.
    """
    inner = corners(*[F.col(c) for c in "xywh"], width, height, 0)
    outer = corners(*[F.col(c) for c in "xywh"], width, height, pad)
    b = boxes.select("slide", *keys, *[c.alias("i" + n) for c, n in zip(inner, ("x1", "y1", "x2", "y2"))], *outer)
    lines = b.select("*", F.explode(F.sequence(F.col("y1"), F.col("y2") - 1)).alias("y"))
    # a scan line is cut into cells too, so a wide raster's line is not one key
    lines = lines.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("x1") / X_CELL), F.floor((F.col("x2") - 1) / X_CELL))))
    placed = pixels.withColumn("_cx", F.floor(F.col("x") / X_CELL))
    hit = lines.join(placed, ["slide", "y", "_cx"]).drop("_cx").where((F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2")))
    inside = ((F.col("x") >= F.col("ix1")) & (F.col("x") < F.col("ix2")) & (F.col("y") >= F.col("iy1")) & (F.col("y") < F.col("iy2")))
    return hit.withColumn("inner", inside)


def crop_slope(value: str, prefix: str) -> tuple[Column, Column]:
    """Doubled gradient inside a crop: one-sided on the crop's own border."""
    def one(pos, lo, hi, before, after):
        cur = F.col(value)
        b, a = F.col(prefix + before), F.col(prefix + after)
        first, last = F.col(pos) == F.col(lo), F.col(pos) == F.col(hi) - 1
        return F.when(first & last, 0).when(first, (a - cur) * 2).when(last, (cur - b) * 2).otherwise(a - b)
    return one("x", "x1", "x2", "_l", "_r"), one("y", "y1", "y2", "_u", "_d")


def ring_pad(w: Column, h: Column) -> Column:
    return clamp(F.floor(F.greatest(w, h) * 0.18), 8, 28)


def ring_stats(ring: DataFrame, keys=("slide", "id")) -> DataFrame:
    """Mean channel spread and edge share of the ring around each region."""
    gx, gy = crop_slope("l", "l")
    outside = ~F.col("inner")
    strong = outside & ((gx * gx + gy * gy) > 36000 * 36000)

    def sums(cond, tag):
        out = [F.count_if(cond).alias("n" + tag)]
        for c in "rgb":
            v = F.when(cond, F.col(c))
            out += [F.sum(v).alias(c + tag), F.sum(v * v).alias(c + c + tag)]
        return out

    agg = ring.groupBy(*keys).agg(*sums(outside, "_o"), *sums(F.lit(True), "_a"), F.count_if(strong).alias("strong"))
    few = F.col("n_o") < 8

    def std(c):
        n = F.when(few, F.col("n_a")).otherwise(F.col("n_o"))
        s = F.when(few, F.col(c + "_a")).otherwise(F.col(c + "_o"))
        q = F.when(few, F.col(c + c + "_a")).otherwise(F.col(c + c + "_o"))
        return F.sqrt((n * q - s * s).cast("double")) / n

    return agg.select(*keys, ((std("r") + std("g") + std("b")) / 3).alias("color_std"),
                      (F.col("strong") / F.greatest(F.col("n_o"), F.lit(1))).alias("edge_density"), F.col("n_o").alias("ring_pixels"))


def top_colors(ring: DataFrame, k: int = 5, keys=("slide", "id")) -> DataFrame:
    """Most frequent colours of the ring in steps of 16; ties by colour, descending."""
    def q(c):
        return F.floor(F.col(c) / 16) * 16
    # count both ways first, so the choice is made on a few hundred rows per region
    counted = (ring.withColumn("color", F.upper(F.concat(F.lit("#"), *[F.lpad(F.hex(q(c)), 2, "0") for c in "rgb"])))
               .groupBy(*keys, "color").agg(F.count_if(~F.col("inner")).alias("n_o"), F.count(F.lit(1)).alias("n_a")))
    whole = W.partitionBy(*keys)
    chosen = counted.withColumn("n", F.when(F.sum("n_o").over(whole) < 8, F.col("n_a")).otherwise(F.col("n_o"))).where("n > 0")
    w = whole.orderBy(F.desc("n"), F.desc("color"))
    return (chosen.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
            .select(*keys, F.col("place").cast("bigint").alias("place"), "color", F.col("n").alias("pixels")))


def median_fill(ring: DataFrame, keys=("slide", "id")) -> DataFrame:
    """Channel medians of unmasked ring pixels, with the two fallbacks.

    A channel has 256 values, so the exact percentile's buffer is bounded.
    """
    clear = ~F.col("masked")
    sets = {"a": ~F.col("inner") & clear, "b": clear, "c": F.lit(True)}
    aggs = [F.count_if(s).alias("n" + t) for t, s in sets.items()]
    aggs += [F.percentile(F.when(s, F.col(c)), 0.5).alias(c + t) for t, s in sets.items() for c in "rgb"]
    agg = ring.groupBy(*keys).agg(*aggs)

    def pick(c):
        v = F.when(F.col("na") >= 8, F.col(c + "a")).when(F.col("nb") >= 8, F.col(c + "b")).otherwise(F.col(c + "c"))
        return clamp(bankers(v), 0, 255).alias(c)

    return agg.select(*keys, *[pick(c) for c in "rgb"])


def residual_risk(area: DataFrame, keys=("slide", "id"), high=(80, 0.10), medium=(30, 0.04)) -> DataFrame:
    """Gradient left behind in masked pixels after a repair, per region."""
    bx, by = crop_slope("before", "before")
    ax, ay = crop_slope("after", "after")
    masked = area.where("masked").select(
        *keys, (F.sqrt((bx * bx + by * by).cast("double")) / 2000).alias("before_mag"), (F.sqrt((ax * ax + ay * ay).cast("double")) / 2000).alias("after_mag"))
    p70 = exact_quantile(masked, list(keys), "before_mag", 0.70, F.floor(F.col("before_mag") * 8), "p70")
    limit = p70.select(*keys, F.greatest(F.lit(14.0), F.col("p70") * 0.35).alias("limit"))
    per = (masked.join(limit, list(keys)).groupBy(*keys).agg(
        F.count_if(F.col("after_mag") > F.col("limit")).alias("residual_pixels"), F.count(F.lit(1)).alias("mask_pixels")))
    every = area.select(*keys).distinct().join(per, list(keys), "left").fillna(0, ["residual_pixels", "mask_pixels"])
    ratio = F.col("residual_pixels") / F.greatest(F.col("mask_pixels"), F.lit(1))
    risk = (F.when((F.col("residual_pixels") >= high[0]) & (ratio >= high[1]), "high")
            .when((F.col("residual_pixels") >= medium[0]) & (ratio >= medium[1]), "medium").otherwise("low"))
    return every.select(*keys, "residual_pixels", "mask_pixels", risk.alias("residual_risk"))


def worst_risk(risks: DataFrame) -> DataFrame:
    worst = F.max(rank_of(F.col("residual_risk"), vocab.RISK_RANK, 2))
    return risks.groupBy("slide").agg(worst.alias("r")).select(
        "slide", name_of(F.col("r"), vocab.RISK_RANK).alias("residual_risk"),
        F.when(F.col("r") >= 2, "fail").when(F.col("r") == 1, "partial").otherwise("pass").alias("status"))


def mask_coverage(boxes: DataFrame, width: int, height: int, max_coverage: float = 0.25, allow: bool = False, slides: DataFrame | None = None) -> DataFrame:
    """Share of the canvas under the mask; counted from spans, not from pixels.

    ``slides`` (column ``slide``) names all slides; one without a mask has share 0.
    """
    covered = mask_spans(boxes).groupBy("slide").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("masked"))
    if slides is not None:
        covered = slides.select("slide").distinct().join(covered, "slide", "left").withColumn("masked", F.coalesce("masked", F.lit(0)))
    share = F.col("masked") / F.lit(width * height)
    over = F.col("coverage") > max_coverage
    return covered.select("slide", "masked", share.alias("coverage")).select(
        "*", F.when(over, "pass_with_exception" if allow else "fail").otherwise("pass").alias("policy_status"),
        F.when(over, "high").when(F.col("coverage") > 0.10, "medium").otherwise("low").alias("artifact_risk"),
        F.when(F.col("coverage") > 0.18, "high").when(F.col("coverage") > 0.06, "medium").otherwise("low").alias("residual_risk"))


def feather_alpha(crop_pixels: DataFrame, reach: int = 26) -> DataFrame:
    """Linear fade to zero at the chosen edges; ``i, j`` are places inside the crop."""
    def ramp(pos: Column, size: Column, start: str, end: str) -> Column:
        n = F.least(F.lit(reach), size)
        step = F.when(n > 1, (n - 1).cast("double"))
        rise = F.when(F.contains(F.col("edges"), F.lit(start)) & (pos < n), F.coalesce(pos / step, F.lit(0.0))).otherwise(F.lit(1.0))
        back = pos - (size - n)
        fall = F.when(F.contains(F.col("edges"), F.lit(end)) & (back >= 0), F.coalesce(1 - back / step, F.lit(1.0))).otherwise(F.lit(1.0))
        return F.least(rise, fall)
    return crop_pixels.withColumn("alpha", ramp(F.col("i"), F.col("w"), "L", "R") * ramp(F.col("j"), F.col("h"), "T", "B"))


def pixels_in_boxes(pixels: DataFrame, boxes: DataFrame, mode: str, width: int, height: int, pad: int = 0) -> DataFrame:
    """``mask``: pixels under any region, ends inside; ``ring``: padded minus inner;
    ``crop``: inside a box, second corner outside. A mask follows ``polygon`` where boxes have that column."""
    if mode == "mask":
        spans = union_spans(boxes, width, height, pad) if "polygon" in boxes.columns else mask_spans(inclusive(boxes, width, height, pad))
        p, s = pixels.alias("p"), spans.alias("s")
        on = (F.col("p.slide") == F.col("s.slide")) & (F.col("p.y") == F.col("s.y")) & F.col("p.x").between(F.col("s.x0"), F.col("s.x1"))
        return p.join(s, on, "left_semi")
    found = region_pixels(pixels, boxes, pad if mode == "ring" else 0, width, height)
    return found.where(~F.col("inner")) if mode == "ring" else found


def inclusive(boxes: DataFrame, width: int, height: int, pad) -> DataFrame:
    """Corner form whose second corner is filled too, clipped to the canvas."""
    c = boxes.select("slide", *corners(*[F.col(n) for n in "xywh"], width, height, pad))
    return c.select("slide", "x1", "y1", F.least(F.col("x2"), F.lit(width - 1)).alias("x2"), F.least(F.col("y2"), F.lit(height - 1)).alias("y2"))


def delta_mask(boxes_base: DataFrame, boxes_wide: DataFrame) -> DataFrame:
    """Mask pixels added by the expanded mask, as a count per slide."""
    def area(b):
        return mask_spans(b).groupBy("slide").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
    return (area(boxes_wide).withColumnRenamed("n", "wide").join(area(boxes_base).withColumnRenamed("n", "base"), "slide", "left")
            .select("slide", "wide", F.coalesce("base", F.lit(0)).alias("base"), (F.col("wide") - F.coalesce("base", F.lit(0))).alias("added")))

