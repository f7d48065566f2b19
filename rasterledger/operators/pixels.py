"""Raster metrics as joins, aggregates and windows over pixel rows.

Rasters are dense integer rows ``(slide, surface, x, y, r, g, b)``. Anything that
looks at neighbours works on horizontal bands: each pixel row is sent to its band
and, near a band border, to the next band too (the halo). One exchange on
``(slide, band)`` then serves every window, and no task ever holds more than one
band, however large one raster is. Channel sums stay whole numbers until one last
division, so the results do not depend on the order of summation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions.quantiles import exact_quantile
from ..functions.rounds import Rounds
from ..functions.stars import components

BAND = 64
PLACE = 1 << 31        # columns of a raster, so that y * PLACE + x names one pixel
EDGE_FLOOR = 10200.0   # 0.04 on the scale of luma()
DARK_TEXT = 158100     # 0.62 on the scale of luma()


def luma(r="r", g="g", b="b") -> Column:
    """Gray value x 1000 as a whole number (0..255000)."""
    return F.col(r) * 299 + F.col(g) * 587 + F.col(b) * 114


def with_bands(pixels: DataFrame, halo: int, band: int = BAND) -> DataFrame:
    """Adds ``band`` and ``owned``; rows near a band border appear in both bands."""
    first = F.greatest(F.floor((F.col("y") - halo) / band), F.lit(0))
    last = F.floor((F.col("y") + halo) / band)
    spread = pixels.withColumn("band", F.explode(F.sequence(first, last)))
    return (spread.withColumn("owned", F.floor(F.col("y") / band) == F.col("band"))
            .repartition("slide", "band"))


def _axes(*keys: str):
    """Windows along x and along y inside one band."""
    along_x = W.partitionBy("slide", *keys, "band", "y").orderBy("x")
    along_y = W.partitionBy("slide", *keys, "band", "x").orderBy("y")
    return along_x, along_y


def pair_surfaces(surfaces: DataFrame) -> DataFrame:
    """Aligned pixels of the three comparisons, from one exchange."""
    names = sorted({s for a, b, _ in vocab.COMPARISONS.values() for s in (a, b)})
    # plain maxima per channel stay in the hash aggregate
    wide = surfaces.groupBy("slide", "x", "y").agg(*[F.max(F.when(F.col("surface") == n, F.col(ch))).alias(f"{n}_{ch}") for n in names for ch in "rgb"])
    faces = [F.when(F.col(f"{n}_r").isNotNull(), F.struct(*[F.col(f"{n}_{ch}").alias(ch) for ch in "rgb"])).alias(n) for n in names]
    return stack_comparisons(wide.select("slide", "x", "y", *faces), ["slide", "x", "y"])


def stack_comparisons(wide: DataFrame, keys: list[str]) -> DataFrame:
    sides = [F.struct(F.lit(label).alias("comparison"), F.col(a).alias("s"), F.col(b).alias("t"))
             for label, (a, b, _) in vocab.COMPARISONS.items()]
    return (wide.select(*keys, F.explode(F.array(*sides)).alias("c"))
            .where("c.s IS NOT NULL AND c.t IS NOT NULL")
            .select(*keys[:1], "c.comparison", *keys[1:],
                    F.col("c.s.r").alias("sr"), F.col("c.s.g").alias("sg"), F.col("c.s.b").alias("sb"),
                    F.col("c.t.r").alias("rr"), F.col("c.t.g").alias("rg"), F.col("c.t.b").alias("rb")))


def _diffs() -> list[Column]:
    return [F.abs(F.col("s" + c) - F.col("r" + c)) for c in "rgb"]


def _changed(threshold: float) -> Column:
    a, b, c = _diffs()
    return (a + b + c).cast("double") > F.lit(threshold * 765)


def _box(flag: Column, prefix: str) -> list[Column]:
    x0, x1 = F.min(F.when(flag, F.col("x"))), F.max(F.when(flag, F.col("x")))
    y0, y1 = F.min(F.when(flag, F.col("y"))), F.max(F.when(flag, F.col("y")))
    zero = F.lit(0).cast("bigint")
    return [F.coalesce(x0, zero).alias(prefix + "x"), F.coalesce(y0, zero).alias(prefix + "y"),
            F.coalesce(x1 - x0 + 1, zero).alias(prefix + "w"), F.coalesce(y1 - y0 + 1, zero).alias(prefix + "h")]


def pixel_metrics(pairs: DataFrame, threshold: float = 0.08) -> DataFrame:
    a, b, c = _diffs()
    n = F.count(F.lit(1))
    return pairs.groupBy("slide", "comparison").agg(
        (F.sum(_changed(threshold).cast("bigint")) / n).alias("pixel_difference_ratio"),
        (F.sum(a + b + c) / (n * 765)).alias("mean_absolute_error"),
        (F.max(F.greatest(a, b, c)) / F.lit(255)).alias("max_channel_error"))


def diff_bbox(pairs: DataFrame, threshold: float = 0.08) -> DataFrame:
    return pairs.groupBy("slide", "comparison").agg(*_box(_changed(threshold), ""))


def _bin(prefix: str) -> Column:
    def part(c):
        return F.least(F.floor(F.col(prefix + c) * 8 / 255), F.lit(7))
    return (part("r") * 64 + part("g") * 8 + part("b")).cast("int")


def palette_drift(pairs: DataFrame) -> DataFrame:
    """Half the absolute difference of two 8x8x8 colour histograms."""
    sides = F.array(F.struct(_bin("s").alias("bin"), F.lit(1).alias("s"), F.lit(0).alias("t")),
                    F.struct(_bin("r").alias("bin"), F.lit(0).alias("s"), F.lit(1).alias("t")))
    hist = (pairs.select("slide", "comparison", F.explode(sides).alias("h"))
            .groupBy("slide", "comparison", "h.bin").agg(F.sum("h.s").alias("s"), F.sum("h.t").alias("t")))
    return hist.groupBy("slide", "comparison").agg(
        (F.sum(F.abs(F.col("s") - F.col("t"))) / (F.sum("s") * 2)).alias("color_palette_drift"))


def surface_drift(surfaces: DataFrame) -> DataFrame:
    """``palette_drift`` of all comparisons from per-surface histograms.

    Pixels are counted where they are read (at most 512 bins per surface leave a
    task), so no pixel is shuffled.
    """
    def part(c):
        return F.least(F.floor(F.col(c) * 8 / 255), F.lit(7))
    names = sorted({s for a, b, _ in vocab.COMPARISONS.values() for s in (a, b)})
    bins = (surfaces.groupBy("slide", "surface", (part("r") * 64 + part("g") * 8 + part("b")).cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))
    wide = bins.groupBy("slide", "bin").agg(*[F.sum(F.when(F.col("surface") == n, F.col("n")).otherwise(0)).alias(n) for n in names])
    total = W.partitionBy("slide")
    wide = wide.select("slide", *names, *[F.sum(n).over(total).alias("all_" + n) for n in names])
    gaps = [F.struct(F.lit(label).alias("comparison"),
                     (F.sum(F.abs(F.col(a) * F.col("all_" + b) - F.col(b) * F.col("all_" + a)))
                      / F.nullif(F.max(F.col("all_" + a) * F.col("all_" + b)) * 2, F.lit(0))).alias("color_palette_drift"))
            for label, (a, b, _) in vocab.COMPARISONS.items()]
    return wide.groupBy("slide").agg(F.array(*gaps).alias("g")).select("slide", F.explode("g").alias("g")).select("slide", "g.*").where("color_palette_drift IS NOT NULL")


def gradient(surfaces: DataFrame, mode: str = "central", band: int = BAND, keep_band: bool = False) -> DataFrame:
    """``central``: next - previous, zero on the border. ``half``: halved inside,
    one-sided on the border. Returned doubled (``gx2``, ``gy2``) so it stays whole."""
    rows = with_bands(surfaces.select("slide", "surface", "x", "y", luma().alias("l")), 1, band)
    rows = rows.select("slide", "surface", "band", "owned", "x", "y", "l")
    along_x, along_y = _axes("surface")

    def slope(w):
        prev, cur, nxt = F.lag("l").over(w), F.col("l"), F.lead("l").over(w)
        if mode == "central":
            return F.coalesce((nxt - prev) * 2, F.lit(0))
        inner = nxt - prev
        return F.coalesce(inner, (nxt - cur) * 2, (cur - prev) * 2, F.lit(0))

    out = rows.withColumn("gx2", slope(along_x)).withColumn("gy2", slope(along_y)).where("owned")
    return out.select("slide", "surface", *(["band"] if keep_band else []), "x", "y", F.col("gx2").cast("bigint").alias("gx2"), F.col("gy2").cast("bigint").alias("gy2"))


def _magnitude() -> Column:
    return F.sqrt((F.col("gx2") * F.col("gx2") + F.col("gy2") * F.col("gy2")).cast("double")) / 2


def edge_thresholds(mags: DataFrame, keys=("slide", "surface")) -> DataFrame:
    q = exact_quantile(mags, list(keys), "mag", 0.85, F.floor(F.col("mag") / 100), "p85")
    return q.select(*keys, F.greatest(F.col("p85"), F.lit(EDGE_FLOOR)).alias("edge_threshold"))


def edge_flags(surfaces: DataFrame, band: int = BAND) -> DataFrame:
    """Edge = gradient above the image's 85th percentile (and above a floor)."""
    mags = gradient(surfaces, "central", band, keep_band=True).withColumn("mag", _magnitude())
    # the few limits of a slide go to each of its bands, where the pixels already are
    limits = edge_thresholds(mags).groupBy("slide").agg(F.map_from_entries(F.collect_list(F.struct("surface", "edge_threshold"))).alias("limits"))
    last = mags.groupBy("slide").agg(F.max("band").alias("last"))
    limits = limits.join(last, "slide").select("slide", "limits", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("band"))
    return (mags.join(limits.hint("shuffle_hash"), ["slide", "band"])
            .select("slide", "surface", "x", "y", (F.col("mag") > F.try_element_at("limits", F.col("surface"))).alias("edge")))


def edge_metrics(flags: DataFrame) -> DataFrame:
    """Edge density per side, their difference, share and box of disagreement."""
    names = sorted({s for a, b, _ in vocab.COMPARISONS.values() for s in (a, b)})
    wide = flags.groupBy("slide", "x", "y").agg(
        *[F.max(F.when(F.col("surface") == n, F.col("edge").cast("int"))).alias(n) for n in names])
    sides = [F.struct(F.lit(label).alias("comparison"), F.col(a).alias("s"), F.col(b).alias("t"))
             for label, (a, b, _) in vocab.COMPARISONS.items()]
    pairs = (wide.select("slide", "x", "y", F.explode(F.array(*sides)).alias("c"))
             .where("c.s IS NOT NULL AND c.t IS NOT NULL").select("slide", "x", "y", "c.*"))
    return pairs.groupBy("slide", "comparison").agg(*_edge_aggs())


def _edge_aggs() -> list[Column]:
    n = F.count(F.lit(1))
    src, rnd, xor = F.sum("s"), F.sum("t"), F.sum((F.col("s") != F.col("t")).cast("bigint"))
    return [(xor / n).alias("edge_difference_ratio"), (src / n).alias("source_edge_density"),
            (rnd / n).alias("render_edge_density"), ((src - rnd) / n).alias("edge_density_delta"),
            *_box(F.col("s") != F.col("t"), "edge_")]


SSIM_C1 = (0.01 * 255000) ** 2
SSIM_C2 = (0.03 * 255000) ** 2


def _ssim_index(sx, sy, sxx, syy, sxy) -> Column:
    """Structural similarity of one 7x7 window from its five sums."""
    n = 49.0
    ux, uy = sx / n, sy / n
    norm = n * 48.0
    vx = (sxx * 49 - sx * sx) / norm
    vy = (syy * 49 - sy * sy) / norm
    vxy = (sxy * 49 - sx * sy) / norm
    return ((ux * uy * 2 + SSIM_C1) * (vxy * 2 + SSIM_C2)) / ((ux * ux + uy * uy + SSIM_C1) * (vx + vy + SSIM_C2))


def _fixed(index: Column) -> Column:
    return F.round(index * 1e9).cast("bigint")


def ssim(pairs: DataFrame, band: int = BAND) -> DataFrame:
    """Mean structural similarity over full 7x7 windows; null when none fits."""
    rows = with_bands(pairs.withColumn("p", luma("sr", "sg", "sb")).withColumn("q", luma("rr", "rg", "rb")), 3, band)
    along_x, along_y = (w.rowsBetween(-3, 3) for w in _axes("comparison"))
    terms = {"n": F.lit(1), "p": F.col("p"), "q": F.col("q"), "pp": F.col("p") * F.col("p"),
             "qq": F.col("q") * F.col("q"), "pq": F.col("p") * F.col("q")}
    keys = ["slide", "comparison", "band", "owned", "x", "y"]
    across = rows.select(*keys, *[F.sum(v).over(along_x).alias("x_" + k) for k, v in terms.items()])
    boxed = across.select(*keys, *[F.sum("x_" + k).over(along_y).alias("b_" + k) for k in terms])
    full = F.col("b_n") == 49
    index = _ssim_index(*[F.col("b_" + k) for k in ("p", "q", "pp", "qq", "pq")])
    return (boxed.where("owned").groupBy("slide", "comparison").agg(
        F.sum(F.when(full, _fixed(index))).alias("s"), F.sum(full.cast("bigint")).alias("n"))
        .select("slide", "comparison", (F.col("s") / F.when(F.col("n") > 0, F.col("n")) / F.lit(1e9)).alias("approx_ssim")))


def compare_surfaces(surfaces: DataFrame, threshold: float = 0.08, band: int = BAND) -> DataFrame:
    """All comparison metrics of every slide.

    Two passes move pixels, each once, on ``(slide, band)``: a slim one (gray values
    only) finds the edge thresholds, the full one does the rest. In the full pass
    the pivot to one row per position, both window directions and the join with the
    thresholds all reuse that placement; what follows is folded per slide before it
    moves. Colour histograms are counted where the pixels are read.
    """
    names = sorted({s for a, b, _ in vocab.COMPARISONS.values() for s in (a, b)})
    channels = [f"{n}_{c}" for n in names for c in "rgb"]
    mags = gradient(surfaces, "central", band).withColumn("mag", _magnitude())
    limits = edge_thresholds(mags).groupBy("slide").agg(
        *[F.max(F.when(F.col("surface") == n, F.col("edge_threshold"))).alias("limit_" + n) for n in names])
    bands = surfaces.groupBy("slide").agg(F.floor(F.max("y") / band).alias("last"))
    limits = (limits.join(bands, "slide").select(
        "slide", *["limit_" + n for n in names], F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("band")))

    placed = with_bands(surfaces, 3, band)
    wide = placed.groupBy("slide", "band", "y", "x").agg(
        F.max("owned").alias("owned"),
        *[F.max(F.when(F.col("surface") == n, F.col(c))).alias(f"{n}_{c}") for n in names for c in "rgb"])
    wide = wide.select("*", *[luma(f"{n}_r", f"{n}_g", f"{n}_b").alias("l_" + n) for n in names])

    along_x, along_y = _axes()
    seven_x, seven_y = along_x.rowsBetween(-3, 3), along_y.rowsBetween(-3, 3)
    terms = {n: F.col("l_" + n) for n in names}
    terms |= {f"{n}_sq": F.col("l_" + n) * F.col("l_" + n) for n in names}
    terms |= {label: F.col("l_" + a) * F.col("l_" + b) for label, (a, b, _) in vocab.COMPARISONS.items()}
    terms["n"] = F.lit(1)

    def step(n, w):
        return F.coalesce((F.lead("l_" + n).over(w) - F.lag("l_" + n).over(w)) * 2, F.lit(0))

    keys = ["slide", "band", "owned", "y", "x", *channels, *["l_" + n for n in names]]
    across = wide.select(*keys, *[step(n, along_x).alias("gx_" + n) for n in names],
                         *[F.sum(v).over(seven_x).alias("x_" + k) for k, v in terms.items()])
    full = across.select(*keys, *["gx_" + n for n in names], *[step(n, along_y).alias("gy_" + n) for n in names],
                         *[F.sum("x_" + k).over(seven_y).alias("b_" + k) for k in terms]).where("owned")
    flagged = full.join(limits.hint("shuffle_hash"), ["slide", "band"])

    def edge(n):
        gx, gy = F.col("gx_" + n), F.col("gy_" + n)
        return (F.sqrt((gx * gx + gy * gy).cast("double")) / 2 > F.col("limit_" + n)).cast("int")

    flagged = flagged.select("*", *[edge(n).alias("e_" + n) for n in names])

    def side(label, a, b):
        index = _ssim_index(*[F.col("b_" + k) for k in (a, b, a + "_sq", b + "_sq", label)])
        return F.struct(
            F.lit(label).alias("comparison"),
            *[F.col(f"{a}_{c}").alias("s" + c) for c in "rgb"], *[F.col(f"{b}_{c}").alias("r" + c) for c in "rgb"],
            F.col("e_" + a).alias("s"), F.col("e_" + b).alias("t"), F.when(F.col("b_n") == 49, _fixed(index)).alias("index"))

    pairs = (flagged.select("slide", "x", "y", F.explode(F.array(
        *[side(label, a, b) for label, (a, b, _) in vocab.COMPARISONS.items()])).alias("c"))
        .select("slide", "x", "y", "c.*").where("sr IS NOT NULL AND rr IS NOT NULL"))
    a, b, c = _diffs()
    n = F.count(F.lit(1))
    main = pairs.groupBy("slide", "comparison").agg(
        (F.sum(_changed(threshold).cast("bigint")) / n).alias("pixel_difference_ratio"),
        (F.sum(a + b + c) / (n * 765)).alias("mean_absolute_error"),
        (F.max(F.greatest(a, b, c)) / F.lit(255)).alias("max_channel_error"),
        (F.sum("index") / F.nullif(F.count("index"), F.lit(0)) / F.lit(1e9)).alias("approx_ssim"),
        *_edge_aggs(), *_box(_changed(threshold), "diff_"))
    return main.join(surface_drift(surfaces), ["slide", "comparison"])


def box_rows(boxes: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per (box, scan line): ``y, x0, x1`` with both ends inside."""
    return boxes.select("slide", *keep, F.explode(F.sequence(F.col("y1"), F.col("y2"))).alias("y"),
                        F.col("x1").alias("x0"), F.col("x2").alias("x1"))


def mask_spans(boxes: DataFrame) -> DataFrame:
    """Union of boxes as disjoint spans per scan line."""
    return merge_spans(box_rows(boxes), ("slide",))


def merge_spans(spans: DataFrame, keys=("slide",)) -> DataFrame:
    """``keys, y, x0, x1``: overlapping and touching spans of a scan line become one.

    Equal spans are folded first, so copies of one box cost one row; a scan line
    holds at most width/2 disjoint spans.
    """
    w = W.partitionBy(*keys, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = spans.select(*keys, "y", "x0", "x1").distinct().withColumn("fresh", (F.coalesce(F.col("x0") > reach + 1, F.lit(True))).cast("int"))
    grouped = fresh.withColumn("run", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return grouped.groupBy(*keys, "y", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("run")


def in_mask(pixels: DataFrame, spans: DataFrame) -> DataFrame:
    """Pixels covered by disjoint spans (each pixel at most once)."""
    p, s = pixels.alias("p"), spans.alias("s")
    hit = (F.col("p.slide") == F.col("s.slide")) & (F.col("p.y") == F.col("s.y")) & F.col("p.x").between(F.col("s.x0"), F.col("s.x1"))
    return p.join(s, hit, "left_semi")


def text_density(surfaces: DataFrame, boxes: DataFrame, band: int = BAND) -> DataFrame:
    """Share of masked pixels that are dark or an edge, per surface."""
    flags = edge_flags(surfaces, band).join(
        surfaces.select("slide", "surface", "x", "y", luma().alias("l")), ["slide", "surface", "x", "y"])
    masked = in_mask(flags, mask_spans(boxes))
    active = ((F.col("l") < DARK_TEXT) | F.col("edge")).cast("bigint")
    per = masked.groupBy("slide", "surface").agg((F.sum(active) / F.count(F.lit(1))).alias("density"))
    same = W.partitionBy("slide")
    source = F.max(F.when(F.col("surface") == "source", F.col("density"))).over(same)
    return per.select("slide", "surface", "density", F.abs(F.col("density") - source).alias("difference_from_source"))


def otsu(values: DataFrame, value: str = "gray", keys=("slide",)) -> DataFrame:
    """Threshold that maximises between-class variance of a 0..255 histogram."""
    hist = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*keys)
    upto = w.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    v = F.col(value)
    cum = hist.select(*keys, v.alias("threshold"), F.sum("n").over(upto).alias("c"), F.sum(v * F.col("n")).over(upto).alias("s"),
                      F.sum("n").over(w).alias("n"), F.sum(v * F.col("n")).over(w).alias("t"))
    gap = (F.col("t") * F.col("c") - F.col("s") * F.col("n")).cast("double")
    rest = F.col("n") - F.col("c")
    score = F.when(rest > 0, gap * gap / (F.col("c") * rest).cast("double")).otherwise(F.lit(0.0))
    best = F.max(F.struct(score.alias("score"), (-F.col("threshold")).alias("neg")))
    return cum.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.neg")).cast("bigint").alias("threshold"))


def morphology(gray: DataFrame, band: int = BAND) -> DataFrame:
    """Blur 3x3, local range 3x3, binarise, close 9x3 (dilate then erode)."""
    rows = with_bands(gray, 4, band)
    along_x, along_y = _axes()
    three_x, three_y = along_x.rowsBetween(-1, 1), along_y.rowsBetween(-1, 1)
    nine_x = along_x.rowsBetween(-4, 4)

    def smooth(name, w):  # 1 2 1, mirrored at the border
        prev, nxt = F.lag(name).over(w), F.lead(name).over(w)
        return F.coalesce(prev, nxt, F.col(name)) + F.col(name) * 2 + F.coalesce(nxt, prev, F.col(name))

    keys = ["slide", "band", "owned", "x", "y"]
    df = rows.select(*keys, smooth("gray", along_x).alias("bx"))
    df = df.select(*keys, F.floor((smooth("bx", along_y) + 8) / 16).alias("blur"))
    df = df.select(*keys, "blur", F.max("blur").over(three_x).alias("hi"), F.min("blur").over(three_x).alias("lo"))
    df = df.select(*keys, "blur", (F.max("hi").over(three_y) - F.min("lo").over(three_y)).alias("local_range"))
    limit = otsu(df.where("owned"), "local_range")
    last = df.groupBy("slide").agg(F.max("band").alias("last"))
    limit = limit.join(last, "slide").select("slide", "threshold", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("band"))
    df = df.join(limit.hint("shuffle_hash"), ["slide", "band"]).withColumn("bw", (F.col("local_range") > F.col("threshold")).cast("bigint"))
    df = df.select(*keys, "blur", "local_range", "bw", F.max("bw").over(nine_x).alias("dx"))
    df = df.select(*keys, "blur", "local_range", "bw", F.max("dx").over(three_y).alias("dil"))
    df = df.select(*keys, "blur", "local_range", "bw", F.min("dil").over(nine_x).alias("ex"))
    df = df.select(*keys, "blur", "local_range", "bw", F.min("ex").over(three_y).alias("closed"))
    return df.where("owned").select("slide", "x", "y", "blur", "local_range", "bw", "closed")


def color_bands(pixels: DataFrame, predicate: Column, axis: str = "x", min_mass: int = 3) -> DataFrame:
    """Contiguous columns (or rows) whose count of matching pixels exceeds ``min_mass``."""
    mass = pixels.groupBy("slide", F.col(axis).alias("pos")).agg(F.sum(predicate.cast("bigint")).alias("mass")).where(F.col("mass") > min_mass)
    w = W.partitionBy("slide").orderBy("pos")
    runs = mass.withColumn("island", F.col("pos") - F.row_number().over(w))
    return runs.groupBy("slide", "island").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.sum("mass").alias("mass")).drop("island")


def foreground_runs(mask: DataFrame) -> DataFrame:
    """Horizontal runs of mask pixels; ``node`` is unique within a slide."""
    w = W.partitionBy("slide", "y").orderBy("x")
    runs = (mask.withColumn("island", F.col("x") - F.row_number().over(w))
            .groupBy("slide", "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")))
    return runs.select("slide", (F.col("y") * PLACE + F.col("x0")).alias("node"), "y", "x0", "x1")


def connected_components(mask: DataFrame) -> DataFrame:
    """8-connected components of mask pixels: label, bounding box and area.

    Works on runs, not pixels; touching runs of neighbouring lines are edges of stars
    (``functions.stars``), so a component that holds most runs is no hot key.
    """
    rounds = Rounds(mask.sparkSession)
    runs = rounds.save(foreground_runs(mask), lasting=True)
    a, b = runs.alias("a"), runs.alias("b")
    touch = ((F.col("a.slide") == F.col("b.slide")) & (F.col("a.y") + 1 == F.col("b.y"))
             & (F.col("a.x0") <= F.col("b.x1") + 1) & (F.col("b.x0") <= F.col("a.x1") + 1))
    edges = a.join(b, touch).select(F.col("a.slide").alias("slide"), F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    linked = components(edges, ["slide"])
    labels = runs.select("slide", "node").join(linked, ["slide", "node"], "left").select("slide", "node", F.coalesce("label", "node").alias("label"))
    return (runs.join(labels, ["slide", "node"]).groupBy("slide", "label").agg(
        F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("w"),
        (F.max("y") - F.min("y") + 1).alias("h"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
        .select("slide", F.expr(f"label div {PLACE}L").alias("top_y"), (F.col("label") % PLACE).alias("top_x"),
                "x", "y", "w", "h", "area"))
