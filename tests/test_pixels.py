"""Raster operators against plain numpy, and independence of the band height."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterledger.operators import pixels as px


def surfaces(spark, images):
    rows = [(s, name, x, y, *map(int, img[y, x])) for s, faces in images.items() for name, img in faces.items()
            for y in range(img.shape[0]) for x in range(img.shape[1])]
    return spark.createDataFrame(rows, "slide bigint, surface string, x bigint, y bigint, r bigint, g bigint, b bigint")


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(7)
    out = {}
    for s, (h, w) in enumerate([(11, 9), (7, 13), (5, 5), (1, 1)]):
        a = rng.integers(0, 256, (h, w, 3))
        out[s] = {"source": a, "pptx": np.clip(a + rng.integers(-60, 60, a.shape), 0, 255), "html": a.copy()}
    return out


@pytest.fixture(scope="module")
def table(spark, images):
    return surfaces(spark, images).cache()


def luma(img):
    return img[..., 0] * 299 + img[..., 1] * 587 + img[..., 2] * 114


def np_edges(img):
    g = luma(img).astype(float)
    gx, gy = np.zeros_like(g), np.zeros_like(g)
    gx[:, 1:-1] = g[:, 2:] - g[:, :-2]
    gy[1:-1] = g[2:] - g[:-2]
    mag = np.sqrt(gx * gx + gy * gy)
    return mag > max(np.percentile(mag, 85), px.EDGE_FLOOR)


def np_ssim(a, b):
    a, b = luma(a) / 255000, luma(b) / 255000
    if min(a.shape) < 7:
        return None
    vals = []
    for y in range(3, a.shape[0] - 3):
        for x in range(3, a.shape[1] - 3):
            p, q = a[y - 3:y + 4, x - 3:x + 4].ravel(), b[y - 3:y + 4, x - 3:x + 4].ravel()
            cov = np.cov(p, q, ddof=1)
            vals.append(((2 * p.mean() * q.mean() + 1e-4) * (2 * cov[0, 1] + 9e-4)) / ((p.mean() ** 2 + q.mean() ** 2 + 1e-4) * (cov[0, 0] + cov[1, 1] + 9e-4)))
    return float(np.mean(vals))


@pytest.mark.parametrize("band", [2, 3, 64])
def test_all_metrics(table, images, band):
    got = {(r.slide, r.comparison): r for r in px.compare_surfaces(table, band=band).collect()}
    assert len(got) == 3 * len(images)
    for s, f in images.items():
        a, b = f["source"], f["pptx"]
        r = got[s, "pptx_vs_source"]
        d = np.abs(a - b)
        assert r.pixel_difference_ratio == pytest.approx((d.mean(axis=2) / 255 > 0.08).mean())
        assert r.mean_absolute_error == pytest.approx(d.mean() / 255)
        assert r.max_channel_error == pytest.approx(d.max() / 255)
        ea, eb = np_edges(a), np_edges(b)
        assert r.edge_difference_ratio == pytest.approx((ea ^ eb).mean())
        assert r.source_edge_density == pytest.approx(ea.mean())
        want = np_ssim(a, b)
        assert (r.approx_ssim is None) if want is None else r.approx_ssim == pytest.approx(want, abs=1e-6)
        hist = [np.histogramdd(i.reshape(-1, 3) / 255, bins=8, range=((0, 1),) * 3)[0] / (i.size / 3) for i in (a, b)]
        assert r.color_palette_drift == pytest.approx(0.5 * np.abs(hist[0] - hist[1]).sum())
        same = got[s, "html_vs_source"]
        assert (same.pixel_difference_ratio, same.color_palette_drift, same.diff_w, same.edge_w) == (0, 0, 0, 0)


def test_missing_surface_gives_no_comparison(table):
    kept = px.compare_surfaces(table.where("NOT (slide = 1 AND surface = 'html')"))
    assert {r.comparison for r in kept.where("slide = 1").collect()} == {"pptx_vs_source"}


def test_row_order_does_not_matter(table):
    a = px.compare_surfaces(table).orderBy("slide", "comparison").collect()
    b = px.compare_surfaces(table.orderBy(F.rand(3))).orderBy("slide", "comparison").collect()
    assert a == b


def test_half_gradient_matches_numpy(table, images):
    got = {(r.surface, r.x, r.y): (r.gx2, r.gy2) for r in px.gradient(table.where("slide = 0"), "half", band=2).collect()}
    for name, img in images[0].items():
        gy, gx = np.gradient(luma(img).astype(float))
        for y in range(img.shape[0]):
            for x in range(img.shape[1]):
                assert got[name, x, y] == (round(gx[y, x] * 2), round(gy[y, x] * 2))


def test_morphology_is_band_free(table):
    gray = table.where("surface = 'source'").select("slide", "x", "y", F.floor(px.luma() / 1000).alias("gray"))
    order = ["slide", "y", "x"]
    assert px.morphology(gray, 2).orderBy(*order).collect() == px.morphology(gray, 64).orderBy(*order).collect()


def test_components_match_flood_fill(spark):
    rng = np.random.default_rng(1)
    grids = {s: rng.random((12, 15)) < p for s, p in enumerate((0.2, 0.4, 0.6))}
    spiral = np.zeros((13, 13), bool)  # one long thin component
    x, y, dx, dy = 0, 0, 1, 0
    spiral[0, 0] = True
    for n in (12, 12, 12, 10, 10, 8, 8, 6, 6, 4, 4, 2):
        for _ in range(n):
            x, y = x + dx, y + dy
            spiral[y, x] = True
        dx, dy = -dy, dx
    grids[3] = spiral
    mask = spark.createDataFrame([(s, int(x), int(y)) for s, g in grids.items() for y, x in zip(*np.nonzero(g))], "slide bigint, x bigint, y bigint")
    got = sorted((r.slide, r.x, r.y, r.w, r.h, r.area) for r in px.connected_components(mask).collect())
    want = []
    for s, g in grids.items():
        left = set(zip(*np.nonzero(g)))
        while left:
            todo, seen = [left.pop()], []
            while todo:
                y, x = todo.pop()
                seen.append((y, x))
                near = {(y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1)} & left
                left -= near
                todo += near
            ys, xs = zip(*seen)
            want.append((s, min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(seen)))
    assert got == sorted((s, *map(int, v)) for s, *v in want)


def test_mask_spans_cover_the_union(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 3, 2), (1, 2, 1, 6, 3), (1, 8, 1, 8, 1)] + [(1, 0, 0, 3, 2)] * 5, "slide bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    spans = px.mask_spans(boxes).collect()
    cells = [(r.y, x) for r in spans for x in range(r.x0, r.x1 + 1)]
    want = {(y, x) for x1, y1, x2, y2 in [(0, 0, 3, 2), (2, 1, 6, 3), (8, 1, 8, 1)] for y in range(y1, y2 + 1) for x in range(x1, x2 + 1)}
    assert len(cells) == len(set(cells)) and set(cells) == want
