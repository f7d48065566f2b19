"""Polygon masks against a plain point test with exact fractions."""

import random
from fractions import Fraction

from rasterledger.functions.ranking import crowding
from rasterledger.operators import polygons as pg
from rasterledger.operators import regions as rg

SIZE = 24
SHAPE = "slide bigint, id string, x bigint, y bigint, w bigint, h bigint, polygon array<struct<x:double,y:double>>"


def doubles(points):
    return points and [p and tuple(None if v is None else float(v) for v in p) for p in points]


def covered(points):
    """Pixels whose scan line meets the closed even-odd fill less than half a pixel from their centre."""
    pts = [(max(0, min(SIZE - 1, round(p[0] or 0))), max(0, min(SIZE - 1, round(p[1] or 0)))) for p in points if p is not None]
    edges = list(zip(pts, pts[1:] + pts[:1], strict=True))
    out = set()
    for y in range(SIZE):
        for x in range(SIZE):
            before, near = 0, False
            for (ax, ay), (bx, by) in edges:
                if ay == by:
                    near |= y == ay and min(ax, bx) <= x <= max(ax, bx)
                elif min(ay, by) <= y <= max(ay, by):
                    at = ax + Fraction((y - ay) * (bx - ax), by - ay)
                    near |= abs(at - x) < Fraction(1, 2)
                    before += y < max(ay, by) and at < x
            if near or before % 2:
                out.add((x, y))
    return out


def pixels(rows):
    return {(r["slide"], r["id"], x, r["y"]) for r in rows for x in range(r["x0"], r["x1"] + 1)}


CASES = {
    "concave": [(2, 2), (20, 4), (9, 9), (20, 18), (2, 19)],
    "bow_tie": [(1, 1), (15, 12), (15, 1), (1, 12)],
    "star": [(12, 0), (5, 21), (22, 8), (1, 8), (19, 21)],
    "clipped": [(-9, -4), (40, 7), (11, 60)],
    "outside": [(50, 50), (60, 50), (60, 60)],
    "flat": [(3, 5), (17, 5), (9, 5)],
    "upright": [(4, 3), (4, 15), (4, 9)],
    "halves": [(0.5, 1.5), (10.5, 2.5), (5.5, 12.5)],
    "point": [(7, 7), (7, 7), (7, 7)],
    "holes": [(2, 2), None, (14, 3), (None, 11)],
}


def test_shapes(spark):
    rnd = random.Random(3)
    cases = CASES | {f"r{i}": [(rnd.randrange(-4, 30), rnd.randrange(-4, 30)) for _ in range(rnd.randrange(3, 9))] for i in range(25)}
    df = spark.createDataFrame([(1, k, 0, 0, 1, 1, doubles(p)) for k, p in cases.items()], SHAPE)
    rows = pg.region_spans(df, SIZE, SIZE).collect()
    assert pixels(rows) == {(1, k, x, y) for k, p in cases.items() for x, y in covered(p)}
    per_line = {}
    for r in rows:  # spans of a line neither overlap nor touch
        per_line.setdefault((r["id"], r["y"]), []).append((r["x0"], r["x1"]))
    assert all(b[0] > a[1] + 1 for spans in per_line.values() for a, b in zip(sorted(spans), sorted(spans)[1:], strict=False))


def test_boxes_take_over(spark):
    two, three = doubles([(0, 0), (9, 9)]), doubles([(0, 0), (9, 0), (0, 9)])
    df = spark.createDataFrame([(1, "two", 2, 3, 4, 5, two), (1, "none", 2, 3, 4, 5, None), (1, "nulls", 2, 3, 4, 5, [None, (1.0, 1.0), None]), (1, "pad", 2, 3, 4, 5, three)], SHAPE)
    box = {(x, y) for x in range(2, 7) for y in range(3, 9)}
    got = pixels(pg.region_spans(df.where("id <> 'pad'"), SIZE, SIZE).collect())
    assert got == {(1, k, x, y) for k in ("two", "none", "nulls") for x, y in box}
    padded = pixels(pg.region_spans(df.where("id = 'pad'"), SIZE, SIZE, pad=2).collect())
    assert padded == {(1, "pad", x, y) for x in range(0, 9) for y in range(1, 11)}
    assert pg.region_spans(df.limit(0), SIZE, SIZE).count() == 0


def test_mask_of_pixels_follows_polygons(spark):
    rows = [(s, k, 1, 1, 2, 2, doubles(p)) for s in (1, 2) for k, p in CASES.items() if k != "outside"] * 2 + [(2, "box", 20, 20, 30, 30, None)]
    df = spark.createDataFrame(rows, SHAPE)
    grid = spark.range(SIZE * SIZE).selectExpr("explode(array(1L, 2L, 3L)) slide", f"id % {SIZE} x", f"id div {SIZE} y")
    got = {(r["slide"], r["x"], r["y"]) for r in rg.pixels_in_boxes(grid, df, "mask", SIZE, SIZE).collect()}
    want = {(s, x, y) for s, k, *_, p in rows if p for x, y in covered(p)} | {(2, x, y) for x in range(20, SIZE) for y in range(20, SIZE)}
    assert got == want


def test_union_is_dealt_by_lines(spark, monkeypatch):
    """Tasks hold about ``TASK_LINES`` scan lines each, and a slide that holds very many is spread; the mask stays the same."""
    rng = random.Random(5)
    shapes = [(s, f"r{i}", 0, 0, 2, 2, doubles([(rng.uniform(-2, SIZE + 2), rng.uniform(-2, SIZE + 2)) for _ in range(rng.randint(3, 6))]))
              for s in [1] * 12 + [2, 3, 4, 5, 6] for i in range(1)] + [(7, "box", 3, 4, 5, 6, None)]
    want = {(s, x, y) for s, *_, points in shapes if points for x, y in covered(points)} | {(7, x, y) for x in range(3, 9) for y in range(4, 11)}
    monkeypatch.setattr(pg, "TASK_LINES", 40)
    frame = spark.createDataFrame(shapes, SHAPE)
    assert pg.crowding(frame, ["slide"], 200, pg._lines(SIZE, SIZE))[0] is not None
    for least in (200, 10**6):
        monkeypatch.setattr(pg, "crowding", lambda df, keys, _, weight, least=least: crowding(df, keys, least, weight))
        spans = pg.union_spans(frame, SIZE, SIZE)
        assert {(r["slide"], x, r["y"]) for r in spans.collect() for x in range(r["x0"], r["x1"] + 1)} == want
    assert spans.rdd.getNumPartitions() > 5
