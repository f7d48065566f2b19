"""Box joins where most boxes lie in one cell."""

import random

import pytest

from rasterledger.functions import quadtree
from rasterledger.operators import regions as rg

SHAPE = "slide bigint, x bigint, y bigint, w bigint, h bigint"


def iou(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h) if w > 0 and h > 0 else 0.0


@pytest.fixture(scope="module")
def crowded():
    rnd = random.Random(9)
    rows = [(1, rnd.randrange(0, 60), rnd.randrange(0, 60), rnd.randrange(1, 12), rnd.randrange(1, 9)) for _ in range(400)]
    rows += [(1, rnd.randrange(0, 400), rnd.randrange(0, 300), rnd.randrange(5, 200), rnd.randrange(5, 150)) for _ in range(60)]
    rows += [(2, 3, 3, 9, 9)] * 5 + [(2, 4, 3, 9, 9), (3, 0, 0, 500, 400)]
    return rows


@pytest.mark.parametrize("crowd", [256, 40, 6])
def test_pairs(spark, crowded, crowd):
    got = {(r["slide"], *sorted([(r["ax"], r["ay"], r["aw"], r["ah"]), (r["bx"], r["by"], r["bw"], r["bh"])])): r["row_pairs"] for r in rg.iou_pairs(spark.createDataFrame(crowded, SHAPE), 0.5, crowd=crowd).collect()}
    want = {}
    for i, (s, *a) in enumerate(crowded):
        for t, *b in crowded[i + 1 :]:
            if s == t and iou(a, b) >= 0.5:
                key = (s, *sorted([tuple(a), tuple(b)]))
                want[key] = want.get(key, 0) + 1
    assert got == want


@pytest.mark.parametrize("crowd", [256, 10])
def test_clear_of_manual(spark, crowded, crowd):
    manual, rest = crowded[::7], crowded
    got = rg.clear_of_manual(spark.createDataFrame(manual, SHAPE), spark.createDataFrame(rest, SHAPE), crowd=crowd).collect()
    assert sorted(tuple(r) for r in got) == sorted(r for r in rest if not any(m[0] == r[0] and iou(m[1:], r[1:]) >= 0.45 for m in manual))


def test_no_leaf_is_crowded_above_the_least_size(spark, crowded):
    spread, full = quadtree.leaves(spark.createDataFrame(crowded, SHAPE).distinct(), least=4, crowd=20)
    sizes = spread.groupBy(*quadtree.LEAF).count().collect()
    assert {r["size"] for r in sizes} > {4, 128} and all(r["count"] <= 20 for r in sizes if r["size"] > 4)
    over = {(r["slide"], r["cx"], r["cy"]) for r in sizes if r["count"] > 20}
    assert over == ({(r["slide"], r["cx"], r["cy"]) for r in full.collect()} if full is not None else set())


def test_wide_lines(spark):
    pixels = spark.range(600).selectExpr("1L slide", "id x", "2L y")
    boxes = spark.createDataFrame([(1, "a", 5, 1, 590, 3), (1, "b", 63, 2, 2, 1)], "slide bigint, id string, x bigint, y bigint, w bigint, h bigint")
    rows = rg.region_pixels(pixels, boxes, 1, 1000, 10).collect()
    assert sorted((r["id"], r["x"]) for r in rows) == [("a", x) for x in range(4, 596)] + [("b", x) for x in range(62, 66)]
    assert {r["x"] for r in rows if r["id"] == "b" and r["inner"]} == {63, 64}


def test_slides_with_few_boxes_need_no_grid(spark, monkeypatch):
    """Only boxes of crowded slides are cut into cells; columns of the candidates stay as they are."""
    rng = random.Random(11)
    rows = [(s, rng.randrange(300), rng.randrange(300), rng.randrange(20, 200), rng.randrange(20, 200)) for s in [*range(30)] * 5 + [99] * 40]
    rows += rows[:9]
    grids, leaves = [], rg.leaves
    monkeypatch.setattr(rg, "leaves", lambda boxes, *args, **more: grids.append({r["slide"] for r in boxes.select("slide").distinct().collect()}) or leaves(boxes, *args, **more))
    frame = spark.createDataFrame(rows, SHAPE)
    want = {}
    for i, (s, *a) in enumerate(rows):
        for t, *b in rows[i + 1 :]:
            if s == t and iou(a, b) >= 0.3:
                key = (s, *sorted([tuple(a), tuple(b)]))
                want[key] = want.get(key, 0) + 1
    marked = frame.selectExpr("cast(slide as int) slide", "cast(x as int) x", "y", "w", "h", "'own' as manual", "1 as crowd")
    manual = rows[::6]
    clear = sorted(r for r in rows if not any(m[0] == r[0] and iou(m[1:], r[1:]) >= 0.45 for m in manual))
    for crowd, gridded in ((256, []), (20, [{99}, {99}])):
        got = rg.iou_pairs(frame, 0.3, crowd=crowd).collect()
        assert {(r["slide"], *sorted([(r["ax"], r["ay"], r["aw"], r["ah"]), (r["bx"], r["by"], r["bw"], r["bh"])])): r["row_pairs"] for r in got} == want
        kept = rg.clear_of_manual(spark.createDataFrame(manual, SHAPE), marked, crowd=crowd)
        assert kept.dtypes == marked.dtypes
        assert sorted(tuple(r)[:5] for r in kept.collect()) == clear
        assert grids == gridded
