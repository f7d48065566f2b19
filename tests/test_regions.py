"""Order-dependent region operators against plain loops, with copies and hot slides."""

import random

import pytest
from pyspark.sql import functions as F

from rasterledger.operators import regions as rg
from rasterledger.plans import text_layer


def iou(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


@pytest.fixture(scope="module")
def boxes():
    rnd = random.Random(5)
    rows = []
    for slide, n in ((1, 150), (2, 12), (3, 1)):
        for i in range(n):
            rows.append((slide, rnd.choice(["cv", "ocr"]), rnd.randrange(0, 300), rnd.randrange(0, 200), rnd.randrange(5, 60), rnd.randrange(5, 40), rnd.randrange(20, 90) / 100, f"t{i}"))
    rows += [(1, "cv", 50, 50, 40, 30, 0.5, "same")] * 40 + [(1, "ocr", 55, 52, 40, 30, 0.6, "")] * 7
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "slide bigint, detector string, x bigint, y bigint, w bigint, h bigint, confidence double, text string")


def one_pass(regions, threshold):
    merged = []
    for r in regions:
        hit = next((k for k in merged if iou(k["box"], r["box"]) >= threshold), None)
        if hit is None:
            merged.append(dict(r))
            continue
        (kx, ky, kw, kh), (x, y, w, h) = hit["box"], r["box"]
        nx, ny = min(kx, x), min(ky, y)
        hit["box"] = (nx, ny, max(kx + kw, x + w) - nx, max(ky + kh, y + h) - ny)
        hit["conf"] = max(hit["conf"], r["conf"])
        hit["cv"] += r["cv"]
        hit["ocr"] += r["ocr"]
        hit["text"] = r["text"] or hit["text"]
    return sorted(merged, key=lambda k: (k["box"][1], k["box"][0]))


def greedy(rows, threshold):
    """Detector boxes are merged, then that list and the OCR boxes are merged again."""
    out = []
    for slide in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == slide), key=lambda r: (r[3], r[2], r[5], r[4], r[6], r[7]))
        made = {d: [{"box": tuple(r[2:6]), "conf": r[6], "cv": int(d == "cv"), "ocr": int(d == "ocr"), "text": r[7]} for r in mine if r[1] == d] for d in ("cv", "ocr")}
        out += [(slide, *k["box"], k["conf"], k["cv"], k["ocr"], k["text"]) for k in one_pass(one_pass(made["cv"], threshold) + made["ocr"], threshold)]
    return sorted(out)


def test_merge_matches_loop(spark, boxes):
    got = sorted(tuple(r) for r in rg.merge_overlaps(frame(spark, boxes)).collect())
    assert got == greedy(boxes, 0.35)


def test_suppress_matches_loop(spark, boxes):
    manual = [r for r in boxes if r[1] == "ocr"][:30]
    cands = [r for r in boxes if r[1] == "cv"]
    got = sorted((r.slide, r.x, r.y, r.w, r.h, r.origin, r.copies) for r in rg.suppress(frame(spark, manual), frame(spark, cands)).collect())
    want = []
    for slide in {r[0] for r in boxes}:
        kept = [r[2:6] for r in manual if r[0] == slide]
        for b in kept:
            want.append((slide, *b, "manual"))
        for r in sorted((r for r in cands if r[0] == slide), key=lambda r: (r[3], r[2], r[5], r[4], r[6])):
            if not any(iou(r[2:6], k) >= 0.45 for k in kept):
                kept.append(r[2:6])
                want.append((slide, *r[2:6], "candidate"))
    flat = sorted(row[:6] for row in got for _ in range(row[6]))
    assert flat == sorted(want)


@pytest.mark.parametrize("cell", [16, 128])
def test_iou_pairs_match_loop(spark, boxes, cell):
    got = {(r.slide, (r.ax, r.ay, r.aw, r.ah), (r.bx, r.by, r.bw, r.bh)): r.row_pairs for r in rg.iou_pairs(frame(spark, boxes), 0.3, cell).collect()}
    want = {}
    for i, a in enumerate(boxes):
        for b in boxes[i + 1:]:
            if a[0] == b[0] and iou(a[2:6], b[2:6]) >= 0.3:
                p, q = sorted([a[2:6], b[2:6]], key=lambda r: (r[1], r[0], r[3], r[2]))
                want[a[0], p, q] = want.get((a[0], p, q), 0) + 1
    assert got == want


def test_islands_never_touch(spark, boxes):
    rows = rg.islands(frame(spark, boxes)).collect()
    for a in rows:
        for b in rows:
            if a.slide == b.slide and (a.iy, a.ix) != (b.iy, b.ix):
                assert iou((a.x, a.y, a.w, a.h), (b.x, b.y, b.w, b.h)) == 0


def test_assign_ids_fills_gaps(spark):
    rows = spark.createDataFrame([(1, "r002", 0, 0, "a"), (1, None, 5, 5, "b"), (1, None, 1, 1, "c"), (1, "note", 2, 2, "d"), (1, None, 9, 9, "e"), (2, None, 1, 1, "f")],
                                 "slide bigint, id string, x bigint, y bigint, k string")
    assert {r.k: r.id for r in rg.assign_ids(rows, "k").collect()} == {"a": "r002", "c": "r001", "b": "r003", "e": "r004", "d": "note", "f": "r001"}


def test_detection_plan_gives_unique_ids(spark, boxes):
    man = spark.createDataFrame([(1, "r001", 10, 10, 50, 20, 1.0), (2, None, 0, 0, 9, 9, 1.0)], "slide bigint, id string, x bigint, y bigint, w bigint, h bigint, confidence double")
    out = text_layer.detect_regions(man, frame(spark, boxes)).collect()
    assert len({(r.slide, r.id) for r in out}) == len(out) and all(r.id for r in out)


def test_clamp_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(0.5, 1.5, 2.5, 5000.0), (-4.0, 2000.0, 0.2, 3.0), (None, 1.0, 1.0, 1.0)], "x double, y double, w double, h double")
    got = [tuple(r) for r in rg.clamp_boxes(rows).collect()]
    assert got == [(0, 2, 2, 939), (0, 940, 1, 1)]


def test_islands_of_few_and_crowded_slides(spark, monkeypatch):
    """Boxes of a slide with few of them move once; both ways of cutting give the same islands, and walks the same boxes."""
    rng = random.Random(5)
    rows = [(s, rng.randrange(0, 900, 7), rng.randrange(0, 600, 5), rng.randint(0, 60), rng.randint(0, 40), rng.choice(["cv", "ocr"]), rng.randint(1, 9) / 10, "t")
            for s, n in ((1, 400), (2, 3), (3, 60), (4, 1)) for _ in range(n)]
    boxes = spark.createDataFrame(rows, "slide bigint, x bigint, y bigint, w bigint, h bigint, detector string, confidence double, text string")
    shape = ["slide", "x", "y", "w", "h"]

    def cut(df):
        held = {}
        for r in df.collect():
            held.setdefault((r["slide"], r["iy"], r["ix"]), set()).add(tuple(r[c] for c in shape))
        return sorted(sorted(g) for g in held.values())

    distinct = boxes.select(*shape).distinct()
    assert cut(rg._own_islands(distinct)) == cut(rg._edge_islands(distinct))
    placed = rg._in_order(boxes, [], ["y", "x"])
    assert placed._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    found = [sorted(map(tuple, rg.merge_overlaps(boxes).collect()))]
    monkeypatch.setattr(rg, "crowding", lambda df, keys: (F.col("slide").isin(1, 4), 600_000))
    found.append(sorted(map(tuple, rg.merge_overlaps(boxes).collect())))
    monkeypatch.setattr(rg, "FEW_KEPT", 0)
    found.append(sorted(map(tuple, rg.merge_overlaps(boxes).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) > 100
