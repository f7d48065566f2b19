"""Readers, text parsing and the incremental job on small files."""

import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterledger.catalog import stateful
from rasterledger.fixtures import Tables
from rasterledger.operators import evidence as ev
from rasterledger.operators import texts as tx
from rasterledger.sources import documents, images, packages, sinks
from rasterledger.streaming import refresh


def test_read_evidence_flags_bad_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"slide": 1, "status": "pass"}, indent=2))
    (tmp_path / "b.json").write_text("{ broken")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in documents.read_evidence(spark, str(tmp_path), "slide BIGINT, status STRING").collect()}
    assert rows["a.json"].readable and rows["a.json"].slide == 1
    assert not rows["b.json"].readable and rows["b.json"].slide is None


def test_crop_plan_shapes_and_errors(spark):
    crop = {"name": "a", "slide": 3, "x": 1.5, "y": "2", "w": 10, "h": 20, "contentType": "photoreal", "editable_replacement": "", "reason": "ok"}
    bare = {k: v for k, v in crop.items() if k not in ("name", "slide")}
    docs = {1: [crop], 2: {"crops": [crop]}, 3: {"crops": {"a": dict(bare, slide=3)}}, 4: {"slides": {"Slide3": {"a": bare}, "4": [dict(crop, name="b", slide=4)]}},
            5: {"a": [3, 1, 2, 10, 20, "lb"]}, 6: {"a": dict(bare, slide=3, edges="Q")}, 7: {"a": bare}, 8: [dict(crop, x="wide")]}
    df = spark.createDataFrame([(k, json.dumps(v), None) for k, v in docs.items()], "plan bigint, doc string, fallback_slide bigint")
    rows = {(r.plan, r.name): r for r in documents.normalize_crop_plan(df).collect()}
    for plan in (1, 2, 3, 4):
        r = rows[plan, "a"]
        assert (r.slide, r.x, r.y, r.w, r.h, r.content_type, r.reason, r.error) == (3, 2, 2, 10, 20, "photoreal", "ok", None)
        assert r.missing_metadata == ["reconstruction_reason", "editable_replacement"] and not r.metadata_complete
    assert rows[4, "b"].slide == 4
    assert (rows[5, "a"].feather_edges, rows[5, "a"].content_type, len(rows[5, "a"].missing_metadata)) == ("LB", "dense_infographic", 3)
    assert rows[6, "a"].error == "invalid feather_edges" and rows[7, "a"].error == "slide missing" and rows[8, "a"].error == "invalid numeric field"


def png_with_filter(img, mode):
    h, w, _ = img.shape
    flat, lines = img.reshape(h, w * 3).astype(int), b""
    for y in range(h):
        up = flat[y - 1] if y else np.zeros(w * 3, int)
        out = []
        for i, v in enumerate(flat[y]):
            left = flat[y][i - 3] if i >= 3 else 0
            corner = up[i - 3] if i >= 3 else 0
            p = left + up[i] - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner))[2]
            out.append((v - [0, left, up[i], (left + up[i]) // 2, paeth][mode]) % 256)
        lines += bytes([mode]) + bytes(out)
    def chunk(n, d):
        return struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return images.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_png_files_to_pixels(spark, tmp_path):
    img = np.random.default_rng(2).integers(0, 256, (5, 4, 3))
    for mode in range(5):
        (tmp_path / f"slide{mode}.png").write_bytes(png_with_filter(img, mode))
    files = images.read_files(spark, str(tmp_path))
    head = images.scan_headers(files).collect()
    assert {(r.width, r.height, r.error) for r in head} == {(4, 5, None)}
    px = images.ingest_rasters(files, ["path"]).collect()
    assert len(px) == 100 and all((r.r, r.g, r.b) == tuple(img[r.y, r.x]) for r in px)


def test_broken_files_do_not_end_the_job(spark):
    img = np.random.default_rng(3).integers(0, 256, (40, 70, 3))
    good = png_with_filter(img, 4)
    laced = bytearray(good)
    laced[28] = 1
    files = spark.createDataFrame([(1, good), (2, b"\xff\xd8\xff\xe0"), (3, bytes(laced)), (4, None), (5, good[:60])], "slide bigint, content binary")
    rows = images.ingest_rasters(files, ["slide"]).collect()
    px = {(r.x, r.y): (r.r, r.g, r.b) for r in rows if r.slide == 1}
    assert len(px) == 2800 and all(px[x, y] == tuple(img[y, x]) for x, y in px)
    assert sorted(r.slide for r in rows if r.error) == [2, 3, 4, 5] and len(rows) == 2804


def test_depths_of_png():
    def png(depth, kind, w, h, lines, palette=b""):
        def chunk(n, d):
            return struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
        body = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"")
        return images.PNG_SIGNATURE + body + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert images.decode_png(png(1, 0, 10, 1, b"\0\xa0\x40"))[0, :, 0].tolist() == [255, 0, 255, 0, 0, 0, 0, 0, 0, 255]
    assert images.decode_png(png(16, 2, 1, 1, b"\0\x12\x34\x56\x78\x9a\xbc")).tolist() == [[[0x12, 0x56, 0x9A]]]
    assert images.decode_png(png(4, 3, 3, 1, b"\0\x10\x20", bytes(range(9)))).tolist() == [[[3, 4, 5], [0, 1, 2], [6, 7, 8]]]


def test_image_reader(spark, tmp_path):
    img = np.random.default_rng(4).integers(0, 256, (5, 4, 3))
    (tmp_path / "a.png").write_bytes(png_with_filter(img, 4))
    (tmp_path / "b.png").write_bytes(b"no image")
    jvm = spark._jvm
    flat = jvm.java.awt.image.BufferedImage(8, 8, 1)
    for k in range(64):
        flat.setRGB(k % 8, k // 8, 0x3060C0)
    jvm.javax.imageio.ImageIO.write(flat, "jpg", jvm.java.io.File(str(tmp_path / "c.jpg")))
    rows = images.read_images(spark, str(tmp_path)).collect()
    got = {n: [r for r in rows if r.path.endswith(n)] for n in ("a.png", "b.png", "c.jpg")}
    assert len(got["a.png"]) == 20 and all((r.r, r.g, r.b) == tuple(img[r.y, r.x]) for r in got["a.png"])
    assert [r.error for r in got["b.png"]] == ["unreadable"]
    assert len(got["c.jpg"]) == 64 and all(abs(r.r - 0x30) < 6 and abs(r.g - 0x60) < 6 and abs(r.b - 0xC0) < 6 for r in got["c.jpg"])


def test_resample_keeps_flat_colour(spark):
    px = spark.createDataFrame([(1, x, y, 10, 200, 30) for x in range(6) for y in range(4)], "slide bigint, x bigint, y bigint, r bigint, g bigint, b bigint")
    sizes = spark.createDataFrame([(1, 6, 4, 3, 9)], "slide bigint, w0 bigint, h0 bigint, w1 bigint, h1 bigint")
    rows = images.resample(px, sizes).collect()
    assert len(rows) == 27 and {(r.r, r.g, r.b, r.resized) for r in rows} == {(10, 200, 30, True)}


def test_packages(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a/b.XML", "<x/>")
        z.writestr("c.bin", b"\xff\xfe")
    df = spark.createDataFrame([("p", held.getvalue()), ("q", b"nothing")], "pkg string, content binary")
    rows = {(r.pkg, r.part): r for r in packages.scan_packages(df).collect()}
    assert (rows["p", "a/b.XML"].ext, rows["p", "a/b.XML"].text, rows["p", "a/b.XML"].crc_ok) == ("xml", "<x/>", True)
    assert rows["p", "c.bin"].text is None and rows["q", None].error == "not a zip package"


@pytest.mark.parametrize("text,want", [("8,10-12,8", [8, 10, 11, 12]), ("3,1-2", [3, 1, 2]), ("2-1", None), ("0", None), ("1,x", None), ("-3", None), (" 4 , ,5", [4, 5])])
def test_range_text(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(tx.range_ids(F.col("t"))).collect()[0][0] == want


def test_slide_map_modes(spark):
    def df(rows, cols):
        return spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in cols.split()))
    src = [8, 10, 11, 12, 13]
    requested = [(d, i + 1, s) for d in (1, 2) for i, s in enumerate(src)] + [(3, 1, 8), (3, 2, 10), (4, 1, 13), (4, 2, 99)]
    paired = [(2, i + 1, i + 1) for i in range(5)] + [(3, 1, 1)]
    mapped = [(4, 8, 1, 1), (4, 10, 2, 2), (4, 13, 5, 5)]
    out = ev.resolve_slide_map(df(requested, "deck ord source"), df(paired, "deck ord physical"), df(mapped, "deck source physical html"),
                               df([(5, i + 1, s) for i, s in enumerate(src)], "deck ord source"), df([(6, s) for s in src], "deck slide")).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.deck, r.source_slide)):
        got.setdefault(r.deck, []).append((r.source_slide, r.physical_slide, r.mapping_mode, r.error))
    assert [g[1] for g in got[1]] == [1, 2, 3, 4, 5] and got[1][0][2] == "source-slides-sequential"
    assert got[2][4] == (13, 5, "source-physical-slides", None)
    assert {g[3] for g in got[3]} == {"list lengths differ"}
    assert got[4] == [(13, 5, "slide-map", None), (99, None, "slide-map", "not in slide map")]
    assert got[5][4][:3] == (13, 5, "trace") and got[6][4][:3] == (13, 13, "legacy-physical-slides")


@pytest.mark.parametrize("doc,want", [
    ({"SLIDES": "8,10"}, [8, 10]), ({"selectedSlides": [], "slides": "x", "pipeline": {"slides": [2.0, "3"]}}, [2, 3]),
    ({"deep": [{"requested_slides": [{"id": 4}, {"slide": 0}, {"slideId": 6}]}]}, [4, 6]), ({"a": 1}, [])])
def test_trace(spark, doc, want):
    rows = tx.trace_slides(spark.createDataFrame([(1, json.dumps(doc))], "id bigint, trace string")).orderBy("place").collect()
    assert [r.slide for r in rows] == want


@pytest.mark.parametrize("path,want", [("a/./b/../c", "a/c"), ("../x", "../x"), ("/../x", "x"), ("a/../..", ".."), ("", ""), ("a\\b", "a/b")])
def test_fold_path(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(ev.fold_path(F.col("p"))).collect()[0][0] == want


def test_incremental_refresh_only_adds_new(spark, tmp_path):
    schema = "key string, sha256 string, fingerprint string"
    feed, state, progress = (str(tmp_path / n) for n in ("feed", "state", "progress"))
    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        refresh.incremental_refresh(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed), state, progress)
        return sorted((r.batch_id, r.key, r.sha256) for r in refresh.read_state(spark, state).collect())
    assert run([("a", "1", "f"), ("a", "1", "f"), ("b", "1", "f")]) == [(0, "a", "1"), (0, "b", "1")]
    assert run([("a", "1", "f"), ("b", "2", "f")]) == [(0, "a", "1"), (0, "b", "1"), (1, "b", "2")]


def test_sink_round_trip(spark, tmp_path):
    out = str(tmp_path / "o")
    sinks.write_evidence(spark.createDataFrame([(1, "pass"), (2, "fail")], "slide bigint, status string"), out, "json", ["status"])
    assert spark.read.json(out).count() == 2


def test_refresh_tasks_and_feed_files_grow_with_the_events(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(refresh, "TASK_ROWS", 50)
    monkeypatch.setattr(stateful, "FILE_ROWS", 250)
    tables = Tables(spark, "/root/testdata/sf0.001")
    base = str(tmp_path)
    entries = {tuple(r) for r in tables.events.selectExpr("user_id", "sha2(props, 256)", "CASE event_type WHEN 'error' THEN 'v2' ELSE 'v1' END").collect()}
    refresh.incremental_refresh(stateful._feed(tables, base).select(*refresh.KEYS), base + "/state", base + "/progress")
    rows = refresh.read_state(spark, base + "/state")
    assert sorted(tuple(r) for r in rows.select(*refresh.KEYS).collect()) == sorted(entries)
    assert {r["batch_id"] for r in rows.select("batch_id").distinct().collect()} <= {0, 1, 2, 3}
    assert len(list((tmp_path / "feed").glob("*.parquet"))) == 4 * (1 + tables.events.count() // 250) > 4
    assert max(len(list(part.glob("*.parquet"))) for part in (tmp_path / "state" / "batch_id=0").glob("part=*")) > 1


def test_crop_fields_that_do_not_fit(spark):
    """A field of another kind is null and leaves the others as they are."""
    docs = ['[{"name":"a","slide":"2","x":"7.5","y":true,"w":[1],"h":4,"reason":{"k":1},"contentType":"","allowLargeCrop":"yes"}]',
            '{"crops":{"b":[3,"4",null,6,7.5,"lt"],"c":5,"d":[null,1]}}']
    rows = {r["name"]: r for r in documents.normalize_crop_plan(spark.createDataFrame([(d, 9) for d in docs], "doc string, fallback_slide int")).collect()}
    a, b = rows["a"], rows["b"]
    assert (a["slide"], a["x"], a["w"], a["h"], a["reason"], a["content_type"], a["allow_large_crop"]) == (2, 8, None, 4, '{"k":1}', "dense_infographic", True)
    assert (b["slide"], b["x"], b["y"], b["w"], b["h"], b["feather_edges"]) == (3, 4, None, 6, 8, "LT")
    assert rows["c"]["error"] and rows["d"]["error"]
