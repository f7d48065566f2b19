"""Literal cases: nulls do not pass gates, nothing is dropped without a row, halves round as stated."""

import pytest

from rasterledger.operators import evidence, gates, regions, rollup, severity, texts
from rasterledger.sources import documents


def rules(df):
    return sorted(r["rule"] for r in df.collect())


def test_ranges_of_any_length(spark):
    df = spark.createDataFrame([(1, "1000000000-1000000001"), (2, "7,3-5,4"), (3, "99999999999999999999"), (4, "5-3"), (5, None), (6, "1-9000,8999-9001")], "id bigint, text string")
    got = {}
    for r in texts.parse_ranges(df, "text", keep_order=True).collect():
        got.setdefault(r["id"], []).append((r["place"], r["slide"], r["reason"]))
    assert sorted(got[1]) == [(0, 1000000000, None), (1, 1000000001, None)]
    assert [s for _, s, _ in sorted(got[2])] == [7, 3, 4, 5]
    assert (got[3], got[4], got[5]) == ([(None, None, "number too large")], [(None, None, "malformed")], [(None, None, "missing")])
    assert [s for _, s, _ in sorted(got[6])] == list(range(1, 9002))
    rising = texts.parse_ranges(df.where("id = 2"), "text").collect()
    assert [r["slide"] for r in sorted(rising, key=lambda r: r["place"])] == [3, 4, 5, 7]


def test_gates_fail_closed(spark):
    visual = spark.createDataFrame([(1, None, None, None, None, None, None, None, None)], "slide bigint, status string, severity string, blocking bigint, noticeable bigint, critical boolean, pair_mismatch boolean, resize_applied boolean, resize_reason string")
    assert rules(gates.gate_visual_mode(visual, "qa-strict")) == ["not_clean"] and rules(gates.gate_visual_mode(visual, "qa-polish")) == ["blocking_left"]
    receipts = spark.createDataFrame([(1, None, None, None, None, None)], "slide bigint, receipt_slide bigint, worker string, status string, shared_files_edited boolean, artifacts array<string>")
    assert "wrong_slide" in rules(gates.gate_receipts(receipts))
    captures = spark.createDataFrame([(1, 10, 5, 1, True, False, None, 5, "a", "a", "b", "b")], "slide bigint, actual_width int, actual_height int, scale int, qa_static boolean, modified_html boolean, viewport_width int, viewport_height int, html_sha string, current_html_sha string, output_sha string, current_output_sha string")
    assert rules(gates.gate_captures(captures, 10, 5)) == ["viewport_differs"]
    results = spark.createDataFrame([(1, "pass", "pass", "pass", "pass", [], [], [], False, False, None, "seen", "", "e.json")], "slide bigint, status string, visual_fidelity string, native_editability string, crop_policy string, blocking_issues array<string>, noticeable_issues array<string>, minor_issues array<string>, has_raster boolean, has_html boolean, method string, method_notes string, report string, evidence string")
    assert rules(gates.gate_qa_result(results)) == ["no_image_needs_manual_notes"]


@pytest.mark.parametrize(("fails", "found"), [(None, ["summary_missing"]), (2, ["state_has_fail_slides"]), (0, [])])
def test_deck_without_summary(spark, fails, found):
    states = spark.createDataFrame([(1, "0.1.0", "/deck", "strict", "a", "b", "c", "d", fails)], "deck bigint, schema_version string, project_root string, quality_level string, pptx string, html string, summary_file string, trace_file string, fail_slides bigint")
    none = spark.createDataFrame([], "deck bigint, slide bigint, status string, severity string, blocking bigint")
    assert rules(gates.gate_orchestration(states, none)) == found


def test_clean_slides_have_a_status(spark):
    hits = spark.createDataFrame([("g", 1, "error")], "gate string, slide bigint, level string")
    slides = spark.createDataFrame([(1,), (2,)], "slide bigint")
    assert sorted((r["slide"], r["errors"], r["status"]) for r in gates.gate_status(hits, slides, "g").collect()) == [(1, 1, "fail"), (2, 0, "pass")]


def test_unreadable_plan_keeps_a_row(spark):
    plans = spark.createDataFrame([(1, "{broken", 3), (2, None, 3), (3, "{}", 3), (4, '{"a":[1,2,3,4,5,"L"]}', None)], "id bigint, doc string, fallback_slide bigint")
    got = {r["id"]: r["error"] for r in documents.normalize_crop_plan(plans).collect()}
    assert got == {1: "unreadable plan", 2: "unreadable plan", 4: None}


def test_small_answers(spark):
    slides = spark.createDataFrame([(1, "minor", 9), (2, None, 1), (3, "odd", 2), (4, "noticeable", 1)], "slide bigint, severity string, issue_count bigint")
    assert [r["slide"] for r in rollup.worst_slides(slides).collect()] == [3, 2, 4, 1]
    assert [r["slide"] for r in rollup.worst_slides(slides, unknown_rank=0).collect()] == [4, 1, 3, 2]
    boxes = spark.createDataFrame([(1, "ocr", 0, 0, 9, 9, 0.3125)], "slide bigint, detector string, x bigint, y bigint, w bigint, h bigint, confidence double")
    assert regions.score_candidates(boxes).first()["confidence"] == 0.312
    objects = spark.createDataFrame([(1, None, -0.0625, 0.0625, -0.0001, 1.0, None, "x", "a/photo.png"), (1, None, 0.0, 0.0, 0.0, 1.0, None, "x", "a\\icons\\b.svg")], "slide bigint, type string, x double, y double, w double, h double, editable boolean, txt string, file string")
    first, second = evidence.normalize_objects(objects).collect()
    assert (first["type"], first["editable"], first["x"], first["y"], str(first["w"])) == ("image", False, -0.063, 0.063, "0.0")
    assert (second["type"], second["editable"]) == ("icon", True)
    rows = spark.createDataFrame([(1, "a", "", 5, 5), (1, "b", None, 0, 0), (1, "c", "r001", 9, 9)], "slide bigint, region_key string, id string, x bigint, y bigint")
    assert {r["region_key"]: r["id"] for r in regions.assign_ids(rows, "region_key").collect()} == {"a": "r003", "b": "r002", "c": "r001"}
    metrics = spark.createDataFrame([(1, "pptx_vs_source", None, 0.1, 0.1, 0.1, 0.1)], "slide bigint, comparison string, pixel_difference_ratio double, mean_absolute_error double, edge_difference_ratio double, approx_ssim double, color_palette_drift double")
    assert severity.band_facts(metrics).count() == 0


def test_region_without_class_stays(spark):
    found = spark.createDataFrame([(1, "a", None, None, None, None), (1, "b", "unknown_text", None, None, None)], "slide bigint, id string, class string, exception_approved boolean, exception_reason string, inpaint_allowed boolean")
    backgrounds = spark.createDataFrame([], "slide bigint, id string, background_type string")
    assert [(r["id"], r["background_type"]) for r in regions.join_background(found, backgrounds).collect()] == [("a", "complex_unknown")]


def test_size_does_not_change_the_overlap_test():
    kept = regions.Kept()
    for i in range(60):
        kept.add((1000 + i * 20, 0, 10, 10))
    assert kept.overlap((0, 0, 10, 10), 0.0) == -1 and kept.overlap((1025, 5, 10, 10), 0.0) == 1
