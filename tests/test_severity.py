"""Literal metric rows and the class each must get."""

import pytest
from pyspark.sql import functions as F

from rasterledger.operators import severity

SCHEMA = ("slide bigint, comparison string, pixel_difference_ratio double, mean_absolute_error double, edge_difference_ratio double, "
          "approx_ssim double, color_palette_drift double, edge_density_delta double")
SLIDES = {
    1: [("pptx_vs_source", .2049, .0991, .1127, .6116, .1232), ("html_vs_source", .1888, .0925, .0944, .6363, .1346), ("pptx_vs_html", .1033, .0506, .0843, .8005, .0482)],
    5: [("pptx_vs_source", .2335, .1279, .1303, .4507, .1981), ("html_vs_source", .2167, .1265, .1314, .4635, .2236), ("pptx_vs_html", .1267, .0628, .0806, .7496, .0608)],
    12: [("pptx_vs_source", .2647, .1310, .1478, .3764, .3102), ("html_vs_source", .2444, .1295, .1499, .3980, .3417), ("pptx_vs_html", .1437, .0681, .0936, .7036, .0804)],
    2: [("pptx_vs_source", .2049, .0991, .1127, .6116, .1232), ("html_vs_source", .1888, .0925, .0944, .6363, .1346), ("pptx_vs_html", .1437, .0681, .0936, .7036, .0804)],
    3: [("pptx_vs_source", .0, .0, .0, None, .0)],
}


def metrics(spark, slides):
    return spark.createDataFrame([(s, *row, 0.02) for s in slides for row in SLIDES.get(s, [])], SCHEMA)


def signals(spark, rows=()):
    return spark.createDataFrame(list(rows), "slide bigint, type string, severity string")


def result(df):
    return {r.slide: r for r in df.collect()}


def test_calibrated_slides(spark):
    out = result(severity.slide_severity(metrics(spark, [1, 5, 12]), signals(spark)))
    assert (out[1].status, out[1].severity, out[1].tolerance_applied, out[1].confidence) == ("pass", "minor", True, 0.86)
    assert (out[5].status, out[5].severity, out[5].confidence) == ("needs_polish", "noticeable", 0.78)
    assert (out[12].status, out[12].severity, out[12].confidence) == ("fail", "blocking", 0.9)


def test_missing_artifact_fails_without_comparisons(spark):
    out = result(severity.slide_severity(metrics(spark, []), signals(spark, [(99, "missing_artifact", "blocking")])))
    assert (out[99].status, out[99].severity) == ("fail", "blocking")


def test_no_source_comparison_gives_high_confidence(spark):
    out = result(severity.slide_severity(metrics(spark, []), signals(spark, [(7, "note", "noticeable"), (8, "note", "odd")])))
    assert (out[7].severity, out[7].confidence) == ("noticeable", 0.86)
    assert (out[8].severity, out[8].status) == ("pass", "pass")


def test_clipping_makes_render_mismatch_block(spark):
    m = metrics(spark, [2])
    calm = {r.comparison: r.severity for r in severity.classify_comparison(m, signals(spark)).collect()}
    assert calm["pptx_vs_html"] == "noticeable"
    hot = signals(spark, [(2, "clipping", "blocking")])
    loud = {r.comparison: r for r in severity.classify_comparison(m, hot).collect()}
    assert loud["pptx_vs_html"].severity == "blocking" and loud["pptx_vs_html"].classification == "known_bad_like"
    assert result(severity.slide_severity(m, hot))[2].status == "fail"


def test_missing_similarity_is_never_good(spark):
    row = severity.classify_comparison(metrics(spark, [3])).collect()[0]
    assert (row.within_good, row.within_borderline, row.classification, row.severity) == (False, False, "out_of_band", "noticeable")


@pytest.mark.parametrize("values,tags,want", [
    ((.248, .113, .155, .44, .231), ["stop_flow"], ("missing_detail_density", False)),
    ((.229, .112, .146, .456, .274), ["schematic", "technical_diagram"], ("technical_diagram_under_detailed", True)),
    ((.216, .113, .139, .479, .389), ["board"], ("board_texture_missing", True)),
    ((.229, .118, .144, .431, .264), [], ("edge_density_low", False)),
    ((.1, .05, .05, .7, .25), [], ("palette_drift", False)),
])
def test_fix_plan(spark, values, tags, want):
    rows = spark.createDataFrame([(1, "pptx_vs_source", *values, 0.0)], SCHEMA).withColumns(
        {"severity": F.lit("noticeable"), "classification": F.lit("borderline_like")})
    flags = spark.createDataFrame([(1, *[n in tags for n in ("board", "stop_flow", "technical_diagram", "schematic")])],
                                  "slide bigint, board boolean, stop_flow boolean, technical_diagram boolean, schematic boolean")
    plan = severity.fix_plan(rows, flags)
    got = plan.collect()[0]
    assert (got.type, got.crop_allowed) == want
    crops = spark.createDataFrame([(1, t) for t in ("3d", "texture", "Text ", "table", "label")], "slide bigint, content_type string")
    allowed = {r.content_type.strip().lower() for r in severity.crop_policy_check(plan, crops).where("allowed").collect()}
    assert allowed == ({"3d", "texture"} if want[1] else set())


def test_domain_tags(spark):
    texts = spark.createDataFrame([
        (1, ["Pump and HPU", "valve", "manifold heating"]), (2, ["Line-up Board"]), (3, ["x"] * 8 + ["line-up board"]),
        (4, ["trigger", "flow drain sample point"]), (5, ["pump valve esd hpu independent verification"])], "slide bigint, values array<string>")
    out = {r.slide: r for r in severity.domain_tags(texts).collect()}
    assert out[1].technical_diagram and out[2].board and not out[3].board
    assert out[4].stop_flow and out[4].schematic and not out[5].technical_diagram
