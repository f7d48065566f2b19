"""Fragment rules and what padding reads besides the role."""

from rasterledger import vocab
from rasterledger.operators import regions, texts


def test_fragment_patterns(spark):
    bad = {"require(": "require ('x')", "module.exports": "module.exports = 1", "exports.": "exports.s1 = s1", "TARGET": "if (TARGET) {}", "makePptxSurface": "makePptxSurface()", "makeHtmlSurface": "makeHtmlSurface()", "pptx": "let a = PPTX", "html": "let a = Html"}
    files = spark.createDataFrame([*bad.items(), ("clean", "function s1(s) { s.text(1) } // html"), ("word", "TARGETS htmlx")], "file string, text string")
    got = {(r["file"], r["rule"]) for r in texts.scan_rules(files, vocab.FRAGMENT_PATTERNS, ()).collect()}
    assert got == {(k, k) for k in bad} | {("exports.", "exports.")}


def test_padding_reads_all_texts_and_effects(spark):
    rows = [(0, "body", None, None, None, None), (1, None, "Bold", None, None, None), (2, "body", None, "soft halo", None, None), (3, "body", None, None, "Glow behind", None), (4, "body", None, None, None, (True, None)), (5, "body", None, None, None, (False, True)), (6, "body", None, None, None, (False, False))]
    wide = "class string, h int, confidence double, padding_px int"
    df = spark.createDataFrame([(*r, "semantic_text", 20, 0.9, 0) for r in rows], f"k int, role string, style string, visual string, notes string, effects struct<shadow:boolean,glow:boolean>, {wide}")
    assert {r["k"]: r["pad"] for r in regions.region_padding(df).collect()} == {0: 5, 1: 7, 2: 10, 3: 10, 4: 10, 5: 10, 6: 5}
