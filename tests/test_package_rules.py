"""XML parts against the parser of the standard library; structure rules by literal cases."""

import random
import xml.etree.ElementTree as ET

from rasterledger.operators import evidence as ev
from rasterledger.operators import package_rules as pr

SOUND = [
    "<a/>", "<a></a>", '<?xml version="1.0"?><a>x</a>', "\ufeff<a/>", " \n<a/>\n", "<a><b/><b>t</b></a>", "<a x='1' y=\"2>3\"/>", "<a>&amp;&#65;&#x41;</a>",
    "<a><!-- <b> & --></a>", "<a><![CDATA[<b>&]]></a>", '<p:a xmlns:p="u"><p:b q="1"/></p:a>', '<a><b xmlns:r="u" r:id="1"/></a>', '<a xml:space="preserve"/>', "<!DOCTYPE a><a/>", "<é>ü</é>", "<a  x = '1' ></a >",
]
FAULTY = {
    "<p><a></p>": ("mismatched_tag", 6), "<a>": ("unclosed_tag", 3), "<a><b></b>": ("unclosed_tag", 10), "</a>": ("stray_end_tag", 0), "<a/></a>": ("stray_end_tag", 4), "<a><b></a></b>": ("mismatched_tag", 6),
    "<a/><b/>": ("second_root", 4), "<a/>x": ("text_outside_root", 4), "x<a/>": ("text_outside_root", 0), "<a>&</a>": ("invalid_token", 3), "<a>& b</a>": ("invalid_token", 3), "<a>1 < 2</a>": ("invalid_token", 5),
    "<a x=1/>": ("invalid_token", 0), "<a x='<'/>": ("invalid_token", 0), "<a x='1' x='2'/>": ("duplicate_attribute", 0), "<p:a/>": ("unbound_prefix", 0), "<a r:id='1'/>": ("unbound_prefix", 0),
    '<a><b xmlns:r="u"/><c r:x="1"/></a>': ("unbound_prefix", 19), "  ": ("no_element", 2), "<!-- a -->": ("no_element", 10), "<a": ("invalid_token", 0), "<a><!-- </a>": ("invalid_token", 3), "🙂": ("text_outside_root", 0), "<a>🙂</b>": ("mismatched_tag", 4),
}


def _errors(spark, contents, kind="string"):
    df = spark.createDataFrame([(i, f"p{i}", t) for i, t in enumerate(contents)], f"pkg int, part string, content {kind}")
    out = {}
    for r in pr.xml_errors(df).collect():
        out.setdefault(r["pkg"], []).append((r["rule"], r["offset"]))
    return out


def test_literal_faults(spark):
    assert _errors(spark, SOUND) == {}
    assert _errors(spark, FAULTY) == {i: [fault] for i, fault in enumerate(FAULTY.values())}


def test_bytes(spark):
    got = _errors(spark, [b"<a>\xc3</a>", b"<a>ok\xff\xfe</a>", b"", None, b"<a>\x01\x02</a>", "<é>\x1f</é>".encode(), b"<a/>"], "binary")
    assert got[0] == [("not_utf8", 3)] and got[1] == [("not_utf8", 5)] and got[2] == got[3] == [("empty", 0)]
    assert got[4] == [("control_character", 3)] and got[5] == [("control_character", 3)] and 6 not in got


def test_agrees_with_a_parser(spark):
    rnd = random.Random(11)
    bits = ["<a>", "</a>", "<b>", "</b>", "<a/>", "<b x='1'/>", "<b x='1' x='2'>", "text", "&amp;", "&", "<", "<!-- - -->", "<![CDATA[<]]>", "<p:a xmlns:p='u'>", "</p:a>", "<c p:y='1'/>", " ", "<?pi x?>"]
    texts = ["<a>" + "".join(rnd.choices(bits, k=rnd.randrange(0, 7))) + rnd.choice(["</a>", "", "</a>"]) for _ in range(700)]
    got = _errors(spark, texts)
    wrong = 0
    for i, t in enumerate(texts):
        try:
            ET.fromstring(t)
            sound = True
        except ET.ParseError:
            sound = False
        wrong += sound
        assert (i in got) != sound, t
    assert 30 < wrong < 650


def test_group_extents_are_not_sizes(spark):
    text = '<p:x><p:grpSpPr><a:xfrm><a:ext cx="0" cy="1.5"/></a:xfrm></p:grpSpPr><p:grpSpPr/><a:ext cx=\'-1\' cy="x"/><a:other cx="0" cy="no"/></p:x>'
    rows = ev.check_numeric_attrs(spark.createDataFrame([(1, "s", text)], "slide int, part string, text string")).collect()
    assert sorted((r["attr"], r["raw"], r["rule"]) for r in rows) == [("cx", "-1", "negative_size"), ("cx", "-1", "size_not_positive"), ("cy", "x", "not_a_whole_number")]


def test_tokens(spark):
    text = "<a>Infinity and beyond, nano, NaN undefined NaN</a><b x='null' name='null' sz = \"1 Null\"/>"
    rows = pr.numeric_tokens(spark.createDataFrame([(1, "s", text), (2, "s", None)], "pkg int, part string, content string")).collect()
    assert sorted((r["rule"], r["detail"], r["n"]) for r in rows) == [("invalid_token", "infinity", 1), ("invalid_token", "nan", 2), ("invalid_token", "undefined", 1), ("null_in_number", "null", 2)]


def test_structure(spark):
    parts = [("full", p, 5) for p in (*pr.vocab.REQUIRED_PARTS, "ppt/slides/slide1.xml", "ppt/media/a.PNG", "ppt/media/")]
    parts += [("bad", "ppt/presentation.xml", 0), ("bad", "ppt/slides/slide2.xml", 0), ("bad", "ppt/media/x.svg", 0), ("bad", "docs/x.xml", 0), ("bad", "docs/x.xml", 0), ("bad", "docs/x.bin", 0), ("bad", "ppt/slides/", 0), ("bad", "_rels/.rels", None)]
    df = spark.createDataFrame(parts, "pkg string, part string, bytes long")
    defaults = spark.createDataFrame([("full", "XML"), ("full", "rels"), ("full", "png"), ("bad", "xml")], "pkg string, ext string")
    rows = sorted((r["rule"], r["detail"]) for r in pr.package_structure(df, defaults).collect() if r["pkg"] == "bad")
    assert pr.package_structure(df, defaults).where("pkg = 'full'").count() == 0
    assert rows == [("duplicate_entry", "docs/x.xml"), ("missing_default", "rels"), ("missing_media_default", "svg"), ("missing_required_part", "[Content_Types].xml"), ("missing_required_part", "ppt/_rels/presentation.xml.rels"),
                    ("zero_byte_media", "ppt/media/x.svg"), ("zero_byte_required_part", "ppt/presentation.xml"), ("zero_byte_slide", "ppt/slides/slide2.xml"), ("zero_byte_xml", "docs/x.xml")]


def test_odd_numbers(spark):
    """Blanks and signs as a cast takes them, words, numbers beyond BIGINT, quotes of both kinds."""
    texts = ["<a:off\tx\n=\t\"+7\" y=' -3000000000 '/>", '<a:ext cx="" cy=" 12 "/>', '<a:ext cx="99999999999999999999" cy="1e3"/>', "<a w='\"null\"' h='-\t5'/>", '<a:ext cy="-4"/>\x01', None]
    rows = ev.check_numeric_attrs(spark.createDataFrame(list(enumerate(texts)), "slide int, text string").selectExpr("slide", "'s' part", "text")).collect()
    assert sorted((r["slide"], r["attr"], r["raw"], r["rule"]) for r in rows) == [
        (0, "y", " -3000000000 ", "extremely_large"), (1, "cx", "", "not_a_whole_number"), (2, "cx", "9" * 20, "not_a_whole_number"), (2, "cy", "1e3", "not_a_whole_number"), (3, "w", '"null"', "null_in_number"),
        (4, "", "", "control_character"), (4, "cy", "-4", "negative_size"), (4, "cy", "-4", "size_not_positive")]


def test_matches_are_taken_apart_once(spark):
    """Rules read columns: no plan step holds the text functions of an attribute more than once, and no cast sees a text that it refuses."""
    plan = ev.check_numeric_attrs(spark.createDataFrame([(1, "s", "x")], "slide int, part string, text string"))._jdf.queryExecution().optimizedPlan().toString()
    steps = plan.split("\n")
    assert max(s.count("try_cast(") for s in steps) == 1
    assert all("RLIKE" in s for s in steps if "try_cast(" in s)
