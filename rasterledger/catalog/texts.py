"""Queries over texts, JSON documents and parameter strings."""

from pyspark.sql import functions as F

from .. import vocab
from ..operators import texts as tx
from .registry import query

c = F.col


def range_text(t):
    k, n = c("o_custkey") % 20 + 1, c("o_orderkey")
    huge = F.when(n % 29 == 0, ",1000000000-1000000002").when(n % 31 == 0, ",99999999999999999999").otherwise("")
    parts = F.concat(k.cast("string"), F.lit("-"), (k + n % 6 - F.when(n % 11 == 0, 9).otherwise(0)).cast("string"), F.lit(" , "), (n % 9 + 1).cast("string"),
                     F.lit(",,"), F.when(n % 13 == 0, "x2").otherwise((n % 4 + 2).cast("string")), huge)
    return t.orders.select(n.alias("id"), parts.alias("text"))


RANGE_CTE = """b AS (SELECT o_orderkey AS id, o_custkey % 20 + 1 AS a, o_custkey % 20 + 1 + o_orderkey % 6 - CASE WHEN o_orderkey % 11 = 0 THEN 9 ELSE 0 END AS z, o_orderkey % 9 + 1 AS s, o_orderkey % 4 + 2 AS u, o_orderkey % 13 = 0 AS bad,
  o_orderkey % 29 = 0 AS huge, o_orderkey % 29 <> 0 AND o_orderkey % 31 = 0 AS beyond FROM orders),
g AS (SELECT *, NOT bad AND NOT beyond AND z >= a AND z > 0 AS ok FROM b),
x AS (SELECT id, unnest(range(a, z+1)) AS slide, 0 AS tok FROM g WHERE ok UNION ALL SELECT id, s, 1 FROM g WHERE ok UNION ALL SELECT id, u, 2 FROM g WHERE ok
  UNION ALL SELECT id, unnest([1000000000, 1000000001, 1000000002]), 3 FROM g WHERE ok AND huge),
f AS (SELECT id, slide, min(tok*10000000000 + slide) AS first FROM x GROUP BY ALL)"""


@query("parse_slide_ranges", f"""WITH {RANGE_CTE}
SELECT id, 'sorted' AS mode, row_number() OVER (PARTITION BY id ORDER BY slide) - 1 AS place, slide, false AS error, NULL AS reason FROM f
UNION ALL SELECT id, 'seen', row_number() OVER (PARTITION BY id ORDER BY first) - 1, slide, false, NULL FROM f
UNION ALL SELECT id, m, NULL, NULL, true, CASE WHEN beyond AND NOT bad AND z >= 0 THEN 'number too large' ELSE 'malformed' END FROM g, (VALUES ('sorted'), ('seen')) v(m) WHERE NOT ok""")
def _(t):
    src = range_text(t)
    return (tx.parse_ranges(src, "text").withColumn("mode", F.lit("sorted"))
            .unionByName(tx.parse_ranges(src, "text", keep_order=True).withColumn("mode", F.lit("seen"))))


def palette_profiles(t):
    p = t.fx_profiles
    i = c("id")
    none = F.lit(None).cast("string")
    return p.select(
        "id", (i % 2 == 0).alias("dark"), F.when(i % 4 == 0, "zz").otherwise(F.concat(F.lit("#"), "hex_a")).alias("bg"), c("hex_b").alias("panelBorder"),
        F.when(i % 5 == 0, none).otherwise(c("hex_a")).alias("ink"), none.alias("gold"), F.when(i % 3 == 0, c("hex_b")).alias("orange"), c("hex_a").alias("warnColor"),
        F.lit("nope").alias("info"), none.alias("teal"), c("hex_b").alias("blue"), none.alias("danger"), none.alias("dangerColor"), none.alias("badgeColor"), c("hex_a").alias("navy"),
        F.when(i % 7 == 0, c("hex_a")).alias("inkMuted"), F.when(i % 2 == 1, c("hex_b")).alias("ok"), F.when(i % 3 == 1, c("hex_a")).alias("stepNumberColor"),
        F.when(i % 5 == 2, c("hex_b")).alias("warnBadge"), F.when(i % 4 == 1, c("hex_b")).alias("eyebrowColor"),
        F.when(i % 3 == 0, F.concat(F.lit("rgba("), (i % 256).cast("string"), F.lit(", "), (i * 7 % 256).cast("string"), F.lit(", 30, 0."), (i % 10).cast("string"), F.lit(")")))
        .when(i % 3 == 1, F.concat(F.lit("#"), "hex_b")).alias("panelFill"))


def _ch(h, k):
    return f"('0x' || substr({h}, {k}, 2))::INT"


def _mix(a, b, tt):
    return "(" + " || ".join(f"printf('%02X', least(255, greatest(0, floor({_ch(a, k)} + ({_ch(b, k)} - {_ch(a, k)})*{tt}::DOUBLE + 0.5)))::INT)" for k in (1, 3, 5)) + ")"


D = vocab.PALETTE


@query("resolve_palette", f"""
WITH p AS (SELECT id, id % 2 = 0 AS dark, CASE WHEN id % 4 = 0 THEN '{D['bg']}' ELSE upper(hex_a) END AS bg, upper(hex_b) AS line, CASE WHEN id % 5 = 0 THEN '{D['white']}' ELSE upper(hex_a) END AS white,
   CASE WHEN id % 3 = 0 THEN upper(hex_b) ELSE upper(hex_a) END AS gold, upper(hex_b) AS cyan, '{D['red']}' AS red, upper(hex_a) AS badge, upper(hex_b) AS hb,
   CASE WHEN id % 7 = 0 THEN upper(hex_a) ELSE '{D['sub']}' END AS sub, CASE WHEN id % 2 = 1 THEN upper(hex_b) ELSE '{D['green']}' END AS green, CASE WHEN id % 3 = 0 THEN upper(hex_b) ELSE '{D['orange']}' END AS orange,
   upper(hex_b) AS steel, CASE WHEN id % 5 = 2 THEN upper(hex_b) ELSE '{D['badgeRed']}' END AS "badgeRed", CASE WHEN id % 3 = 1 THEN upper(hex_a) ELSE '{D['chevOn']}' END AS "chevOn", CASE WHEN id % 4 = 1 THEN upper(hex_b) END AS eb FROM fx_profiles),
q AS (SELECT *, printf('%02X%02XXX', (id % 256)::INT, (id*7 % 256)::INT) AS f0, (id % 10)::DOUBLE/10 AS al FROM p),
r AS (SELECT *, CASE WHEN id % 3 = 0 THEN substr(f0, 1, 4) || '1E' END AS css FROM q),
s AS (SELECT id, dark, bg, line, white, gold, cyan, red, badge, sub, green, orange, steel, "badgeRed", "chevOn", eb, CASE id % 3 WHEN 0 THEN {_mix('bg', 'css', 'al')} WHEN 1 THEN hb ELSE '{D['panel']}' END AS panel FROM r)
SELECT id, bg, line, white, gold, cyan, red, badge, sub, green, orange, steel, "badgeRed", "chevOn", line AS "chevLine",
  CASE WHEN dark THEN {_mix('cyan', "'000000'", 0.55)} ELSE {_mix('cyan', "'FFFFFF'", 0.85)} END AS "leadFill", CASE WHEN dark THEN {_mix('gold', "'000000'", 0.70)} ELSE {_mix('gold', "'FFFFFF'", 0.82)} END AS "chevGoldFill",
  CASE WHEN dark THEN {_mix('red', "'000000'", 0.74)} ELSE {_mix('red', "'FFFFFF'", 0.86)} END AS "chevDangerFill", CASE WHEN dark THEN {_mix('white', 'cyan', 0.15)} ELSE white END AS "chevTextOn",
  panel, CASE WHEN dark THEN {_mix('panel', "'FFFFFF'", 0.06)} ELSE {_mix('panel', "'000000'", 0.04)} END AS panelHi, {_mix('line', "'FFFFFF'", 0.12)} AS lineHi,
  {_mix('gold', "'000000'", 0.14)} AS goldDim, CASE WHEN dark THEN {_mix('bg', 'panel', 0.55)} ELSE {_mix('bg', 'line', 0.10)} END AS chevOff, coalesce(eb, {_mix('white', 'cyan', 0.35)}) AS eyebrow,
  CASE WHEN dark THEN {_mix('badge', "'000000'", 0.55)} ELSE {_mix('badge', "'FFFFFF'", 0.85)} END AS tagFill, CASE WHEN dark THEN {_mix('gold', "'000000'", 0.78)} ELSE {_mix('gold', "'FFFFFF'", 0.86)} END AS bannerFill,
  CASE WHEN dark THEN {_mix('bg', 'line', 0.5)} ELSE line END AS rline FROM s""", "fx_profiles")
def _(t):
    return tx.resolve_palette(palette_profiles(t))


def _q(s):
    return s.replace("'", "''")


_RULES = "\nUNION ALL ".join([f"SELECT file, '{_q(n)}' AS rule FROM s WHERE regexp_matches(t, '{_q(p)}')" for n, p in vocab.FORBIDDEN_PATTERNS]
                             + [f"SELECT file, 'token {_q(k)}' FROM s WHERE contains(lower(t), '{_q(k.lower())}')" for k in vocab.BACKEND_TOKENS])


@query("rule_token_scan", rf"""WITH f AS (SELECT 'page' || page_id AS file, html AS text FROM pages UNION ALL SELECT 'doc' || doc_id, text FROM documents),
s AS (SELECT file, regexp_replace(regexp_replace(text, '/\*[\s\S]*?\*/', '', 'g'), '(?m)(^|[^:])//.*$', '\1', 'g') AS t FROM f)
{_RULES}""")
def _(t):
    files = t.pages.select(F.concat(F.lit("page"), c("page_id").cast("string")).alias("file"), c("html").alias("text")).unionByName(
        t.documents.select(F.concat(F.lit("doc"), c("doc_id").cast("string")).alias("file"), "text"))
    return tx.scan_rules(files)


FIX_TEXT = ["Weaken the gate until it passes", "Rebuild rules without weakening the gate", "Use a Full-Slide crop", "Save through PowerPoint", "Add native rules", "do not weaken; direct PPTX edit"]


def fix_texts(t):
    pick = F.get(F.array(*map(F.lit, FIX_TEXT)), (c("event_id") % 6).cast("int"))
    return t.fx_issues.withColumn("id", F.concat(F.lit("i"), c("event_id").cast("string"))).withColumn("recommended_fix", pick).withColumn(
        "target_file", F.when(c("crop_allowed"), "work/gate.js").otherwise("work/slide.js"))


FIX_CTE = "ft AS (SELECT slide, 'i' || event_id AS id, severity, fix_strategy, event_id, lower([" + ", ".join(f"'{x}'" for x in FIX_TEXT) + "][event_id % 6 + 1] || ' ' || CASE WHEN crop_allowed THEN 'work/gate.js' ELSE 'work/slide.js' END) AS t FROM fx_issues)"
LINT_CTE = """fl AS (SELECT slide, id, 'weakens_gate' AS rule FROM ft WHERE contains(t, 'weaken') AND contains(t, 'gate') AND NOT (contains(t, 'without weakening') OR contains(t, 'not weaken'))
UNION ALL SELECT slide, id, 'full_slide_crop' FROM ft WHERE contains(t, 'full-slide crop') OR contains(t, 'full slide crop') UNION ALL SELECT slide, id, 'direct_edit' FROM ft WHERE contains(t, 'save through powerpoint') OR contains(t, 'direct pptx'))"""


@query("fix_text_lint", f"WITH {FIX_CTE}, {LINT_CTE} SELECT * FROM fl", "fx_issues")
def _(t):
    return tx.lint_fix_text(fix_texts(t))


@query("canonical_hash", "SELECT p_partkey, sha256('{\"p_brand\":\"' || p_brand || '\",\"p_name\":\"' || p_name || '\",\"p_size\":' || p_size || ',\"p_type\":\"' || p_type || '\"}') AS fingerprint FROM part")
def _(t):
    return tx.canonical_hash(t.part, ["p_type", "p_name", "p_size", "p_brand"]).select("p_partkey", "fingerprint")


def text_docs(t):
    k, n, r = c("conv_id").cast("string"), c("turn").cast("string"), c("role")
    body = F.expr("substring(to_json(array(coalesce(text, ''))), 2, length(to_json(array(coalesce(text, '')))) - 2)")
    doc = F.concat(F.lit('{"title":"conv '), k, F.lit('","text":'), body, F.lit(',"size":3,"regions":[{"text":"'), r, F.lit('","evidence":{"ocrText":"t'), n, F.lit('","score":1}},{"Label":"'), r,
                   F.lit('"}],"meta":{"a":{"b":{"content":["deep '), k, F.lit('","more"]}}},"other":"no"}'))
    return t.conversations.select((c("conv_id") * 1000 + c("turn")).alias("slide"), doc.alias("doc"))


@query("collect_text_values", """WITH d AS (SELECT conv_id*1000 + turn AS slide, conv_id AS k, turn AS n, role AS r, coalesce(text, '') AS t FROM conversations)
SELECT slide, 0::BIGINT AS place, 'title' AS key, 'conv ' || k AS value FROM d UNION ALL SELECT slide, 1, 'text', t FROM d UNION ALL SELECT slide, 2, 'text', r FROM d UNION ALL SELECT slide, 3, 'ocrText', 't' || n FROM d
UNION ALL SELECT slide, 4, 'Label', r FROM d UNION ALL SELECT slide, 5, 'content', 'deep ' || k FROM d UNION ALL SELECT slide, 6, 'content', 'more' FROM d""")
def _(t):
    return tx.collect_texts(text_docs(t))


def traces(t):
    n = c("o_orderkey")
    a, b = (n % 7 + 1).cast("string"), (n % 7 + 3).cast("string")
    doc = (F.when(n % 6 == 0, F.concat(F.lit('{"selectedSlides":"'), a, F.lit("-"), b, F.lit(',9"}')))
           .when(n % 6 == 1, F.concat(F.lit('{"build":{"slides":['), a, F.lit(","), b, F.lit("]}}")))
           .when(n % 6 == 2, F.concat(F.lit('{"slides":[{"sourceSlide":'), a, F.lit('},{"id":"'), b, F.lit('"},{"x":1}]}')))
           .when(n % 6 == 3, F.concat(F.lit('{"x":{"requested_slides":['), b, F.lit("]}}")))
           .when(n % 6 == 4, F.concat(F.lit('{"slides":"x","render":{"slides":'), a, F.lit("}}")))
           .otherwise(F.lit('{"none":1}')))
    return t.orders.select(n.alias("id"), doc.alias("trace"))


@query("trace_slides", """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 7 + 1 AS a, o_orderkey % 7 + 3 AS b, o_orderkey % 6 AS m FROM orders),
r AS (SELECT id, s - a AS place, s AS slide FROM (SELECT id, a, unnest(range(a, b+1)) AS s FROM o WHERE m = 0) q
  UNION ALL SELECT id, 3, 9 FROM o WHERE m = 0 AND NOT (9 BETWEEN a AND b) UNION ALL SELECT id, 0, a FROM o WHERE m IN (1, 2, 4) UNION ALL SELECT id, 1, b FROM o WHERE m IN (1, 2) UNION ALL SELECT id, 0, b FROM o WHERE m = 3)
SELECT * FROM r""")
def _(t):
    return tx.trace_slides(traces(t))


def crops_with_exceptions(t):
    e1 = F.struct(F.when(c("supp_no") % 2 == 0, c("content_type")).otherwise(F.lit("none")).alias("scope"), F.lit("owner asked").alias("reason"))
    e2 = F.struct(F.when(c("part_no") % 3 == 0, F.upper("name")).otherwise(F.lit("Image-led")).alias("scope"), F.lit(None).cast("string").alias("reason"))
    return t.fx_crops.withColumn("exceptions", F.array(e1, e2))


EXC = """ex AS (SELECT *, (allow_large_crop OR coalesce(trim(reason), '') <> '') AND (supp_no % 2 = 0 OR part_no % 3 = 0 OR contains('{"scope":"none","reason":"owner asked"}', content_type)) AS excused FROM fx_crops)"""


@query("exception_lookup", f"WITH {EXC} SELECT name, part_no, supp_no, excused FROM ex", "fx_crops")
def _(t):
    return tx.textual_crop_excused(crops_with_exceptions(t)).select("name", "part_no", "supp_no", "excused")


@query("canonical_document_hash", r"""WITH d AS (SELECT doc_id, coalesce(CAST(to_json(text) AS VARCHAR), 'null') AS t, coalesce(CAST(to_json(lang) AS VARCHAR), 'null') AS l, (doc_id % 4096 - 2048) / 16.0::DOUBLE AS v FROM documents)
SELECT doc_id, sha256('{"B":[' || doc_id || ',{"a":' || t || ',"z":[' || l || ',true,{}]},null],"a":{"deep":{"n":' || regexp_replace(CAST(v AS VARCHAR), '\.0$', '') || ',"é":1e+21}}}') AS fingerprint FROM d""")
def _(t):
    """Each document as nested JSON; every second one with its keys the other way round and its numbers written otherwise."""
    string = lambda name: F.coalesce(F.expr(f"substring(to_json(array({name})), 2, length(to_json(array({name}))) - 2)"), F.lit("null"))
    text, lang, key = string("text"), string("lang"), c("doc_id").cast("string")
    v = (c("doc_id") % 4096 - 2048) / F.lit(16.0)
    one = F.concat(F.lit('{"a":{"deep":{"n":'), F.format_string("%.6f", v), F.lit(',"é":1e21}},"B":['), key, F.lit(',{"z":['), lang, F.lit(',true,{}],"a":'), text, F.lit("},null]}"))
    two = F.concat(F.lit('{ "B" : ['), key, F.lit('.0, {"a":'), text, F.lit(', "z":['), lang, F.lit(', true, { }]}, null],\n "a":{"deep":{"\\u00e9":1000000000000000000000,"n":'), F.format_string("%.9e", v), F.lit("}}}"))
    docs = t.documents.select("doc_id", F.when(c("doc_id") % 2 == 0, one).otherwise(two).alias("doc"))
    return tx.document_hash(docs, "doc").drop("doc")
