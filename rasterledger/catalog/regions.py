"""Queries over text regions and their pixels."""

from pyspark.sql import functions as F

from .. import vocab
from ..operators import polygons as pg
from ..operators import regions as rg
from ..operators.pixels import luma
from ..plans import text_layer
from .pixels import rounded
from .registry import query, sql_case

W, H = vocab.CANVAS_W, vocab.CANVAS_H
c = F.col


@query("clamp_boxes", f"""
WITH b AS (SELECT slide, region_key, x + 0.5 AS fx, y - 30 + 0.5*h AS fy, w * 1.5 AS fw, h + 0.5 AS fh FROM fx_regions),
q AS (SELECT slide, region_key, round_even(fx::DOUBLE, 0)::BIGINT AS rx, round_even(fy::DOUBLE, 0)::BIGINT AS ry, round_even(fw::DOUBLE, 0)::BIGINT AS rw, round_even(fh::DOUBLE, 0)::BIGINT AS rh FROM b),
o AS (SELECT *, greatest(0, least(rx, {W-1})) AS x, greatest(0, least(ry, {H-1})) AS y, greatest(0, least(rx-3, {W-1})) AS x1, greatest(0, least(ry-3, {H-1})) AS y1 FROM q)
SELECT slide, region_key, x, y, greatest(1, least(rw, {W}-x)) AS w, greatest(1, least(rh, {H}-y)) AS h, x1, y1,
  greatest(x1+1, least(rx-3+rw+6, {W})) AS x2, greatest(y1+1, least(ry-3+rh+6, {H})) AS y2 FROM o""", "fx_regions")
def _(t):
    b = t.fx_regions.select("slide", "region_key", (c("x") + 0.5).alias("x"), (c("y") - 30 + c("h") * 0.5).alias("y"),
                            (c("w") * 1.5).alias("w"), (c("h") + 0.5).alias("h"))
    return rg.clamp_boxes(b, pad=3)


@query("candidate_filter_score", f"""
SELECT slide, cand_key, detector, round_even(1000 * CASE detector WHEN 'ocr' THEN least(greatest(confidence*100/100.0::DOUBLE, 0), 1)
  ELSE least(greatest(0.2::DOUBLE + least(w::DOUBLE/h, 12.0)/20 + least(w*h, 5000)::DOUBLE/20000, 0.18::DOUBLE), 0.72::DOUBLE) END, 0) / 1000 AS confidence
FROM fx_candidates WHERE detector = 'ocr' OR NOT (w*h < 24 OR w < 4 OR h < 4 OR (w > {W}*0.98::DOUBLE AND h > {H}*0.2::DOUBLE))""", "fx_candidates")
def _(t):
    return rg.score_candidates(t.fx_candidates).select("slide", "cand_key", "detector", "confidence")


IOU = "(ix*iy)::DOUBLE / (a.w*a.h + b.w*b.h - ix*iy)"


@query("iou_pairs", """
WITH d AS (SELECT slide, x, y, w, h, count(*) AS n FROM fx_candidates GROUP BY ALL),
p AS (SELECT a.slide, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS "by", b.w AS bw, b.h AS bh, a.n*b.n AS row_pairs,
   greatest(0, least(a.x+a.w, b.x+b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y+a.h, b.y+b.h) - greatest(a.y, b.y)) AS i
  FROM d a JOIN d b ON a.slide = b.slide AND (a.y, a.x, a.h, a.w) < (b.y, b.x, b.h, b.w))
SELECT slide, ax, ay, aw, ah, bx, "by", bw, bh, row_pairs, round(i::DOUBLE/(aw*ah + bw*bh - i), 6) AS iou FROM p WHERE i > 0 AND i::DOUBLE/(aw*ah + bw*bh - i) >= 0.1::DOUBLE
UNION ALL SELECT slide, x, y, w, h, x, y, w, h, n*(n-1)//2, 1.0 FROM d WHERE n > 1""", "fx_candidates")
def _(t):
    return rounded(rg.iou_pairs(t.fx_candidates, 0.1), "iou")


def _share(k, b):
    """Overlap share of two boxes as SQL; 0 without a real overlap."""
    iw = f"(least({k}.x+{k}.w, {b}.x+{b}.w) - greatest({k}.x, {b}.x))"
    ih = f"(least({k}.y+{k}.h, {b}.y+{b}.h) - greatest({k}.y, {b}.y))"
    return f"(CASE WHEN {iw} > 0 AND {ih} > 0 THEN ({iw}*{ih})::DOUBLE / ({k}.w*{k}.h + {b}.w*{b}.h - {iw}*{ih}) ELSE 0 END)"


def _merge_walk(name, source):
    """One pass over the rows of ``source`` in the order ``rn``; the kept boxes are a list."""
    box = "'x': v.x, 'y': v.y, 'w': v.w, 'h': v.h, 'c': v.c, 'cv': v.cv, 'ocr': v.ocr, 't': v.t"
    k = "v.kept[i]"
    wide = f"""{{'x': least({k}.x, v.x), 'y': least({k}.y, v.y), 'w': greatest({k}.x+{k}.w, v.x+v.w) - least({k}.x, v.x), 'h': greatest({k}.y+{k}.h, v.y+v.h) - least({k}.y, v.y),
      'c': greatest({k}.c, v.c), 'cv': {k}.cv + v.cv, 'ocr': {k}.ocr + v.ocr, 't': CASE WHEN v.t <> '' THEN v.t ELSE {k}.t END}}"""
    return f"""{name} AS (
  SELECT slide, 0::BIGINT AS k, [{{'x': x, 'y': y, 'w': w, 'h': h, 'c': c, 'cv': cv, 'ocr': ocr, 't': t}}][2:] AS kept FROM {source} WHERE rn = 1
  UNION ALL SELECT v.slide, v.k, CASE WHEN v.hit IS NULL THEN list_append(v.kept, {{{box}}}) ELSE [CASE WHEN i = v.hit THEN {wide} ELSE {k} END FOR i IN range(1, len(v.kept) + 1)] END
  FROM (SELECT u.slide, u.k + 1 AS k, u.kept, s.x, s.y, s.w, s.h, s.c, s.cv, s.ocr, s.t, list_min([i FOR i IN range(1, len(u.kept) + 1) IF {_share('u.kept[i]', 's')} >= 0.35::DOUBLE]) AS hit
        FROM {name} u JOIN {source} s ON s.slide = u.slide AND s.rn = u.k + 1) v)"""


@query("merge_overlaps", f"""WITH RECURSIVE a AS (SELECT slide, x, y, w, h, round(confidence, 6) AS c, (detector <> 'ocr')::BIGINT AS cv, (detector = 'ocr')::BIGINT AS ocr, CASE WHEN detector = 'ocr' THEN cand_key ELSE '' END AS t FROM fx_candidates),
a1 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY y, x, h, w, c, t) AS rn FROM a WHERE cv = 1),
{_merge_walk('w1', 'a1')},
k1 AS (SELECT slide, unnest(kept) AS b, generate_subscripts(kept, 1) AS nr FROM (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY k DESC) AS back FROM w1) q WHERE back = 1),
a2 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY ocr > 0 AND cv = 0, CASE WHEN cv > 0 THEN nr END, y, x, h, w, c, t) AS rn FROM (
  SELECT slide, b.x AS x, b.y AS y, b.w AS w, b.h AS h, b.c AS c, b.cv AS cv, b.ocr AS ocr, b.t AS t, row_number() OVER (PARTITION BY slide ORDER BY b.y, b.x, nr) AS nr FROM k1
  UNION ALL SELECT slide, x, y, w, h, c, cv, ocr, t, NULL FROM a WHERE ocr = 1) q),
{_merge_walk('w2', 'a2')}
SELECT slide, b.x AS x, b.y AS y, b.w AS w, b.h AS h, b.c AS confidence, b.cv AS cv_members, b.ocr AS ocr_members, b.t AS text
FROM (SELECT slide, unnest(kept) AS b FROM (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY k DESC) AS back FROM w2) q WHERE back = 1) z""", "fx_candidates")
def _(t):
    return rg.merge_overlaps(t.fx_candidates.withColumn("text", F.when(c("detector") == "ocr", c("cand_key"))))


def manual(t):
    return t.fx_regions.where("source = 'manual'")


@query("suppress_against_existing", f"""WITH RECURSIVE m AS (SELECT slide, x, y, w, h, confidence, count(*) AS n FROM fx_regions WHERE source = 'manual' GROUP BY ALL),
s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY y, x, h, w, confidence) AS rn FROM (SELECT DISTINCT slide, x, y, w, h, confidence FROM fx_candidates) q),
walk AS (
  SELECT s.slide, 0::BIGINT AS k, coalesce(l.kept, [{{'x': s.x, 'y': s.y, 'w': s.w, 'h': s.h}}][2:]) AS kept, false AS added FROM s LEFT JOIN (SELECT slide, list({{'x': x, 'y': y, 'w': w, 'h': h}}) AS kept FROM m GROUP BY slide) l ON l.slide = s.slide WHERE rn = 1
  UNION ALL SELECT v.slide, v.k, CASE WHEN v.free THEN list_append(v.kept, {{'x': v.x, 'y': v.y, 'w': v.w, 'h': v.h}}) ELSE v.kept END, v.free
  FROM (SELECT u.slide, u.k + 1 AS k, u.kept, s.x, s.y, s.w, s.h, len([i FOR i IN range(1, len(u.kept) + 1) IF {_share('u.kept[i]', 's')} >= 0.45::DOUBLE]) = 0 AS free FROM walk u JOIN s ON s.slide = u.slide AND s.rn = u.k + 1) v)
SELECT slide, x, y, w, h, 'manual' AS origin, confidence, n AS copies FROM m
UNION ALL SELECT s.slide, s.x, s.y, s.w, s.h, 'candidate', s.confidence, 1 FROM s JOIN walk ON walk.slide = s.slide AND walk.k = s.rn AND walk.added""", "fx_regions fx_candidates")
def _(t):
    return rg.suppress(manual(t), t.fx_candidates)


@query("clear_of_manual", """
WITH m AS (SELECT DISTINCT slide, x, y, w, h FROM fx_regions WHERE source = 'manual')
SELECT slide, cand_key, detector, x, y, w, h FROM fx_candidates k WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.slide = k.slide
  AND (greatest(0, least(m.x+m.w, k.x+k.w) - greatest(m.x, k.x)) * greatest(0, least(m.y+m.h, k.y+k.h) - greatest(m.y, k.y)))::DOUBLE >=
  0.45::DOUBLE * (m.w*m.h + k.w*k.h - greatest(0, least(m.x+m.w, k.x+k.w) - greatest(m.x, k.x)) * greatest(0, least(m.y+m.h, k.y+k.h) - greatest(m.y, k.y))))""", "fx_regions fx_candidates")
def _(t):
    return rg.clear_of_manual(manual(t), t.fx_candidates).select("slide", "cand_key", "detector", "x", "y", "w", "h")


ALLOWED = "inpaint_allowed AND (class <> 'unknown_text' OR (exception_approved AND trim(exception_reason) <> ''))"
ROUTE = sql_case("background_type", vocab.REPAIR_OF, "'manual_review'")
JOINED_CTE = f"""jb AS (SELECT r.slide, r.id, r.region_key, r.class, coalesce(b.background_type, 'complex_unknown') AS background_type, b.recommended_repair
  FROM fx_regions r LEFT JOIN fx_backgrounds b ON b.slide = r.slide AND CASE b.notes WHEN '' THEN 'old_' ELSE '' END || b.region_key = r.region_key WHERE {ALLOWED}),
rt AS (SELECT *, {ROUTE} AS repair_method, CASE {ROUTE} WHEN 'redraw' THEN 'pass' WHEN 'inpaint' THEN 'pass' WHEN 'native_reconstruct' THEN 'partial'
   ELSE CASE background_type WHEN 'complex_unknown' THEN 'fail' ELSE 'partial' END END AS repair_status,
  CASE {ROUTE} WHEN 'redraw' THEN 'low' WHEN 'inpaint' THEN CASE background_type WHEN 'photo_texture' THEN 'medium' ELSE 'low' END WHEN 'native_reconstruct' THEN 'medium'
   ELSE CASE background_type WHEN 'complex_unknown' THEN 'high' ELSE 'medium' END END AS residual FROM jb)"""


def backgrounds(t):
    """All background rows; those without notes stand for regions that are there no more."""
    key = F.concat(F.when(c("notes") == "", "old_").otherwise(""), "region_key")
    return t.fx_backgrounds.select("slide", key.alias("region_key"), "background_type", "recommended_repair")


def joined(t):
    return rg.join_background(t.fx_regions, backgrounds(t), "region_key")


@query("region_background_join", f"WITH {JOINED_CTE} SELECT slide, id, region_key, class, background_type, recommended_repair FROM jb", "fx_regions fx_backgrounds")
def _(t):
    return joined(t).select("slide", "id", "region_key", "class", "background_type", "recommended_repair")


@query("route_repair", f"WITH {JOINED_CTE} SELECT slide, region_key, background_type, repair_method, repair_status, residual FROM rt", "fx_regions fx_backgrounds")
def _(t):
    return rg.route_repair(joined(t)).select("slide", "region_key", "background_type", "repair_method", "repair_status", "residual")


@query("repair_method_summary", f"""WITH {JOINED_CTE},
s AS (SELECT slide, count(*) FILTER (repair_method='redraw') AS redraw, count(*) FILTER (repair_method='inpaint') AS inpaint, count(*) FILTER (repair_method='manual_review') AS manual_review,
  count(*) FILTER (repair_method='native_reconstruct') AS native_reconstruct, bool_or(repair_status='fail') AS failed FROM rt GROUP BY slide)
SELECT slide, redraw, inpaint, manual_review, native_reconstruct, CASE WHEN failed THEN 'fail' WHEN manual_review + native_reconstruct > 0 THEN 'partial' ELSE 'pass' END AS status,
  CASE WHEN failed THEN 'high' WHEN manual_review + native_reconstruct > 0 OR inpaint > redraw THEN 'medium' ELSE 'low' END AS risk FROM s""", "fx_regions fx_backgrounds")
def _(t):
    return rg.repair_summary(rg.route_repair(joined(t)))


def _words(words):
    return "(" + " OR ".join(f"contains(meta, '{w}')" for w in words) + ")"


BG_RULES = [(_words(words), bg, conf) for bg, conf, words in vocab.BACKGROUND_WORDS] + [
    ("color_std <= 5.5 AND edge_density <= 0.10", "flat_color", 0.86), ("color_std <= 22 AND edge_density <= 0.08", "gradient", 0.68),
    ("color_std >= 34 AND edge_density >= 0.16", "photo_texture", 0.66), ("edge_density >= 0.22", "complex_unknown", 0.55),
    ("color_std <= 18", "panel", 0.62), ("true", "complex_unknown", 0.50)]
BG_TYPE = "CASE " + " ".join(f"WHEN {r} THEN '{bg}'" for r, bg, _ in BG_RULES) + " END"
BG_CONF = "CASE " + " ".join(f"WHEN {r} THEN {cf}::DOUBLE" for r, _, cf in BG_RULES) + " END"


@query("classify_background_type", f"""SELECT slide, region_key, {BG_TYPE} AS background_type, {BG_CONF} AS background_confidence,
  {sql_case('(' + BG_TYPE + ')', vocab.REPAIR_OF)} AS recommended_repair FROM fx_regions""", "fx_regions")
def _(t):
    return rg.classify_background(t.fx_regions).select("slide", "region_key", "background_type", "background_confidence", "recommended_repair")


@query("region_padding", """SELECT slide, region_key, greatest(2, padding_px)::BIGINT AS base_pad, least(32, greatest(2, padding_px)
  + CASE class WHEN 'semantic_text' THEN 3 WHEN 'micro_text' THEN 2 WHEN 'pseudo_text' THEN 2 WHEN 'decorative_glyph' THEN 2 ELSE 3 END
  + CASE WHEN regexp_matches(role, 'title|header|headline|bold|label') OR (h >= 34 AND class = 'semantic_text') THEN 2 ELSE 0 END
  + CASE WHEN confidence < 0.78::DOUBLE THEN 2 ELSE 0 END + CASE WHEN regexp_matches(role, 'shadow|glow|halo|blur') THEN 5 ELSE 0 END)::BIGINT AS pad FROM fx_regions""", "fx_regions")
def _(t):
    return rg.region_padding(t.fx_regions).select("slide", "region_key", "base_pad", "pad")


@query("reading_order", "SELECT slide, cand_key, detector, row_number() OVER (PARTITION BY slide ORDER BY y, x, md5(concat(cand_key, detector))) AS place FROM fx_candidates", "fx_candidates")
def _(t):
    return rg.reading_order(t.fx_candidates.withColumn("u", F.concat("cand_key", "detector")), "u").select("slide", "cand_key", "detector", "place")


@query("assign_ids", """
WITH r AS (SELECT slide, region_key, x, y, CASE WHEN source = 'manual' THEN id END AS id FROM fx_regions),  -- empty ids count as missing
u AS (SELECT DISTINCT slide, CAST(substr(id, 2) AS BIGINT) AS num FROM r WHERE id IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY y, x, md5(region_key)) AS k FROM r WHERE id IS NULL),
f AS (SELECT slide, n AS num, row_number() OVER (PARTITION BY slide ORDER BY n) AS k FROM (SELECT slide, unnest(range(1, m + 1)) AS n FROM (SELECT slide, count(*) AS m FROM r GROUP BY slide) s) q
      WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.slide = q.slide AND u.num = q.n))
SELECT slide, region_key, id FROM r WHERE id IS NOT NULL UNION ALL SELECT k.slide, region_key, printf('r%03d', num) FROM k JOIN f ON f.slide = k.slide AND f.k = k.k""", "fx_regions")
def _(t):
    r = t.fx_regions.select("slide", "region_key", "x", "y", F.when(c("source") == "manual", c("id")).otherwise(F.when(c("x") % 2 == 0, "")).alias("id"))
    return rg.assign_ids(r, "region_key").select("slide", "region_key", "id")


@query("class_counts", "SELECT slide, class, count(*) AS regions FROM fx_regions GROUP BY ALL", "fx_regions")
def _(t):
    return rg.class_counts(t.fx_regions)


@query("union_detectors", """
SELECT slide, x, y, w, h, 'manual' AS source, coalesce(confidence, 1.0) AS confidence, class, corrected_text, role, '' AS ocr_text, inpaint_allowed, padding_px::BIGINT AS padding_px FROM fx_regions WHERE source = 'manual'
UNION ALL SELECT slide, x, y, w, h, 'cv_candidate', confidence, 'unknown_text', '', '', '', true, 2 FROM fx_candidates WHERE detector = 'cv'
UNION ALL SELECT slide, x, y, w, h, 'ocr_candidate', confidence, 'unknown_text', '', '', cand_key, true, 2 FROM fx_candidates WHERE detector = 'ocr'""", "fx_regions fx_candidates")
def _(t):
    man = manual(t).select("slide", "x", "y", "w", "h", "source", "confidence", "class", "corrected_text", "role", "inpaint_allowed", "padding_px")
    base = ["slide", "x", "y", "w", "h", "confidence"]
    cv = t.fx_candidates.where("detector = 'cv'").select(*base)
    ocr = t.fx_candidates.where("detector = 'ocr'").select(*base, c("cand_key").alias("ocr_text"))
    return rg.union_detectors(man, cv, ocr)


# ---- regions with pixels: the 8x8 rasters and three boxes on each ---------------

def raster(t):
    return t.fx_pixels.select("slide", "x", "y", c("sr").alias("r"), c("sg").alias("g"), c("sb").alias("b"), luma("sr", "sg", "sb").alias("l"))


PADDED_CTE = """bp AS (SELECT slide, id, x AS ix1, y AS iy1, least(x+w, 8) AS ix2, least(y+h, 8) AS iy2, greatest(x-{p}, 0) AS x1, greatest(y-{p}, 0) AS y1,
   least(x+w+{p}, 8) AS x2, least(y+h+{p}, 8) AS y2 FROM fx_boxes8),
rp AS (SELECT bp.*, px.x, px.y, px.sr AS r, px.sg AS g, px.sb AS b, px.rr, px.rg, px.rb, 299*sr+587*sg+114*sb AS l, 299*rr+587*rg+114*rb AS m,
   px.x >= ix1 AND px.x < ix2 AND px.y >= iy1 AND px.y < iy2 AS "inner"
  FROM bp JOIN fx_pixels px ON px.slide = bp.slide AND px.x >= x1 AND px.x < x2 AND px.y >= y1 AND px.y < y2)"""


@query("pixels_in_boxes", f"""WITH {PADDED_CTE.format(p=1)}
SELECT 'ring' AS mode, slide, id, x, y FROM rp WHERE NOT "inner"
UNION ALL SELECT 'crop', slide, id, x, y FROM rp WHERE "inner"
UNION ALL SELECT 'mask', p.slide, NULL, p.x, p.y FROM fx_pixels p WHERE EXISTS (SELECT 1 FROM bp WHERE bp.slide = p.slide AND p.x BETWEEN ix1 AND ix2 AND p.y BETWEEN iy1 AND iy2)""", "fx_pixels fx_boxes8")
def _(t):
    px, b = t.fx_pixels.select("slide", "x", "y"), t.fx_boxes8
    def rows(mode, pad=0):
        f = rg.pixels_in_boxes(px, b, mode, 8, 8, pad)
        return f.select(F.lit(mode).alias("mode"), "slide", c("id") if mode != "mask" else F.lit(None).cast("string").alias("id"), "x", "y")
    return rows("ring", 1).unionByName(rows("crop")).unionByName(rows("mask"))


@query("mask_delta", """
WITH a AS (SELECT p.slide, count(*) AS n FROM fx_pixels p WHERE EXISTS (SELECT 1 FROM fx_boxes8 b WHERE b.slide = p.slide AND p.x BETWEEN b.x AND b.x+b.w AND p.y BETWEEN b.y AND b.y+b.h) GROUP BY 1),
e AS (SELECT p.slide, count(*) AS n FROM fx_pixels p WHERE EXISTS (SELECT 1 FROM fx_boxes8 b WHERE b.slide = p.slide AND p.x BETWEEN b.x-2 AND b.x+b.w+2 AND p.y BETWEEN b.y-2 AND b.y+b.h+2) GROUP BY 1)
SELECT slide, e.n AS wide, coalesce(a.n, 0) AS base, e.n - coalesce(a.n, 0) AS added FROM e LEFT JOIN a USING (slide)""", "fx_pixels fx_boxes8")
def _(t):
    return rg.delta_mask(rg.inclusive(t.fx_boxes8, 8, 8, 0), rg.inclusive(t.fx_boxes8, 8, 8, 2))


def ring(t):
    px = rg.with_neighbours(raster(t), "l", "l")
    return rg.region_pixels(px, t.fx_boxes8, rg.ring_pad(c("w"), c("h")), 8, 8)


RING_CTE = PADDED_CTE.format(p=8) + """,
ng AS (SELECT *, lag(l) OVER wx AS ll, lead(l) OVER wx AS lr, lag(l) OVER wy AS lu, lead(l) OVER wy AS ld FROM rp WINDOW wx AS (PARTITION BY slide, id, y ORDER BY x), wy AS (PARTITION BY slide, id, x ORDER BY y)),
gr AS (SELECT *, coalesce(lr-ll, (lr-l)*2, (l-ll)*2, 0) AS gx, coalesce(ld-lu, (ld-l)*2, (l-lu)*2, 0) AS gy FROM ng),
cnt AS (SELECT slide, id, count(*) FILTER (NOT "inner") AS n_o FROM gr GROUP BY ALL),
us AS (SELECT gr.*, n_o FROM gr JOIN cnt USING (slide, id) WHERE NOT "inner" OR n_o < 8)"""


@query("ring_stats", f"""WITH {RING_CTE},
st AS (SELECT slide, id, count(*)::BIGINT AS n, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b, sum(r*r)::BIGINT AS rr, sum(g*g)::BIGINT AS gg, sum(b*b)::BIGINT AS bb FROM us GROUP BY slide, id),
ed AS (SELECT slide, id, count(*) FILTER (NOT "inner" AND gx*gx+gy*gy > 1296000000) AS strong, max(n_o) AS n_o FROM gr JOIN cnt USING (slide, id) GROUP BY ALL)
SELECT slide, id, round((sqrt((n*rr-r*r)::DOUBLE)/n + sqrt((n*gg-g*g)::DOUBLE)/n + sqrt((n*bb-b*b)::DOUBLE)/n)/3, 6) AS color_std,
  round(strong::DOUBLE/greatest(n_o, 1), 6) AS edge_density, n_o AS ring_pixels FROM st JOIN ed USING (slide, id)""", "fx_pixels fx_boxes8")
def _(t):
    return rounded(rg.ring_stats(ring(t)), "color_std", "edge_density")


@query("top_colors", f"""WITH {RING_CTE},
q AS (SELECT slide, id, printf('#%02X%02X%02X', r//16*16, g//16*16, b//16*16) AS color, count(*) AS pixels FROM us GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY slide, id ORDER BY pixels DESC, color DESC) AS place FROM q)
SELECT slide, id, place, color, pixels FROM k WHERE place <= 5""", "fx_pixels fx_boxes8")
def _(t):
    return rg.top_colors(ring(t))


MASKED = """EXISTS (SELECT 1 FROM fx_boxes8 k WHERE k.slide = {a}.slide AND {a}.x BETWEEN k.x AND k.x+k.w AND {a}.y BETWEEN k.y AND k.y+k.h)"""


def masked_pixels(t, px):
    flag = rg.pixels_in_boxes(px.select("slide", "x", "y"), t.fx_boxes8, "mask", 8, 8).withColumn("masked", F.lit(True))
    return px.join(flag, ["slide", "x", "y"], "left").withColumn("masked", F.coalesce("masked", F.lit(False)))


@query("median_fill_color", f"""WITH {PADDED_CTE.format(p=10)},
mk AS (SELECT rp.*, {MASKED.format(a='rp')} AS masked FROM rp),
cn AS (SELECT slide, id, count(*) FILTER (NOT "inner" AND NOT masked) AS na, count(*) FILTER (NOT masked) AS nb FROM mk GROUP BY ALL),
ch AS (SELECT mk.* FROM mk JOIN cn USING (slide, id) WHERE CASE WHEN na >= 8 THEN NOT "inner" AND NOT masked WHEN nb >= 8 THEN NOT masked ELSE true END)
SELECT slide, id, round_even(quantile_cont(r::DOUBLE, 0.5), 0)::BIGINT AS r, round_even(quantile_cont(g::DOUBLE, 0.5), 0)::BIGINT AS g, round_even(quantile_cont(b::DOUBLE, 0.5), 0)::BIGINT AS b FROM ch GROUP BY slide, id""", "fx_pixels fx_boxes8")
def _(t):
    return rg.median_fill(rg.region_pixels(masked_pixels(t, raster(t)), t.fx_boxes8, 10, 8, 8))


def residual(t):
    px = t.fx_pixels.select("slide", "x", "y", luma("sr", "sg", "sb").alias("before"), luma("rr", "rg", "rb").alias("after"))
    px = masked_pixels(t, rg.with_many_neighbours(px, {"before": "before", "after": "after"}))
    return rg.residual_risk(rg.region_pixels(px, t.fx_boxes8, 6, 8, 8), high=(20, 0.10), medium=(8, 0.04))


RESIDUAL_CTE = PADDED_CTE.format(p=6) + f""",
ns AS (SELECT rp.*, {MASKED.format(a='rp')} AS masked, coalesce(lead(l) OVER wx - lag(l) OVER wx, (lead(l) OVER wx - l)*2, (l - lag(l) OVER wx)*2, 0) AS bx, coalesce(lead(l) OVER wy - lag(l) OVER wy, (lead(l) OVER wy - l)*2, (l - lag(l) OVER wy)*2, 0) AS yb,
   coalesce(lead(m) OVER wx - lag(m) OVER wx, (lead(m) OVER wx - m)*2, (m - lag(m) OVER wx)*2, 0) AS ax, coalesce(lead(m) OVER wy - lag(m) OVER wy, (lead(m) OVER wy - m)*2, (m - lag(m) OVER wy)*2, 0) AS ay
  FROM rp WINDOW wx AS (PARTITION BY slide, id, y ORDER BY x), wy AS (PARTITION BY slide, id, x ORDER BY y)),
mg AS (SELECT slide, id, masked, sqrt((bx*bx+yb*yb)::DOUBLE)/2000 AS bm, sqrt((ax*ax+ay*ay)::DOUBLE)/2000 AS am FROM ns),
lm AS (SELECT slide, id, greatest(14.0::DOUBLE, quantile_cont(bm, 0.7)*0.35::DOUBLE) AS lim FROM mg WHERE masked GROUP BY ALL),
rr AS (SELECT slide, id, count(*) FILTER (masked AND am > lim) AS residual_pixels, count(*) FILTER (masked) AS mask_pixels FROM mg LEFT JOIN lm USING (slide, id) GROUP BY ALL),
rs AS (SELECT *, CASE WHEN residual_pixels >= 20 AND residual_pixels::DOUBLE/greatest(mask_pixels,1) >= 0.1 THEN 'high' WHEN residual_pixels >= 8 AND residual_pixels::DOUBLE/greatest(mask_pixels,1) >= 0.04 THEN 'medium' ELSE 'low' END AS residual_risk FROM rr)"""


@query("residual_risk", f"WITH {RESIDUAL_CTE} SELECT * FROM rs", "fx_pixels fx_boxes8")
def _(t):
    return residual(t)


@query("residual_status", f"""WITH {RESIDUAL_CTE} SELECT slide, CASE max(r) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS residual_risk,
  CASE max(r) WHEN 2 THEN 'fail' WHEN 1 THEN 'partial' ELSE 'pass' END AS status FROM (SELECT slide, CASE residual_risk WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS r FROM rs) q GROUP BY slide""", "fx_pixels fx_boxes8")
def _(t):
    return rg.worst_risk(residual(t))


@query("mask_coverage", f"""WITH m AS (SELECT slide, count(*) FILTER ({MASKED.format(a='p')}) AS masked, count(*) FILTER ({MASKED.format(a='p')})::DOUBLE/64 AS coverage FROM fx_pixels p GROUP BY slide
  UNION ALL SELECT 1000000 + vec_id, 0, 0.0 FROM embeddings)
SELECT slide, masked, coverage, CASE WHEN coverage > 0.25 THEN 'fail' ELSE 'pass' END AS policy_status, CASE WHEN coverage > 0.25 THEN 'high' WHEN coverage > 0.1 THEN 'medium' ELSE 'low' END AS artifact_risk,
  CASE WHEN coverage > 0.18 THEN 'high' WHEN coverage > 0.06 THEN 'medium' ELSE 'low' END AS residual_risk FROM m""", "fx_pixels fx_boxes8")
def _(t):
    slides = t.embeddings.select(F.explode(F.array(c("vec_id"), c("vec_id") + 1000000)).alias("slide"))  # every second slide has no boxes
    return rg.mask_coverage(rg.inclusive(t.fx_boxes8, 8, 8, 0), 8, 8, slides=slides)


@query("feather_alpha", f"""WITH {PADDED_CTE.format(p=0)},
q AS (SELECT slide, id, x - x1 AS i, y - y1 AS j, x2 - x1 AS w, y2 - y1 AS h, CASE id WHEN 'b0' THEN 'LR' WHEN 'b1' THEN 'LRTB' ELSE 'T' END AS edges FROM rp),
a AS (SELECT slide, id, i, j, edges,
  least(CASE WHEN contains(edges,'L') AND i < least(26,w) THEN CASE WHEN least(26,w) > 1 THEN i::DOUBLE/(least(26,w)-1) ELSE 0 END ELSE 1 END,
        CASE WHEN contains(edges,'R') AND i >= w-least(26,w) THEN CASE WHEN least(26,w) > 1 THEN 1 - (i-(w-least(26,w)))::DOUBLE/(least(26,w)-1) ELSE 1 END ELSE 1 END) AS u,
  least(CASE WHEN contains(edges,'T') AND j < least(26,h) THEN CASE WHEN least(26,h) > 1 THEN j::DOUBLE/(least(26,h)-1) ELSE 0 END ELSE 1 END,
        CASE WHEN contains(edges,'B') AND j >= h-least(26,h) THEN CASE WHEN least(26,h) > 1 THEN 1 - (j-(h-least(26,h)))::DOUBLE/(least(26,h)-1) ELSE 1 END ELSE 1 END) AS v FROM q)
SELECT slide, id, i, j, edges, round(u*v, 6) AS alpha FROM a""", "fx_pixels fx_boxes8")
def _(t):
    crop = rg.pixels_in_boxes(t.fx_pixels.select("slide", "x", "y"), t.fx_boxes8, "crop", 8, 8).select(
        "slide", "id", (c("x") - c("x1")).alias("i"), (c("y") - c("y1")).alias("j"), (c("x2") - c("x1")).alias("w"), (c("y2") - c("y1")).alias("h"),
        F.when(c("id") == "b0", "LR").when(c("id") == "b1", "LRTB").otherwise("T").alias("edges"))
    return rounded(rg.feather_alpha(crop).select("slide", "id", "i", "j", "edges", "alpha"), "alpha")




@query("detect_regions")
def _(t):
    man = manual(t).select("slide", "id", "x", "y", "w", "h", "confidence")
    return text_layer.detect_regions(man, t.fx_candidates.withColumn("text", F.when(c("detector") == "ocr", c("cand_key"))))


@query("plan_repair", f"""WITH {JOINED_CTE} SELECT slide, region_key, background_type, repair_method, repair_status, residual FROM rt""", "fx_regions fx_backgrounds")
def _(t):
    return text_layer.plan_repair(t.fx_regions, backgrounds(t).drop("recommended_repair"), "region_key").select("slide", "region_key", "background_type", "repair_method", "repair_status", "residual")


POLYGONS_SQL = """WITH rp AS (SELECT slide, id, x, y, w, h, CASE id
   WHEN 'b0' THEN [{'x': 8.0::DOUBLE*x, 'y': 8.0::DOUBLE*y}, {'x': 8.0::DOUBLE*x+8*w, 'y': 8.0::DOUBLE*y+3}, {'x': 8.0::DOUBLE*x+4*w, 'y': 8.0::DOUBLE*y+4*h}, {'x': 8.0::DOUBLE*x+8*w, 'y': 8.0::DOUBLE*y+8*h}, {'x': 8.0::DOUBLE*x, 'y': 8.0::DOUBLE*y+8*h-1}]
   WHEN 'b1' THEN [{'x': 8.0::DOUBLE*x-3, 'y': 8.0::DOUBLE*y}, {'x': 8.0::DOUBLE*x+8*w, 'y': 8.0::DOUBLE*y+8*h}, {'x': 8.0::DOUBLE*x+8*w+1, 'y': 8.0::DOUBLE*y}, {'x': 8.0::DOUBLE*x-3, 'y': 8.0::DOUBLE*y+8*h+0.5}]
   ELSE CASE WHEN slide % 3 = 0 THEN [{'x': 8.0::DOUBLE*x, 'y': 8.0::DOUBLE*y}, {'x': 8.0::DOUBLE*x+8*w, 'y': 8.0::DOUBLE*y+8*h}] ELSE [{'x': 8.0::DOUBLE*x, 'y': 8.0::DOUBLE*y}, {'x': 8.0::DOUBLE*x, 'y': 8.0::DOUBLE*y}, {'x': 8.0::DOUBLE*x+1, 'y': 8.0::DOUBLE*y+8*h}] END END AS p FROM fx_boxes8),
cl AS (SELECT slide, id, x, y, w, h, [{'x': greatest(0, least(63, round_even(q.x, 0)))::BIGINT, 'y': greatest(0, least(63, round_even(q.y, 0)))::BIGINT} FOR q IN p] AS p FROM rp),
ed AS (SELECT slide, id, p[i] AS a, p[i % len(p) + 1] AS b FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM cl WHERE len(p) >= 3) q),
px AS (SELECT slide, id, gx.v AS x, gy.v AS y FROM (SELECT slide, id FROM cl WHERE len(p) >= 3) r, range(64) gx(v), range(64) gy(v)),
cr AS (SELECT px.slide, px.id, px.x, px.y, count(*) FILTER (a.y <> b.y AND px.y >= least(a.y, b.y) AND px.y < greatest(a.y, b.y) AND a.x + (px.y - a.y)::DOUBLE*(b.x - a.x)/nullif(b.y - a.y, 0) < px.x) AS before,
   count(*) FILTER (CASE WHEN a.y = b.y THEN px.y = a.y AND px.x BETWEEN least(a.x, b.x) AND greatest(a.x, b.x) ELSE px.y BETWEEN least(a.y, b.y) AND greatest(a.y, b.y)
     AND 2*abs((a.x - px.x)*(b.y - a.y) + (px.y - a.y)*(b.x - a.x)) < abs(b.y - a.y) END) AS near
   FROM px JOIN ed USING (slide, id) GROUP BY ALL),
cv AS (SELECT slide, id, x, y FROM cr WHERE before % 2 = 1 OR near > 0
   UNION ALL SELECT slide, id, gx.v, gy.v FROM cl, range(64) gx(v), range(64) gy(v) WHERE len(p) < 3 AND gx.v BETWEEN least(8*x, 63) AND least(8*x+8*w, 63) AND gy.v BETWEEN least(8*y, 63) AND least(8*y+8*h, 63))"""


def polygons(t):
    x, y, w, h = (c(n) * 8 for n in "xywh")
    def shape(*points):
        return F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in points])
    concave = shape((x, y), (x + w, y + 3), (x + w / 2, y + h / 2), (x + w, y + h), (x, y + h - 1))
    bow = shape((x - 3, y), (x + w, y + h), (x + w + 1, y), (x - 3, y + h + 0.5))
    sliver, line = shape((x, y), (x, y), (x + 1, y + h)), shape((x, y), (x + w, y + h))
    polygon = F.when(c("id") == "b0", concave).when(c("id") == "b1", bow).when(c("slide") % 3 == 0, line).otherwise(sliver)
    return t.fx_boxes8.select("slide", "id", polygon.alias("polygon"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


@query("polygon_spans", f"""{POLYGONS_SQL}, ru AS (SELECT *, x - row_number() OVER (PARTITION BY slide, id, y ORDER BY x) AS run FROM cv)
SELECT slide, id, y, min(x) AS x0, max(x) AS x1 FROM ru GROUP BY slide, id, y, run""", "fx_boxes8")
def _(t):
    return pg.region_spans(polygons(t), 64, 64)


@query("polygon_mask", f"""{POLYGONS_SQL}, un AS (SELECT DISTINCT slide, x, y FROM cv), ru AS (SELECT *, x - row_number() OVER (PARTITION BY slide, y ORDER BY x) AS run FROM un)
SELECT slide, y, min(x) AS x0, max(x) AS x1 FROM ru GROUP BY slide, y, run""", "fx_boxes8")
def _(t):
    return pg.union_spans(polygons(t), 64, 64)
