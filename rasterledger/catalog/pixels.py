"""Queries over pixel rows."""

from pyspark.sql import functions as F

from ..operators import pixels as px
from .registry import query

R6 = "round({0}, 6)"


def rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


@query("pair_surfaces", "SELECT * FROM fx_pairs", "fx_pairs")
def _(t):
    return px.pair_surfaces(t.fx_surfaces)


PIXEL_SQL = """
SELECT slide, comparison,
  round(sum(CASE WHEN abs(sr-rr)+abs(sg-rg)+abs(sb-rb) > 61.2::DOUBLE THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS pixel_difference_ratio,
  round(sum(abs(sr-rr)+abs(sg-rg)+abs(sb-rb))::DOUBLE / (count(*)*765), 6) AS mean_absolute_error,
  round(max(greatest(abs(sr-rr), abs(sg-rg), abs(sb-rb)))::DOUBLE / 255, 6) AS max_channel_error
FROM fx_pairs GROUP BY ALL"""


@query("pixel_metrics", PIXEL_SQL, "fx_pairs")
def _(t):
    return rounded(px.pixel_metrics(px.pair_surfaces(t.fx_surfaces)), "pixel_difference_ratio", "mean_absolute_error", "max_channel_error")


@query("diff_bbox", """
SELECT slide, comparison, coalesce(min(x) FILTER (c), 0) AS x, coalesce(min(y) FILTER (c), 0) AS y,
  coalesce(max(x) FILTER (c) - min(x) FILTER (c) + 1, 0) AS w, coalesce(max(y) FILTER (c) - min(y) FILTER (c) + 1, 0) AS h
FROM (SELECT *, abs(sr-rr)+abs(sg-rg)+abs(sb-rb) > 61.2::DOUBLE AS c FROM fx_pairs) q GROUP BY ALL""", "fx_pairs")
def _(t):
    return px.diff_bbox(px.pair_surfaces(t.fx_surfaces))


DRIFT_CTE = """
h AS (SELECT slide, comparison, least(sr*8//255,7)*64+least(sg*8//255,7)*8+least(sb*8//255,7) AS bin, 1 AS s, 0 AS t FROM fx_pairs
      UNION ALL SELECT slide, comparison, least(rr*8//255,7)*64+least(rg*8//255,7)*8+least(rb*8//255,7), 0, 1 FROM fx_pairs),
hb AS (SELECT slide, comparison, bin, sum(s) AS s, sum(t) AS t FROM h GROUP BY ALL),
drift AS (SELECT slide, comparison, sum(abs(s-t))::DOUBLE / (sum(s)*2) AS color_palette_drift FROM hb GROUP BY ALL)"""


@query("palette_drift", f"WITH {DRIFT_CTE} SELECT slide, comparison, round(color_palette_drift, 6) AS color_palette_drift FROM drift", "fx_pairs")
def _(t):
    return rounded(px.palette_drift(px.pair_surfaces(t.fx_surfaces)), "color_palette_drift")


GRADIENT_CTE = """
l AS (SELECT slide, surface, x, y, 299*r+587*g+114*b AS l FROM fx_surfaces),
g AS (SELECT slide, surface, x, y,
        coalesce((lead(l) OVER wx - lag(l) OVER wx)*2, 0) AS gx2, coalesce((lead(l) OVER wy - lag(l) OVER wy)*2, 0) AS gy2,
        coalesce(lead(l) OVER wx - lag(l) OVER wx, (lead(l) OVER wx - l)*2, (l - lag(l) OVER wx)*2, 0) AS hx2,
        coalesce(lead(l) OVER wy - lag(l) OVER wy, (lead(l) OVER wy - l)*2, (l - lag(l) OVER wy)*2, 0) AS hy2
      FROM l WINDOW wx AS (PARTITION BY slide, surface, y ORDER BY x), wy AS (PARTITION BY slide, surface, x ORDER BY y))"""


@query("image_gradient", f"WITH {GRADIENT_CTE} SELECT slide, surface, x, y, gx2, gy2, hx2, hy2 FROM g", "fx_surfaces")
def _(t):
    s = t.fx_surfaces
    half = px.gradient(s, "half").withColumnsRenamed({"gx2": "hx2", "gy2": "hy2"})
    return px.gradient(s, "central").join(half, ["slide", "surface", "x", "y"])


EDGE_CTE = GRADIENT_CTE + """,
m AS (SELECT slide, surface, x, y, sqrt((gx2*gx2+gy2*gy2)::DOUBLE)/2 AS mag FROM g),
th AS (SELECT slide, surface, greatest(quantile_cont(mag, 0.85), 10200.0::DOUBLE) AS th FROM m GROUP BY ALL),
e AS (SELECT m.slide, m.surface, x, y, mag > th AS edge FROM m JOIN th USING (slide, surface))"""


@query("edge_flags", f"WITH {EDGE_CTE} SELECT * FROM e", "fx_surfaces")
def _(t):
    return px.edge_flags(t.fx_surfaces)


EDGE_METRIC_CTE = EDGE_CTE + """,
ep AS (SELECT a.slide, 'pptx_vs_source' AS comparison, a.x, a.y, a.edge AS s, b.edge AS t FROM e a JOIN e b USING (slide, x, y) WHERE a.surface='source' AND b.surface='pptx'
  UNION ALL SELECT a.slide, 'html_vs_source', a.x, a.y, a.edge, b.edge FROM e a JOIN e b USING (slide, x, y) WHERE a.surface='source' AND b.surface='html'
  UNION ALL SELECT a.slide, 'pptx_vs_html', a.x, a.y, a.edge, b.edge FROM e a JOIN e b USING (slide, x, y) WHERE a.surface='pptx' AND b.surface='html'),
em AS (SELECT slide, comparison, (count(*) FILTER (s <> t))::DOUBLE / count(*) AS edge_difference_ratio,
  (count(*) FILTER (s))::DOUBLE / count(*) AS source_edge_density, (count(*) FILTER (t))::DOUBLE / count(*) AS render_edge_density,
  (count(*) FILTER (s) - count(*) FILTER (t))::DOUBLE / count(*) AS edge_density_delta,
  coalesce(min(x) FILTER (s <> t), 0) AS edge_x, coalesce(min(y) FILTER (s <> t), 0) AS edge_y,
  coalesce(max(x) FILTER (s <> t) - min(x) FILTER (s <> t) + 1, 0) AS edge_w, coalesce(max(y) FILTER (s <> t) - min(y) FILTER (s <> t) + 1, 0) AS edge_h
  FROM ep GROUP BY ALL)"""


@query("edge_metrics", f"""WITH {EDGE_METRIC_CTE} SELECT slide, comparison, round(edge_difference_ratio, 6) AS edge_difference_ratio,
  round(source_edge_density, 6) AS source_edge_density, round(render_edge_density, 6) AS render_edge_density,
  round(edge_density_delta, 6) AS edge_density_delta, edge_x, edge_y, edge_w, edge_h FROM em""", "fx_surfaces")
def _(t):
    return rounded(px.edge_metrics(px.edge_flags(t.fx_surfaces)), "edge_difference_ratio", "source_edge_density", "render_edge_density", "edge_density_delta")


SSIM_CTE = """
lp AS (SELECT slide, comparison, x, y, 299*sr+587*sg+114*sb AS p, 299*rr+587*rg+114*rb AS q FROM fx_pairs),
sx AS (SELECT slide, comparison, x, y, count(*) OVER w AS n, sum(p) OVER w AS p, sum(q) OVER w AS q, sum(p*p) OVER w AS pp, sum(q*q) OVER w AS qq, sum(p*q) OVER w AS pq
  FROM lp WINDOW w AS (PARTITION BY slide, comparison, y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
sy AS (SELECT slide, comparison, sum(n) OVER w AS n, (sum(p) OVER w)::DOUBLE AS p, (sum(q) OVER w)::DOUBLE AS q, (sum(pp) OVER w)::DOUBLE AS pp, (sum(qq) OVER w)::DOUBLE AS qq, (sum(pq) OVER w)::DOUBLE AS pq
  FROM sx WINDOW w AS (PARTITION BY slide, comparison, x ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
si AS (SELECT slide, comparison, n, ((p/49)*(q/49)*2 + 6502500)*((pq*49-p*q)/2352*2 + 58522500) /
   (((p/49)*(p/49)+(q/49)*(q/49)+6502500)*((pp*49-p*p)/2352+(qq*49-q*q)/2352+58522500)) AS idx FROM sy),
ssim AS (SELECT slide, comparison, sum(CASE WHEN n=49 THEN round(idx*1e9)::BIGINT END)::DOUBLE / nullif(count(*) FILTER (n=49), 0) / 1e9 AS approx_ssim FROM si GROUP BY ALL)"""


@query("ssim", f"WITH {SSIM_CTE} SELECT slide, comparison, round(approx_ssim, 6) AS approx_ssim FROM ssim", "fx_pairs")
def _(t):
    return rounded(px.ssim(px.pair_surfaces(t.fx_surfaces)), "approx_ssim")


BOXES = "bx AS (SELECT slide, id, x AS x1, y AS y1, least(x+w, 7) AS x2, least(y+h, 7) AS y2 FROM fx_boxes8)"


def box_corners(t):
    """Padded corner form, both ends inside, on the 8x8 canvas."""
    return t.fx_boxes8.select("slide", "id", F.col("x").alias("x1"), F.col("y").alias("y1"),
                              F.least(F.col("x") + F.col("w"), F.lit(7)).alias("x2"), F.least(F.col("y") + F.col("h"), F.lit(7)).alias("y2"))


@query("text_density", f"""WITH {EDGE_CTE}, {BOXES},
mk AS (SELECT e.slide, e.surface, e.edge, l.l FROM e JOIN l USING (slide, surface, x, y)
       WHERE EXISTS (SELECT 1 FROM bx WHERE bx.slide = e.slide AND e.x BETWEEN x1 AND x2 AND e.y BETWEEN y1 AND y2)),
d AS (SELECT slide, surface, (count(*) FILTER (l < 158100 OR edge))::DOUBLE / count(*) AS density FROM mk GROUP BY ALL)
SELECT d.slide, d.surface, round(d.density, 6) AS density, round(abs(d.density - s.density), 6) AS difference_from_source
FROM d JOIN d s ON d.slide = s.slide AND s.surface = 'source'""", "fx_surfaces fx_boxes8")
def _(t):
    return rounded(px.text_density(t.fx_surfaces, box_corners(t)), "density", "difference_from_source")


def gray(t):
    return t.fx_pixels.select("slide", "x", "y", F.floor(px.luma("sr", "sg", "sb") / 1000).alias("gray"))


OTSU = """{h} AS (SELECT slide, {v} AS v, count(*) AS n FROM {src} GROUP BY ALL),
{h}c AS (SELECT slide, v, sum(n) OVER w AS c, sum(v*n) OVER w AS s, sum(n) OVER (PARTITION BY slide) AS n, sum(v*n) OVER (PARTITION BY slide) AS t
  FROM {h} WINDOW w AS (PARTITION BY slide ORDER BY v ROWS UNBOUNDED PRECEDING)),
{h}s AS (SELECT slide, v, CASE WHEN n > c THEN (t*c-s*n)::DOUBLE*(t*c-s*n)::DOUBLE/(c*(n-c))::DOUBLE ELSE 0.0 END AS score FROM {h}c),
{h}t AS (SELECT slide, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY score DESC, v) AS rn FROM {h}s) q WHERE rn = 1)"""
GRAY = "gy AS (SELECT slide, x, y, (299*sr+587*sg+114*sb)//1000 AS gray FROM fx_pixels)"


@query("otsu_threshold", f"WITH {GRAY}, {OTSU.format(h='o', v='gray', src='gy')} SELECT slide, threshold FROM ot", "fx_pixels")
def _(t):
    return px.otsu(gray(t))


@query("morphology", f"""WITH {GRAY},
b1 AS (SELECT slide, x, y, coalesce(lag(gray) OVER w, lead(gray) OVER w, gray) + 2*gray + coalesce(lead(gray) OVER w, lag(gray) OVER w, gray) AS v FROM gy WINDOW w AS (PARTITION BY slide, y ORDER BY x)),
b2 AS (SELECT slide, x, y, (coalesce(lag(v) OVER w, lead(v) OVER w, v) + 2*v + coalesce(lead(v) OVER w, lag(v) OVER w, v) + 8)//16 AS blur FROM b1 WINDOW w AS (PARTITION BY slide, x ORDER BY y)),
r1 AS (SELECT *, max(blur) OVER w AS hi, min(blur) OVER w AS lo FROM b2 WINDOW w AS (PARTITION BY slide, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
r2 AS (SELECT slide, x, y, blur, max(hi) OVER w - min(lo) OVER w AS local_range FROM r1 WINDOW w AS (PARTITION BY slide, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
{OTSU.format(h='o', v='local_range', src='r2')},
bw AS (SELECT r2.*, CASE WHEN local_range > threshold THEN 1 ELSE 0 END::BIGINT AS bw FROM r2 JOIN ot USING (slide)),
d1 AS (SELECT *, max(bw) OVER (PARTITION BY slide, y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS dx FROM bw),
d2 AS (SELECT *, max(dx) OVER (PARTITION BY slide, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS dil FROM d1),
e1 AS (SELECT *, min(dil) OVER (PARTITION BY slide, y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS ex FROM d2)
SELECT slide, x, y, blur, local_range, bw, min(ex) OVER (PARTITION BY slide, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS closed FROM e1""", "fx_pixels")
def _(t):
    return px.morphology(gray(t))


@query("band_projection", """
WITH m AS (SELECT slide, x AS pos, (count(*) FILTER (sr > sb))::BIGINT AS mass FROM fx_pixels GROUP BY ALL),
k AS (SELECT *, pos - row_number() OVER (PARTITION BY slide ORDER BY pos) AS island FROM m WHERE mass > 3)
SELECT slide, min(pos) AS start, max(pos) AS "end", sum(mass)::BIGINT AS mass FROM k GROUP BY slide, island""", "fx_pixels")
def _(t):
    return px.color_bands(t.fx_pixels, F.col("sr") > F.col("sb"))


@query("connected_components", """
WITH RECURSIVE m AS (SELECT slide, x, y FROM fx_pixels WHERE 299*sr+587*sg+114*sb > 150000),
reach AS (SELECT slide, y*16777216+x AS root, x, y FROM m
  UNION SELECT r.slide, r.root, m.x, m.y FROM reach r JOIN m ON m.slide=r.slide AND abs(m.x-r.x)<=1 AND abs(m.y-r.y)<=1),
lab AS (SELECT slide, x, y, min(root) AS label FROM reach GROUP BY ALL)
SELECT slide, label//16777216 AS top_y, label%16777216 AS top_x, min(x) AS x, min(y) AS y, max(x)-min(x)+1 AS w, max(y)-min(y)+1 AS h, count(*) AS area
FROM lab GROUP BY slide, label""", "fx_pixels")
def _(t):
    return px.connected_components(t.fx_pixels.where(px.luma("sr", "sg", "sb") > 150000).select("slide", "x", "y"))


METRICS_SQL_CTE = f"{EDGE_METRIC_CTE}, {DRIFT_CTE}, {SSIM_CTE}, pm AS ({PIXEL_SQL.replace('round(', '(').replace(', 6)', ')')})"
METRIC_COLS = ["pixel_difference_ratio", "mean_absolute_error", "max_channel_error", "approx_ssim", "edge_difference_ratio",
               "source_edge_density", "render_edge_density", "edge_density_delta", "color_palette_drift"]


@query("compare_surfaces", f"""WITH {METRICS_SQL_CTE}
SELECT slide, comparison, {', '.join(f'round({c}, 6) AS {c}' for c in METRIC_COLS)}
FROM pm JOIN em USING (slide, comparison) JOIN drift USING (slide, comparison) JOIN ssim USING (slide, comparison)""", "fx_surfaces fx_pairs")
def _(t):
    return rounded(px.compare_surfaces(t.fx_surfaces).select("slide", "comparison", *METRIC_COLS), *METRIC_COLS)
