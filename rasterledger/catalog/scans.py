"""Queries of sources and sinks, on inputs that Spark derives from the tables."""

import uuid

from pyspark.sql import functions as F

from .. import vocab
from ..operators import severity
from ..session import checkpoint_folder
from ..sources import documents, images, packages, sinks
from .registry import query
from .rollup import FIX_SQL, SLIDE_CTE

c = F.col


@query("read_evidence_json", """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(props->>'$.k' AS BIGINT) END AS k, event_type <> 'error' AS readable FROM events""".replace("props->>", "CAST(props AS JSON)->>"))
def _(t):
    docs = t.events.select("event_id", F.when(c("event_type") == "error", F.concat(F.lit("{broken"), c("props"))).otherwise(c("props")).alias("doc"))
    return documents.parse_evidence(docs, "doc", "k BIGINT").select("event_id", "k", "readable")


def crop_docs(t):
    """The five plan shapes, one crop per document."""
    s = c("supp_no") % 5
    def q(v):
        return F.concat(F.lit('"'), v, F.lit('"'))
    def n(v):
        return c(v).cast("string")
    fields = F.concat_ws(",", F.concat(F.lit('"x":'), n("x"), F.lit(".5")), F.concat(F.lit('"y":'), q(n("y"))), F.concat(F.lit('"w":'), n("w")), F.concat(F.lit('"h":'), n("h")),
                         F.concat(F.lit('"contentType":'), q(c("content_type"))), F.when(c("reconstruction_reason").isNotNull(), F.concat(F.lit('"reconstruction_reason":'), q(c("reconstruction_reason")))),
                         F.concat(F.lit('"editable_replacement":'), q(F.coalesce("editable_replacement", F.lit("")))), F.concat(F.lit('"allowLargeCrop":'), n("allow_large_crop")),
                         F.when(c("reason").isNotNull(), F.concat(F.lit('"justification":'), q(c("reason")))), F.lit('"edges":"lr"'))
    named = F.concat(F.lit('{"name":'), q(c("name")), F.lit(","), fields, F.lit("}"))
    with_slide = F.concat(F.lit('{"name":'), q(c("name")), F.lit(',"slide":'), n("slide"), F.lit(","), fields, F.lit("}"))
    keyed = F.concat(F.lit("{"), q(c("name")), F.lit(":{"), fields, F.lit("}}"))
    arr = F.concat(F.lit("{"), q(c("name")), F.lit(":["), F.concat_ws(",", n("slide"), n("x"), n("y"), n("w"), n("h"), F.lit('"TBX"')), F.lit("]}"))
    doc = (F.when(s == 0, F.concat(F.lit("["), with_slide, F.lit("]"))).when(s == 1, F.concat(F.lit('{"crops":['), named, F.lit("]}")))
           .when(s == 2, F.concat(F.lit('{"crops":'), keyed, F.lit("}"))).when(s == 3, F.concat(F.lit('{"slides":{"slide'), n("slide"), F.lit('":'), keyed, F.lit("}}"))).otherwise(arr))
    doc = F.when(c("supp_no") % 23 == 0, F.concat(F.lit("{broken"), doc)).when(c("supp_no") % 29 == 0, F.lit(None)).otherwise(doc)
    return t.fx_crops.select("part_no", "supp_no", doc.alias("doc"), F.when(s != 3, c("slide")).alias("fallback_slide"))


@query("normalize_crop_plan", f"""SELECT part_no, supp_no, NULL AS name, NULL AS slide, NULL AS x, NULL AS y, NULL AS w, NULL AS h, '' AS feather_edges, 'dense_infographic' AS content_type, '{vocab.LEGACY_REASON}' AS reconstruction_reason,
  'none' AS editable_replacement, NULL AS allow_large_crop, NULL AS reason, 'content_type|reconstruction_reason|editable_replacement' AS missing_metadata, false AS metadata_complete, 'unreadable plan' AS error
FROM fx_crops WHERE supp_no % 23 = 0 OR supp_no % 29 = 0 UNION ALL
SELECT part_no, supp_no, name, slide, CASE WHEN a THEN x ELSE round_even(x + 0.5::DOUBLE, 0)::BIGINT END AS x, y, w, h, CASE WHEN a THEN 'TBX' ELSE 'LR' END AS feather_edges,
  CASE WHEN a THEN 'dense_infographic' ELSE content_type END AS content_type, CASE WHEN a OR reconstruction_reason IS NULL THEN '{vocab.LEGACY_REASON}' ELSE reconstruction_reason END AS reconstruction_reason,
  CASE WHEN a OR editable_replacement IS NULL THEN 'none' ELSE editable_replacement END AS editable_replacement, CASE WHEN NOT a THEN allow_large_crop END AS allow_large_crop, CASE WHEN NOT a THEN reason END AS reason,
  concat_ws('|', CASE WHEN a THEN 'content_type' END, CASE WHEN a OR reconstruction_reason IS NULL THEN 'reconstruction_reason' END, CASE WHEN a OR editable_replacement IS NULL THEN 'editable_replacement' END) AS missing_metadata,
  NOT (a OR reconstruction_reason IS NULL OR editable_replacement IS NULL) AS metadata_complete, CASE WHEN a THEN 'invalid feather_edges' END AS error
FROM (SELECT *, supp_no % 5 = 4 AS a FROM fx_crops WHERE supp_no % 23 <> 0 AND supp_no % 29 <> 0) q""", "fx_crops")
def _(t):
    return documents.normalize_crop_plan(crop_docs(t)).withColumn("missing_metadata", F.array_join("missing_metadata", "|"))


def header_files(t):
    w, h = c("l_partkey") % 4000 + 1, c("l_suppkey") % 3000 + 1
    def hex_of(v, n):
        return F.lpad(F.hex(v), n, "0")
    k = c("l_linenumber") % 4
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hex_of(w, 8), hex_of(h, 8), F.lit("0802000000"))
    jpeg = F.concat(F.lit("FFD8FFE000040000FFC0001108"), hex_of(h, 4), hex_of(w, 4), F.lit("0300000000"))
    data = F.when(k == 0, jpeg).when(k == 3, F.when(c("l_suppkey") % 2 == 0, F.lit("89504E470D0A1A0A0000")).otherwise(F.lit("47494638"))).otherwise(png)
    key = F.concat_ws("_", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return t.lineitem.select(key.alias("path"), F.unhex(data).alias("content"))


@query("image_header_scan", """WITH b AS (SELECT concat_ws('_', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS path, l_partkey % 4000 + 1 AS w, l_suppkey % 3000 + 1 AS h, l_linenumber % 4 AS k, l_suppkey % 2 AS s FROM lineitem),
d AS (SELECT *, CASE WHEN k = 0 THEN 'FFD8FFE000040000FFC0001108' || printf('%04X', h) || printf('%04X', w) || '0300000000' WHEN k = 3 THEN CASE s WHEN 0 THEN '89504E470D0A1A0A0000' ELSE '47494638' END
   ELSE '89504E470D0A1A0A0000000D49484452' || printf('%08X', w) || printf('%08X', h) || '0802000000' END AS x FROM b)
SELECT path, CASE WHEN k = 0 THEN 'jpeg' WHEN k = 3 AND s = 1 THEN NULL ELSE 'png' END AS format, CASE WHEN k < 3 THEN w END AS width, CASE WHEN k < 3 THEN h END AS height, sha256(unhex(x)) AS sha256,
  CASE WHEN k = 3 THEN CASE s WHEN 0 THEN 'short PNG header' ELSE 'not a PNG or JPEG file' END END AS error FROM d""")
def _(t):
    return images.scan_headers(header_files(t))


@query("raster_ingest", """SELECT slide, x, y, sr AS r, sg AS g, sb AS b, NULL AS error FROM fx_pixels WHERE slide % 20 <> 0
UNION ALL SELECT DISTINCT slide, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, 'not a PNG file' FROM fx_pixels WHERE slide % 20 = 0""", "fx_pixels")
def _(t):
    px = t.fx_pixels.select("slide", "x", "y", c("sr").alias("r"), c("sg").alias("g"), c("sb").alias("b"))
    files = images.build_pngs(px).withColumn("content", F.when(c("slide") % 20 == 0, F.unhex(F.lit("FFD8FFE0"))).otherwise(c("content")))
    return images.ingest_rasters(files, ["slide"])


def _axis(size, new):
    return f"""(SELECT dst, src, raw / sum(raw) OVER (PARTITION BY dst) AS weight FROM (SELECT dst, src, CASE WHEN abs(tt) < 1e-12 THEN 1.0::DOUBLE WHEN abs(tt) < 3 THEN sin(pi()*tt)/(pi()*tt) * sin(pi()*tt/3)/(pi()*tt/3) ELSE 0.0::DOUBLE END AS raw
      FROM (SELECT d.i AS dst, s.i AS src, (s.i + 0.5 - (d.i + 0.5)*{size / new}::DOUBLE) / {max(size / new, 1.0)}::DOUBLE AS tt FROM range({new}) d(i), range({size}) s(i)) z) y WHERE raw <> 0)"""


@query("resample_raster", f"""WITH p AS (SELECT slide, x, y, rr AS r, rg AS g, rb AS b FROM fx_pixels), wx AS {_axis(8, 5)}, wy AS {_axis(8, 11)},
h AS (SELECT slide, dst AS x, y, {', '.join(f'least(255, greatest(0, floor(round(sum({k}*weight), 9) + 0.5)))::BIGINT AS {k}' for k in 'rgb')} FROM p JOIN wx ON src = x WHERE slide % 3 <> 0 GROUP BY slide, dst, y),
v AS (SELECT slide, x, dst AS y, {', '.join(f'least(255, greatest(0, floor(round(sum({k}*weight), 9) + 0.5)))::BIGINT AS {k}' for k in 'rgb')} FROM h JOIN wy ON src = y GROUP BY slide, x, dst)
SELECT slide, x, y, r, g, b, true AS resized FROM v UNION ALL SELECT slide, x, y, r, g, b, false FROM p WHERE slide % 3 = 0""", "fx_pixels")
def _(t):
    px = t.fx_pixels.select("slide", "x", "y", c("rr").alias("r"), c("rg").alias("g"), c("rb").alias("b"))
    keep = c("slide") % 3 == 0
    def size(v):
        return F.lit(v).cast("bigint")
    sizes = t.embeddings.select(c("vec_id").alias("slide")).select(
        "slide", size(8).alias("w0"), size(8).alias("h0"), F.when(keep, size(8)).otherwise(size(5)).alias("w1"), F.when(keep, size(8)).otherwise(size(11)).alias("h1"))
    return images.resample(px, sizes)


@query("package_part_scan", """SELECT page_id AS pkg, 'ppt/slides/index.html' AS part, 'html' AS ext, octet_length(encode(html)) AS bytes, sha256(html) AS text_sha, true AS crc_ok, CAST(NULL AS VARCHAR) AS error FROM pages
UNION ALL SELECT page_id, 'docProps/url.txt', 'txt', octet_length(encode(url)), sha256(url), true, NULL FROM pages""")
def _(t):
    built = packages.build_packages(t.pages.withColumnRenamed("page_id", "pkg"), "pkg", {"ppt/slides/index.html": "html", "docProps/url.txt": "url"})
    return packages.scan_packages(built).select("pkg", "part", "ext", "bytes", F.sha2("text", 256).alias("text_sha"), "crc_ok", "error")


@query("write_results", f"""WITH mx AS (SELECT * FROM fx_metrics), sg AS (SELECT * FROM fx_signals), {SLIDE_CTE}, {FIX_SQL},
o AS (SELECT * FROM (VALUES ('pptx_vs_source', 0), ('html_vs_source', 1), ('pptx_vs_html', 2)) v(comparison, n))
SELECT slide, 0 AS section, unnest([0, 1, 2, 3, 4]) AS place, unnest(['# Slide ' || slide || ' Visual Polish Report', '- Mode: `qa-polish`', '- Status: `' || status || '`', '- Severity: `' || severity || '`', '## Metrics']) AS line FROM sl
UNION ALL SELECT slide, 1, n, printf('- %s: pixel_diff=%.4f, mae=%.4f, edge_diff=%.4f, ssim=%s, palette_drift=%.4f', comparison, pixel_difference_ratio, mean_absolute_error, edge_difference_ratio,
   coalesce(printf('%.4f', approx_ssim), 'unavailable'), color_palette_drift) FROM mx JOIN o USING (comparison)
UNION ALL SELECT slide, 2, n, '- [' || severity || '/' || type || '] fix strategy: ' || fix_strategy || '; crop allowed: ' || CASE WHEN crop_allowed THEN 'yes' ELSE 'no' END FROM fx JOIN o USING (comparison)""", "fx_metrics fx_signals fx_tags")
def _(t):
    m, s = t.fx_metrics, t.fx_signals
    plan = severity.fix_plan(severity.classify_comparison(m, s), t.fx_tags)
    return sinks.report_lines(severity.slide_severity(m, s), m, plan)


@query("publish_results", "SELECT slide, severity, issue_count, status, CASE status WHEN 'fail' THEN 2 ELSE 1 END AS run FROM fx_summary", "fx_summary")
def _(t):
    """All slides are published by status, then the failed ones again; the second run replaces its own partition only."""
    path = f"{checkpoint_folder(t.spark).rstrip('/')}/published-{uuid.uuid4().hex}"
    rows = t.fx_summary.select("slide", "severity", "issue_count", "status")
    sinks.publish(rows.withColumn("run", F.lit(1)), path, ["status"])
    sinks.publish(rows.where("status = 'fail'").withColumn("run", F.lit(2)), path, ["status"])
    return sinks.read_published(t.spark, path).select("slide", "severity", "issue_count", "status", "run")
