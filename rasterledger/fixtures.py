"""Evidence tables derived from the driver's tables.

The given data holds no slide images, so each evidence table is a deterministic
re-labelling of a given table, over all of its rows. ``BOTH`` texts run
unchanged on Spark and on DuckDB; where array syntax differs the Spark side is
written with the DataFrame API and ``DUCK`` holds the other text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

BOTH = {
    "fx_regions": """
SELECT l_orderkey AS slide, concat('r', lpad(CAST(l_linenumber AS STRING), 3, '0')) AS id,
  concat(CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS region_key,
  (l_partkey*37) % 1500 AS x, (l_suppkey*53 + l_linenumber*97) % 860 AS y,
  CAST(20 + l_quantity*6 AS BIGINT) AS w, 10 + l_partkey % 40 AS h,
  CASE l_partkey % 5 WHEN 0 THEN 'semantic_text' WHEN 1 THEN 'pseudo_text' WHEN 2 THEN 'micro_text'
       WHEN 3 THEN 'decorative_glyph' ELSE 'unknown_text' END AS class,
  CASE l_returnflag WHEN 'N' THEN 'cv_candidate' WHEN 'A' THEN 'ocr_candidate' ELSE 'manual' END AS source,
  round(0.5 + l_discount*5, 4) AS confidence,
  CASE WHEN l_partkey % 5 = 0 AND l_partkey % 35 <> 0 THEN p_name WHEN l_partkey % 55 = 1 THEN p_name ELSE '' END AS corrected_text,
  CASE WHEN l_partkey % 45 = 3 THEN p_name ELSE '' END AS native_text,
  CASE WHEN l_suppkey % 9 = 0 THEN 'pseudo_text' ELSE NULL END AS previous_class,
  CASE WHEN l_suppkey % 18 = 0 THEN true ELSE false END AS promotion_approved,
  CASE WHEN l_returnflag = 'A' THEN p_name ELSE '' END AS ocr_text,
  CASE WHEN l_suppkey % 6 = 0 THEN '' ELSE 'seen by reviewer' END AS notes,
  CASE WHEN l_partkey % 10 = 4 THEN true ELSE false END AS exception_approved,
  CASE WHEN l_partkey % 20 = 4 THEN 'reviewed' ELSE '' END AS exception_reason,
  CASE WHEN l_suppkey % 15 = 0 THEN false ELSE true END AS inpaint_allowed,
  l_linenumber % 4 AS padding_px,
  CASE WHEN l_suppkey % 7 = 0 THEN lower(concat('title ', p_name)) WHEN l_suppkey % 7 = 1 THEN 'soft shadow' ELSE lower(p_name) END AS role,
  lower(concat(p_type, ' ', p_name, CASE l_suppkey % 11 WHEN 0 THEN ' chart' WHEN 1 THEN ' icon' WHEN 2 THEN ' table' WHEN 3 THEN ' underline'
       WHEN 4 THEN ' badge' WHEN 5 THEN ' photo' WHEN 6 THEN ' glow' ELSE '' END)) AS meta,
  round(l_tax*500, 4) AS color_std, round(l_discount*3, 4) AS edge_density
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "fx_candidates": """
SELECT l_orderkey AS slide, concat(CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS cand_key,
  'cv' AS detector, (l_partkey*37) % 1500 AS x, (l_suppkey*53 + l_linenumber*97) % 860 AS y,
  CAST(20 + l_quantity*6 AS BIGINT) AS w, 10 + l_partkey % 40 AS h, round(0.2 + l_discount*5, 4) AS confidence FROM {lineitem}
UNION ALL
SELECT l_orderkey, concat(CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING), '_', CAST(l_linenumber AS STRING)),
  'ocr', (l_partkey*37) % 1500 + (l_suppkey % 9)*4, (l_suppkey*53 + l_linenumber*97) % 860 + (l_partkey % 5)*2,
  CAST(20 + l_quantity*6 AS BIGINT), 10 + l_partkey % 40, round(0.2 + l_tax*5, 4) FROM {lineitem}""",
    "fx_crops": """
SELECT concat('crop_', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS name, l_orderkey AS slide,
  (l_partkey*17) % 900 AS x, (l_suppkey*29) % 400 AS y,
  CAST(100 + l_quantity*20 AS BIGINT) AS w, 60 + (l_partkey % 40)*15 AS h,
  CASE l_suppkey % 12 WHEN 0 THEN 'photoreal' WHEN 1 THEN '3d' WHEN 2 THEN 'continuous_tone' WHEN 3 THEN 'text' WHEN 4 THEN 'table'
    WHEN 5 THEN 'chart' WHEN 6 THEN 'label' WHEN 7 THEN 'bullet' WHEN 8 THEN 'dense_infographic' WHEN 9 THEN 'mixed_text_visual'
    WHEN 10 THEN 'decorative' ELSE 'unspecified' END AS content_type,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE 'kept as raster' END AS reconstruction_reason,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE 'partial' END AS editable_replacement,
  CASE WHEN l_linenumber % 3 = 0 THEN true ELSE false END AS allow_large_crop,
  CASE WHEN l_suppkey % 4 = 0 THEN 'approved by owner' ELSE NULL END AS reason,
  CASE WHEN l_suppkey % 10 = 0 THEN concat('slide', CAST(l_orderkey AS STRING), '.png') ELSE concat('crop_', CAST(l_linenumber AS STRING), '.png') END AS file,
  l_partkey AS part_no, l_suppkey AS supp_no
FROM {lineitem}""",
    "fx_issues": """
SELECT user_id AS slide, event_id, ts,
  CASE event_type WHEN 'click' THEN 'edge_density_low' WHEN 'purchase' THEN 'palette_drift' WHEN 'error' THEN 'missing_content'
    WHEN 'signup' THEN 'technical_diagram_under_detailed' ELSE 'pptx_html_edge_mismatch' END AS type,
  CASE WHEN value >= 120 THEN 'blocking' WHEN value >= 60 THEN 'noticeable' ELSE 'minor' END AS severity,
  CASE event_type WHEN 'click' THEN 'native_edge_density' WHEN 'purchase' THEN 'palette_and_material_tuning'
    WHEN 'signup' THEN 'native_technical_density_then_small_non_text_crops' WHEN 'view' THEN 'helper_layout_parity' ELSE NULL END AS fix_strategy,
  CASE WHEN event_type = 'signup' THEN true ELSE false END AS crop_allowed, value, props
FROM {events}""",
    "fx_artifacts": """
SELECT doc_id AS slide, concat('work/slide', lpad(CAST(doc_id AS STRING), 2, '0'), '/', source, '.txt') AS path, text AS content,
  CASE WHEN doc_id % 11 = 0 THEN md5(concat(text, '!')) ELSE md5(text) END AS expected_md5,
  CASE WHEN doc_id % 17 = 0 THEN false ELSE true END AS present, lang, source, n_chars
FROM {documents}""",
    "fx_outputs": """
SELECT o_orderkey AS run_id, o_orderdate AS run_start, l_linenumber AS output_no, l_partkey AS part_no, l_suppkey AS supp_no, l_shipdate AS mtime
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey""",
    "fx_profiles": """
SELECT p_partkey AS id, p_brand AS background, p_type AS geometry, CAST(p_size % 5 AS STRING) AS header, substr(p_name, 1, 4) AS step_style,
  substr(md5(p_name), 1, 6) AS hex_a, substr(md5(p_brand), 1, 6) AS hex_b
FROM {part}""",
    "fx_metrics": """
SELECT slide, comparison, CAST((slide*37 + k*101) % 400 AS DOUBLE)/1000 AS pixel_difference_ratio,
  CAST((slide*53 + k*29) % 200 AS DOUBLE)/1000 AS mean_absolute_error,
  CAST((slide*71 + k*13) % 200 AS DOUBLE)/1000 AS edge_difference_ratio,
  CASE WHEN slide % 13 = 0 THEN NULL ELSE CAST((slide*91 + k*7) % 1000 AS DOUBLE)/1000 END AS approx_ssim,
  CAST((slide*17 + k*3) % 400 AS DOUBLE)/1000 AS color_palette_drift,
  CAST((slide*11 + k) % 30 - 10 AS DOUBLE)/1000 AS edge_density_delta
FROM (SELECT o_orderkey AS slide, 'pptx_vs_source' AS comparison, 1 AS k FROM {orders}
      UNION ALL SELECT o_orderkey, 'html_vs_source', 2 FROM {orders}
      UNION ALL SELECT o_orderkey, 'pptx_vs_html', 3 FROM {orders}) m""",
    "fx_signals": """
SELECT l_orderkey AS slide,
  CASE l_partkey % 4 WHEN 0 THEN 'clipping' WHEN 1 THEN 'missing_artifact' WHEN 2 THEN 'note' ELSE 'layout_break' END AS type,
  CASE WHEN l_discount >= 0.095 AND l_tax >= 0.065 THEN 'blocking' WHEN l_discount >= 0.095 THEN 'noticeable' ELSE 'minor' END AS severity
FROM {lineitem}""",
    "fx_tags": """
SELECT o_orderkey AS slide, o_orderkey % 7 = 0 AS board, o_orderkey % 5 = 1 AS stop_flow,
  o_orderkey % 3 = 0 AS technical_diagram, o_orderkey % 4 = 2 AS schematic
FROM {orders}""",
    "fx_summary": """
SELECT user_id AS slide,
  CASE WHEN max(value) >= 120 THEN 'fail' WHEN max(value) >= 60 THEN 'needs_polish' ELSE 'pass' END AS status,
  CASE WHEN max(value) >= 120 THEN 'blocking' WHEN max(value) >= 60 THEN 'noticeable' ELSE 'minor' END AS severity,
  count(*) AS issue_count,
  CAST(sum(CASE WHEN value >= 120 THEN 1 ELSE 0 END) AS BIGINT) AS blocking,
  CAST(sum(CASE WHEN value >= 60 AND value < 120 THEN 1 ELSE 0 END) AS BIGINT) AS noticeable,
  CAST(sum(CASE WHEN value < 60 THEN 1 ELSE 0 END) AS BIGINT) AS minor
FROM {events} GROUP BY user_id""",
    "fx_backgrounds": """
SELECT l_orderkey AS slide, concat('r', lpad(CAST(l_linenumber AS STRING), 3, '0')) AS region_id,
  concat(CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS region_key,
  CASE l_suppkey % 10 WHEN 0 THEN 'flat_color' WHEN 1 THEN 'panel' WHEN 2 THEN 'table_cell' WHEN 3 THEN 'rule_line'
    WHEN 4 THEN 'gradient' WHEN 5 THEN 'photo_texture' WHEN 6 THEN 'icon_area' WHEN 7 THEN 'chart_area' WHEN 8 THEN 'complex_unknown'
    ELSE 'marble' END AS background_type,
  CASE l_partkey % 6 WHEN 0 THEN 'redraw' WHEN 1 THEN 'inpaint' WHEN 2 THEN 'native_reconstruct' WHEN 3 THEN 'manual_review'
    WHEN 4 THEN 'redraw' ELSE 'erase' END AS recommended_repair,
  CASE l_partkey % 7 WHEN 0 THEN 'redraw' WHEN 1 THEN 'inpaint' WHEN 2 THEN 'native_reconstruct' WHEN 3 THEN 'manual_review'
    WHEN 4 THEN 'inpaint' WHEN 5 THEN 'redraw' ELSE 'smear' END AS repair_method,
  CASE WHEN l_partkey % 8 = 0 THEN 'fail' WHEN l_partkey % 8 = 1 THEN 'partial' ELSE 'pass' END AS status,
  CASE l_suppkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN NULL ELSE 'low' END AS residual_risk,
  CASE WHEN l_linenumber = 1 THEN '' ELSE 'checked' END AS notes
FROM {lineitem}""",
    "fx_scores": """
SELECT o_orderkey AS slide, o_orderstatus, o_orderpriority, o_custkey, o_totalprice, o_orderdate FROM {orders}""",
    "fx_trace": """
SELECT o_orderkey AS slide, o_orderkey % 23 = 0 AS enforcement_disabled, o_orderkey % 41 = 0 AS packages_missing, o_orderkey % 29 <> 0 AS invoked_by_pipeline,
  o_orderkey % 31 <> 0 AS preflight_passed, o_orderkey % 37 <> 0 AS postbuild_passed, CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE true END AS final_passed,
  CASE WHEN o_orderkey % 19 = 0 THEN 'missing' ELSE 'local' END AS mode, CASE WHEN o_orderkey % 17 = 0 THEN '/Other' ELSE '/Deck' END AS root, o_custkey AS seed
FROM {orders}""",
    "fx_visual": """
SELECT user_id AS slide, CASE WHEN user_id % 19 = 0 THEN NULL WHEN max(value) >= 120 THEN 'fail' WHEN max(value) >= 60 THEN 'needs_polish' ELSE 'pass' END AS status,
  CASE WHEN user_id % 17 = 0 THEN NULL WHEN max(value) >= 120 THEN 'blocking' WHEN max(value) >= 60 THEN 'noticeable' ELSE 'minor' END AS severity,
  CAST(sum(CASE WHEN value >= 120 THEN 1 ELSE 0 END) AS BIGINT) AS blocking, CAST(sum(CASE WHEN value >= 60 AND value < 120 THEN 1 ELSE 0 END) AS BIGINT) AS noticeable,
  max(CASE WHEN value >= 120 AND event_type = 'error' THEN 1 ELSE 0 END) = 1 AS critical, min(event_id) % 4 = 0 AS pair_mismatch,
  min(event_id) % 3 = 0 AS resize_applied, CASE WHEN min(event_id) % 6 = 0 THEN 'shared space' ELSE NULL END AS resize_reason
FROM {events} GROUP BY user_id""",
    "fx_qa": """
SELECT o_orderkey AS slide, CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'fail' ELSE NULL END AS status, CASE WHEN o_custkey % 5 = 0 THEN 'fail' ELSE 'pass' END AS visual_fidelity,
  CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 'pass' END AS native_editability, CASE WHEN o_custkey % 11 = 0 THEN 'warn' ELSE 'pass' END AS crop_policy,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS BIGINT) END AS blocking_count, o_orderkey % 17 = 0 AS minor_missing,
  CASE o_orderkey % 6 WHEN 0 THEN 'checks not  run yet' WHEN 1 THEN 'QA pending' WHEN 2 THEN 'an approximate pass' ELSE 'all compared' END AS report,
  CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE 'qa_evidence.json' END AS evidence, o_orderkey % 3 = 0 AS has_raster, o_orderkey % 5 = 0 AS has_html,
  CASE WHEN o_custkey % 10 = 3 THEN NULL WHEN o_custkey % 2 = 0 THEN 'Manual' ELSE 'auto' END AS method, CASE WHEN o_custkey % 4 = 0 THEN ' ' ELSE 'looked at it' END AS method_notes
FROM {orders}""",
    "fx_receipts": """
SELECT o_orderkey AS slide, CASE WHEN o_orderkey % 29 = 0 THEN o_orderkey + 1 WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderkey END AS receipt_slide,
  CASE WHEN o_custkey % 9 = 0 THEN 'somebody' ELSE 'slide_reconstruct_worker' END AS worker, CASE o_orderstatus WHEN 'P' THEN 'partial' ELSE 'completed' END AS status,
  CASE WHEN o_custkey % 8 = 0 THEN NULL WHEN o_custkey % 8 = 1 THEN true ELSE false END AS shared_files_edited, o_orderkey % 31 = 0 AS no_list, o_orderkey % 10 AS skip, o_custkey % 6 AS part
FROM {orders}""",
    "fx_captures": """
SELECT doc_id AS slide, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 1600 ELSE 1672 END AS actual_width, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 941 END AS actual_height,
  CASE WHEN doc_id % 11 = 0 THEN 2 ELSE 1 END AS scale, doc_id % 9 <> 0 AS qa_static, doc_id % 17 = 0 AS modified_html, CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN 800 ELSE 1672 END AS viewport_width, 941 AS viewport_height,
  md5(text) AS html_sha, CASE WHEN lang = 'de' THEN md5(concat(text, ' ')) ELSE md5(text) END AS current_html_sha, md5(source) AS output_sha, CASE WHEN doc_id % 23 = 0 THEN NULL ELSE md5(source) END AS current_output_sha
FROM {documents}""",
    "fx_states": """
SELECT c_custkey AS deck, CASE WHEN c_custkey % 17 = 0 THEN '0.2.0' ELSE '0.1.0' END AS schema_version, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE '/deck' END AS project_root,
  CASE c_custkey % 5 WHEN 0 THEN 'canary' WHEN 1 THEN 'blocking-zero' WHEN 2 THEN 'polish' WHEN 3 THEN 'strict' ELSE 'loose' END AS quality_level,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'a' END AS pptx, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'b' END AS html, c_name AS summary_file, CASE WHEN c_nationkey = 3 THEN NULL ELSE 'd' END AS trace_file,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 3 AS BIGINT) END AS fail_slides
FROM {customer}""",
    "fx_deck_slides": """
SELECT o_custkey AS deck, o_orderkey AS slide, CASE o_orderstatus WHEN 'O' THEN 'pass' WHEN 'F' THEN 'needs_polish' ELSE 'fail' END AS status,
  CASE o_orderstatus WHEN 'O' THEN 'minor' WHEN 'F' THEN 'noticeable' ELSE 'blocking' END AS severity, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 ELSE 0 END AS BIGINT) AS blocking
FROM {orders}""",
    "fx_calibration": """
SELECT p_partkey AS slide, CASE WHEN p_partkey % 41 = 0 THEN 'not json' ELSE concat('{{"schemaVersion":"', CASE WHEN p_size % 10 = 0 THEN 'other' ELSE 'slide-visual-polish-qa.calibration-profile.v1' END,
  '","knownGoodMetricBands":{{"sourceRenderSimilarity":{{"pixelMax":0.21,"maeMax":', CASE WHEN p_size % 7 = 0 THEN 'true' ELSE '0.105' END, ',"edgeMax":0.115,"ssimMin":0.6,"paletteMax":0.15}},"pptxHtmlConsistency":{{"pixelMax":0.11,"maeMax":0.055,"edgeMax":0.09,"ssimMin":0.79,"paletteMax":0.055}}}},',
  '"borderlineMetricBands":{{"sourceRenderSimilarity":{{"pixelMax":0.24,"maeMax":0.13,"edgeMax":0.135,"ssimMin":0.44,"paletteMax":', CASE WHEN p_size % 6 = 0 THEN '"0.23"' ELSE '0.23' END, '}}', CASE WHEN p_size % 9 = 0 THEN '' ELSE ',"pptxHtmlConsistency":{{"pixelMax":0.13,"maeMax":0.065,"edgeMax":0.09,"ssimMin":0.74,"paletteMax":0.07}}' END,
  '}},"knownBadMetricBands":{{"sourceRenderSimilarity":{{"pixelMin":0.25,"maeMin":0.14,"edgeMin":0.145,"ssimMax":0.42,"paletteMin":0.28', CASE WHEN p_size % 11 = 0 THEN '' ELSE ',"requiredSignalsForBlocking":2' END, '}},"pptxHtmlConsistency":{{"pixelMin":0.13,"maeMin":0.065,"edgeMin":0.095,"ssimMax":0.72,"paletteMin":0.08,"requiredSignalsForBlocking":3}}}}}}') END AS profile, p_size
FROM {part}""",
}

# Texts for the engine whose arrays and lambdas are written differently.
DUCK = {
    "fx_pixels": """
SELECT slide, i%8 AS x, i//8 AS y,
  floor(a0*255)::BIGINT sr, floor(a1*255)::BIGINT sg, floor(a2*255)::BIGINT sb,
  floor(((1-wt)*a0+wt*b0)*255)::BIGINT rr, floor(((1-wt)*a1+wt*b1)*255)::BIGINT rg, floor(((1-wt)*a2+wt*b2)*255)::BIGINT rb
FROM (SELECT e.vec_id AS slide, i, e.v[i+1] a0, e.v[(i+1)%64+1] a1, e.v[(i+2)%64+1] a2,
             p.v[i+1] b0, p.v[(i+1)%64+1] b1, p.v[(i+2)%64+1] b2, (e.vec_id%5)*0.15::DOUBLE AS wt
      FROM (SELECT vec_id, list_transform(embedding, lambda v: least(greatest(v::DOUBLE + 0.5, 0.0), 1.0)) AS v FROM embeddings) e
      JOIN (SELECT count(*) AS n FROM embeddings) n ON true
      JOIN (SELECT vec_id, list_transform(embedding, lambda v: least(greatest(v::DOUBLE + 0.5, 0.0), 1.0)) AS v FROM embeddings) p
        ON p.vec_id=(e.vec_id+1)%n.n, range(64) r(i)) px""",
    "fx_surfaces": """
SELECT slide, 'source' AS surface, x, y, sr AS r, sg AS g, sb AS b FROM fx_pixels
UNION ALL SELECT slide, 'pptx', x, y, rr, rg, rb FROM fx_pixels
UNION ALL SELECT slide, 'html', x, y, (sr+rr)//2, (sg+rg)//2, (sb+rb)//2 FROM fx_pixels""",
    "fx_pairs": """
SELECT slide, 'pptx_vs_source' AS comparison, x, y, sr, sg, sb, rr, rg, rb FROM fx_pixels
UNION ALL SELECT slide, 'html_vs_source', x, y, sr, sg, sb, (sr+rr)//2, (sg+rg)//2, (sb+rb)//2 FROM fx_pixels
UNION ALL SELECT slide, 'pptx_vs_html', x, y, rr, rg, rb, (sr+rr)//2, (sg+rg)//2, (sb+rb)//2 FROM fx_pixels""",
    "fx_boxes8": """
SELECT slide, id, least(x, 7) AS x, least(y, 7) AS y, w, h FROM (
  SELECT e.vec_id AS slide, concat('b', CAST(k AS VARCHAR)) AS id, (e.vec_id*3 + k*5) % 7 AS x, (e.vec_id*5 + k*3) % 7 AS y,
         1 + (e.vec_id + k) % 4 AS w, 1 + (e.vec_id*2 + k) % 3 AS h
  FROM embeddings e, range(3) r(k)) q""",
    "fx_objects": """
SELECT slide, ord, tag, CASE tag WHEN 'p' THEN 'text' WHEN 'h1' THEN 'text' WHEN 'li' THEN 'text' WHEN 'title' THEN 'text'
   WHEN 'b' THEN 'badge' WHEN 'a' THEN 'icon' WHEN 'br' THEN 'rule' WHEN 'div' THEN 'panel' WHEN 'article' THEN 'panel'
   WHEN 'nav' THEN 'table' WHEN 'ul' THEN 'chart' WHEN 'footer' THEN 'callout' WHEN 'script' THEN 'image' ELSE NULL END AS type,
  ord*7.12345 AS x, CASE WHEN ord % 9 = 0 THEN CAST('nan' AS DOUBLE) ELSE ord*3.5 END AS y,
  CAST((ord*37) % 400 - 20 AS DOUBLE) AS w, CAST((ord*11) % 60 - 5 AS DOUBLE) AS h, txt,
  CASE WHEN tag IN ('script','style') THEN false WHEN ord % 6 = 0 THEN NULL ELSE true END AS editable
FROM (SELECT page_id AS slide, unnest(g1) AS tag, unnest(g3) AS txt, CAST(generate_subscripts(g1, 1) - 1 AS BIGINT) AS ord
      FROM (SELECT page_id, regexp_extract_all(html, '<(p|h1|li|title|b|a|br|div|article|nav|ul|footer|script|style)( [^>]*)?>([^<]*)', 1) AS g1,
                   regexp_extract_all(html, '<(p|h1|li|title|b|a|br|div|article|nav|ul|footer|script|style)( [^>]*)?>([^<]*)', 3) AS g3 FROM pages) a) o""",
    "fx_links": """
SELECT pkg, page_id, ord, target FROM (
  SELECT regexp_extract(url, '://([^/]*)/', 1) AS pkg, page_id, unnest(t) AS target, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS ord
  FROM (SELECT url, page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS t FROM pages) a) b""",
}

_NEEDS = {"fx_surfaces": ["fx_pixels"], "fx_pairs": ["fx_pixels"]}

OBJECT_PATTERN = "<(p|h1|li|title|b|a|br|div|article|nav|ul|footer|script|style)( [^>]*)?>([^<]*)"
OBJECT_TYPE = {"p": "text", "h1": "text", "li": "text", "title": "text", "b": "badge", "a": "icon", "br": "rule",
               "div": "panel", "article": "panel", "nav": "table", "ul": "chart", "footer": "callout", "script": "image"}


def duck_text(name: str) -> str:
    if name in BOTH:
        return BOTH[name].format(**{t: t for t in TABLES})
    return DUCK[name]


def with_fixtures(names: list[str], body: str) -> str:
    """Prefix a DuckDB text with the fixture definitions it reads."""
    order: list[str] = []
    for name in names:
        for need in [*_NEEDS.get(name, []), name]:
            if need not in order:
                order.append(need)
    head = ",\n".join(f"{n} AS ({duck_text(n)})" for n in order)
    body = body.strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:].strip()}"
    return f"WITH {head}\n{body}"


class Tables:
    """The driver's tables and the evidence tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in BOTH:
            text = BOTH[name]
            used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in text}
            return self.spark.sql(text, **used)
        raise AttributeError(name)

    @property
    def fx_pixels(self) -> DataFrame:
        """8x8 rasters; the render blends a vector with the next one."""
        unit = self.embeddings.select(
            F.col("vec_id"),
            F.transform("embedding", lambda v: F.least(F.greatest(v.cast("double") + 0.5, F.lit(0.0)), F.lit(1.0))).alias("v"))
        total = self.embeddings.agg(F.count(F.lit(1)).alias("n")).scalar()
        near = unit.select(F.col("vec_id").alias("slide"), F.col("v").alias("a"), ((F.col("vec_id") + 1) % total).alias("next_id"))
        other = unit.select(F.col("vec_id").alias("next_id"), F.col("v").alias("b"))
        px = (near.join(other, "next_id")
              .select("slide", "a", "b", ((F.col("slide") % 5) * F.lit(0.15)).alias("wt"),
                      F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")))

        def at(arr, k):
            return F.get(F.col(arr), (F.col("i") + k) % 64)

        def mixed(k):
            return F.floor(((1 - F.col("wt")) * at("a", k) + F.col("wt") * at("b", k)) * 255)

        return px.select("slide", (F.col("i") % 8).cast("bigint").alias("x"), F.floor(F.col("i") / 8).alias("y"),
                         *[F.floor(at("a", k) * 255).alias(n) for k, n in enumerate(["sr", "sg", "sb"])],
                         *[mixed(k).alias(n) for k, n in enumerate(["rr", "rg", "rb"])])

    @property
    def fx_surfaces(self) -> DataFrame:
        """Long form: one row per (slide, surface, pixel)."""
        def half(a, b):
            return F.floor((F.col(a) + F.col(b)) / 2)

        def face(name, r, g, b):
            return F.struct(F.lit(name).alias("surface"), r.alias("r"), g.alias("g"), b.alias("b"))

        return (self.fx_pixels.select("slide", "x", "y", F.explode(F.array(
            face("source", F.col("sr"), F.col("sg"), F.col("sb")),
            face("pptx", F.col("rr"), F.col("rg"), F.col("rb")),
            face("html", half("sr", "rr"), half("sg", "rg"), half("sb", "rb")))).alias("f"))
            .select("slide", "f.surface", "x", "y", "f.r", "f.g", "f.b"))

    @property
    def fx_boxes8(self) -> DataFrame:
        k = F.col("k")
        e = self.embeddings.select(F.col("vec_id").alias("slide"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
        return e.select("slide", F.concat(F.lit("b"), k.cast("string")).alias("id"),
                        ((F.col("slide") * 3 + k * 5) % 7).cast("bigint").alias("x"),
                        ((F.col("slide") * 5 + k * 3) % 7).cast("bigint").alias("y"),
                        (1 + (F.col("slide") + k) % 4).cast("bigint").alias("w"),
                        (1 + (F.col("slide") * 2 + k) % 3).cast("bigint").alias("h"))

    @property
    def fx_objects(self) -> DataFrame:
        """Native objects: one per opening tag of a page."""
        from .functions.columns import lookup
        found = self.pages.select(F.col("page_id").alias("slide"), F.posexplode(F.arrays_zip(
            F.regexp_extract_all("html", F.lit(OBJECT_PATTERN), 1).alias("tag"),
            F.regexp_extract_all("html", F.lit(OBJECT_PATTERN), 3).alias("txt"))).alias("ord", "o"))
        n = F.col("ord")
        tag = F.col("o.tag")
        return found.select(
            "slide", n.cast("bigint").alias("ord"), tag.alias("tag"), lookup(tag, OBJECT_TYPE).alias("type"),
            (n * F.lit(7.12345)).alias("x"), F.when(n % 9 == 0, F.lit(float("nan"))).otherwise(n * F.lit(3.5)).alias("y"),
            ((n * 37) % 400 - 20).cast("double").alias("w"), ((n * 11) % 60 - 5).cast("double").alias("h"),
            F.col("o.txt").alias("txt"),
            F.when(tag.isin("script", "style"), F.lit(False)).when(n % 6 == 0, F.lit(None).cast("boolean"))
            .otherwise(F.lit(True)).alias("editable"))

    @property
    def fx_links(self) -> DataFrame:
        return (self.pages.select(F.regexp_extract("url", "://([^/]*)/", 1).alias("pkg"), "page_id",
                                  F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("ord", "target"))
                .select("pkg", "page_id", F.col("ord").cast("bigint").alias("ord"), "target"))
