"""Queries of the rule gates."""

from pyspark.sql import functions as F

from .. import vocab
from ..operators import evidence as ev
from ..operators import gates as gt
from ..operators import texts as tx
from .evidence import CLAIMS_SQL, COVERAGE_SQL, HASHES_SQL, claims, hashes
from .registry import query, sql_list
from .texts import EXC, FIX_CTE, LINT_CTE, crops_with_exceptions, fix_texts

c = F.col
COLS = ["gate", "slide", "id", "rule", "level"]


def violations(gate, source, ident, rules):
    """SQL of a gate: one SELECT per rule."""
    return "\nUNION ALL ".join(
        f"SELECT '{gate}' AS gate, slide::BIGINT AS slide, CAST({ident} AS VARCHAR) AS id, '{rule}' AS rule, '{level}' AS level FROM {source} WHERE {cond}" for cond, rule, level in rules)


E = "error"
REGION_SQL = violations("text_regions", "fx_regions", "region_key", [
    ("ocr_text <> '' AND notes = ''", "ocr_without_notes", "warning"), ("class = 'semantic_text' AND corrected_text = ''", "semantic_without_text", E),
    ("class = 'semantic_text' AND previous_class = 'pseudo_text' AND NOT promotion_approved", "silent_promotion", E),
    ("class IN ('pseudo_text', 'decorative_glyph') AND corrected_text <> ''", "pseudo_with_text", E), ("class IN ('pseudo_text', 'decorative_glyph') AND native_text <> ''", "pseudo_with_native_text", E),
    ("class = 'unknown_text' AND NOT (exception_approved AND exception_reason <> '')", "unknown_unresolved", E)]) + """
UNION ALL SELECT 'text_regions', slide, region_key, 'duplicate_id', 'error' FROM (SELECT slide, region_key, row_number() OVER (PARTITION BY slide, id ORDER BY region_key) AS n FROM fx_regions) q WHERE n > 1"""


@query("gate_text_regions", REGION_SQL, "fx_regions")
def _(t):
    return gt.gate_text_regions(t.fx_regions).select(*COLS)


@query("gate_text_regions_status", f"""WITH v AS ({REGION_SQL}) SELECT gate, slide, count(*) FILTER (level='error') AS errors, count(*) FILTER (level='warning') AS warnings,
  CASE WHEN count(*) FILTER (level='error') > 0 THEN 'fail' ELSE 'pass' END AS status FROM (SELECT 'text_regions' AS gate, slide, v.level FROM (SELECT DISTINCT slide FROM fx_regions) s LEFT JOIN v USING (slide)) q GROUP BY gate, slide""", "fx_regions")
def _(t):
    return gt.gate_status(gt.gate_text_regions(t.fx_regions), t.fx_regions, "text_regions")


@query("gate_background_repair", violations("background_repair", "fx_backgrounds", "region_key", [
    ("background_type = 'marble'", "invalid_background_type", E), ("recommended_repair = 'erase'", "invalid_recommendation", E), ("repair_method = 'smear'", "invalid_repair_method", E),
    ("(background_type IN ('flat_color','panel','table_cell') OR recommended_repair = 'redraw') AND repair_method = 'inpaint'", "must_redraw", E),
    ("background_type = 'complex_unknown' AND status = 'pass' AND (repair_method = 'inpaint' OR notes = '')", "unknown_passed_without_evidence", E)]), "fx_backgrounds")
def _(t):
    return gt.gate_background_repair(t.fx_backgrounds).select(*COLS)


@query("gate_residual", violations("residual", "fx_backgrounds", "region_key", [
    ("coalesce(residual_risk, 'high') = 'high'", "risk_above_max", E), ("residual_risk = 'medium'", "medium_needs_review", "warning"), ("status = 'fail'", "report_failed", E)]), "fx_backgrounds")
def _(t):
    return gt.gate_residual(t.fx_backgrounds).select(*COLS)


TEXTUAL = sql_list(vocab.TEXTUAL_TYPES)


@query("gate_crop_manifest", violations("crop_manifest", "fx_crops", "name", [
    ("reconstruction_reason IS NULL", "missing_reconstruction_reason", E), ("editable_replacement IS NULL", "missing_editable_replacement", E),
    ("(w*h)::DOUBLE/630000 > 0.85 AND NOT (allow_large_crop AND reason IS NOT NULL)", "large_without_reason", E),
    ("(w*h)::DOUBLE/630000 > 0.65 AND regexp_matches(file, 'slide[0-9]+\\.png$')", "reuses_source_image", E),
    (f"content_type IN ({TEXTUAL}) AND reason IS NULL AND reconstruction_reason IS NULL", "text_without_reason", E)]), "fx_crops")
def _(t):
    return gt.gate_crop_manifest(t.fx_crops, 900, 700).select(*COLS)


BUDGET_SQL = (f"WITH cv AS ({COVERAGE_SQL}), {EXC}, il AS (SELECT DISTINCT o_orderkey AS slide FROM orders WHERE o_orderpriority = '2-HIGH')\n"
              + violations("crop_budget", "cv", "slide", [("largest_ratio > 0.35", "largest_over_budget", E), ("total_ratio > 0.45 AND slide NOT IN (SELECT slide FROM il)", "total_over_budget", E),
                                                      ("text_ratio > 0.10", "text_over_budget", E), ("dense_ratio > 0.25", "dense_over_budget", E)]) + "\nUNION ALL "
              + violations("crop_budget", "ex", "name", [("reconstruction_reason IS NULL OR editable_replacement IS NULL", "incomplete_metadata", E),
                                                  (f"content_type IN ({TEXTUAL}) AND NOT excused", "textual_without_exception", E)]))


@query("gate_crop_budget", BUDGET_SQL, "fx_crops")
def crop_budget(t):
    led = t.orders.where("o_orderpriority = '2-HIGH'").select(c("o_orderkey").alias("slide")).distinct()
    return gt.gate_crop_budget(ev.crop_coverage(t.fx_crops), tx.textual_crop_excused(crops_with_exceptions(t)), led).select(*COLS)


OTHER_FIELDS = [f for f in vocab.TRACE_FIELDS if f not in ("projectRoot", "dependencyResolutionMode")]
TRACE_SQL = violations("trace", "fx_trace", "slide", [(f"(seed + {i}) % 37 = 0", "missing_" + f, E) for i, f in enumerate(OTHER_FIELDS)] + [
    ("enforcement_disabled", "enforcement_disabled", E), ("mode = 'missing'", "dependencies_unresolved", E), ("packages_missing", "missing_packages", E),
    ("NOT invoked_by_pipeline", "not_invoked_by_pipeline", E), ("NOT preflight_passed", "preflight_not_passed", E), ("NOT postbuild_passed", "postbuild_not_passed", E),
    ("final_passed IS NULL", "final_not_passed", E), ("root = '/Other'", "project_root_differs", E)])


@query("gate_trace", TRACE_SQL, "fx_trace")
def _(t):
    entries = [F.struct(F.lit(f).alias("k"), F.when((c("seed") + i) % 37 != 0, F.lit("set")).alias("v")) for i, f in enumerate(OTHER_FIELDS)]
    entries += [F.struct(F.lit("projectRoot").alias("k"), c("root").alias("v")), F.struct(F.lit("dependencyResolutionMode").alias("k"), c("mode").alias("v"))]
    rows = t.fx_trace.withColumns({"fields": F.map_from_entries(F.array(*entries)), "expected_root": F.lit("/deck"), "missing_packages": c("packages_missing").cast("int")})
    return gt.gate_trace(rows).select(*COLS)


HOT = "(coalesce(severity, 'blocking') = 'blocking' OR coalesce(status, 'fail') = 'fail' OR blocking > 0)"
NOT = "(coalesce(severity, '') = 'noticeable' OR coalesce(status, '') = 'needs_polish' OR noticeable > 0)"
RESIZE = ("resize_applied AND resize_reason IS NULL", "unrecorded_resize", E)


@query("gate_visual_mode", "\nUNION ALL ".join([
    violations("visual_mode_qa-draft", "fx_visual", "slide", [("critical", "critical_issue", E), (f"NOT critical AND ({HOT} OR {NOT})", "allowed_in_draft", "warning"), RESIZE]),
    violations("visual_mode_qa-polish", "fx_visual", "slide", [(HOT, "blocking_left", E), (f"NOT {HOT} AND {NOT}", "needs_polish", "warning"), RESIZE]),
    violations("visual_mode_qa-strict", "fx_visual", "slide", [(f"{HOT} OR {NOT}", "not_clean", E), ("pair_mismatch", "pair_mismatch", E), RESIZE])]), "fx_visual")
def _(t):
    v = t.fx_visual
    return gt.gate_visual_mode(v, "qa-draft").unionByName(gt.gate_visual_mode(v, "qa-polish")).unionByName(gt.gate_visual_mode(v, "qa-strict")).select(*COLS)


@query("gate_fix_plan", f"""WITH {FIX_CTE},
pl AS (SELECT * FROM ft WHERE fix_strategy IS NOT NULL), hp AS (SELECT * FROM pl WHERE severity IN ('blocking', 'noticeable')),
fi AS (SELECT slide, count(*) FILTER (severity IN ('blocking', 'noticeable')) AS n FROM fx_issues GROUP BY slide), pn AS (SELECT slide, count(*) FILTER (severity IN ('blocking', 'noticeable')) AS planned FROM pl GROUP BY slide),
sl AS (SELECT s.slide, s.status, s.severity, coalesce(fi.n, 0) AS n, pn.planned FROM fx_summary s LEFT JOIN fi USING (slide) LEFT JOIN pn USING (slide)),
{LINT_CTE}
""" + violations("fix_plan", "sl", "slide", [("(status IN ('fail','needs_polish') OR severity IN ('blocking','noticeable')) AND planned IS NULL", "plan_missing", E), ("planned < n", "plan_incomplete", E)]) + "\nUNION ALL "
       + violations("fix_plan", "hp", "id", [("event_id % 14 = 0", "fix_unusable", E), ("event_id % 10 = 0", "auto_apply_not_false", E)])
       + "\nUNION ALL SELECT 'fix_plan', fl.slide, fl.id, fl.rule, 'error' FROM fl JOIN hp ON hp.id = fl.id", "fx_issues fx_summary")
def _(t):
    fixes = fix_texts(t).where("fix_strategy IS NOT NULL").withColumns({
        "region_x": F.when(c("event_id") % 14 != 0, F.lit(1)), "safe_to_auto_apply": F.when(c("event_id") % 10 != 0, F.lit(False))})
    return gt.gate_fix_plan(t.fx_summary, t.fx_issues, fixes).select(*COLS)


QA_SQL = violations("qa_result", "fx_qa", "slide", [(f"{f} IS DISTINCT FROM 'pass'", f + "_not_pass", E) for f in ("status", "visual_fidelity", "native_editability", "crop_policy")] + [
    ("blocking_count IS NULL", "blocking_issues_not_a_list", E), ("minor_missing", "minor_issues_not_a_list", E), ("blocking_count > 0", "blocking_issues_left", E),
    ("slide % 6 IN (0, 1, 2)", "draft_wording", E), ("evidence = ''", "evidence_not_referenced", E),
    ("NOT has_raster AND NOT has_html AND NOT (coalesce(method, '') = 'Manual' AND trim(method_notes) <> '')", "no_image_needs_manual_notes", E)])


def qa_results(t):
    empty = F.array().cast("array<string>")
    return t.fx_qa.withColumns({
        "blocking_issues": F.when(c("blocking_count").isNotNull(), F.array_repeat(F.lit("b"), c("blocking_count").cast("int"))),
        "noticeable_issues": empty, "minor_issues": F.when(~c("minor_missing"), empty)})


@query("gate_qa_result", QA_SQL, "fx_qa")
def _(t):
    return gt.gate_qa_result(qa_results(t)).select(*COLS)


RECEIPT_SQL = violations("receipts", "fx_receipts", "slide", [
    ("slide IS DISTINCT FROM receipt_slide", "wrong_slide", E), ("worker = 'somebody'", "wrong_worker", E), ("status <> 'completed'", "not_completed", E),
    ("coalesce(shared_files_edited, true)", "shared_files_edited", E), ("no_list", "artifacts_not_a_list", E)]
    + [(f"no_list OR skip = {i}", "missing_" + n, E) for i, n in enumerate(vocab.RECEIPT_ARTIFACTS)] + [("no_list OR part = 5", "missing_fragment", E)])


def receipts(t):
    names = [F.when(c("skip") != i, F.lit(n)) for i, n in enumerate(vocab.RECEIPT_ARTIFACTS)]
    names.append(F.when(c("part") != 5, F.concat(F.lit("s"), c("slide").cast("string"), F.lit(".fragment.js"))))
    return t.fx_receipts.withColumn("artifacts", F.when(~c("no_list"), F.array_compact(F.array(*names))))


@query("gate_receipts", RECEIPT_SQL, "fx_receipts")
def _(t):
    return gt.gate_receipts(receipts(t)).select(*COLS)


QUALITY = "CASE o_custkey % 4 WHEN 0 THEN 'canary' WHEN 1 THEN 'preservation' WHEN 2 THEN 'reconstruction' ELSE 'draft' END"
HELD = ["baked_crop_regions.json"] + vocab.RECONSTRUCTION_ARTIFACTS


@query("gate_quality_mode", f"""WITH q AS (SELECT o_orderkey AS slide, {QUALITY} AS quality FROM orders), h AS (SELECT [{sql_list(HELD)}] AS ks),
p AS (SELECT DISTINCT l_orderkey AS slide, ks[(l_linenumber*5 + l_partkey) % {len(HELD)} + 1] AS kind FROM lineitem, h), r AS (SELECT [{sql_list(vocab.RECONSTRUCTION_ARTIFACTS)}] AS ks),
g AS (SELECT slide, kind AS id FROM (SELECT slide, unnest(ks) AS kind FROM q, r WHERE quality = 'reconstruction') e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.slide = e.slide AND p.kind = e.kind)),
rc AS ({RECEIPT_SQL}), qa AS ({QA_SQL}), bu AS ({BUDGET_SQL}), cm AS ({CLAIMS_SQL}), hs AS ({HASHES_SQL})
""" + violations("quality_mode", "q", "slide", [
    ("quality = 'canary' AND NOT EXISTS (SELECT 1 FROM p WHERE p.slide = q.slide)", "no_artifacts", "warning"),
    ("quality = 'preservation' AND NOT EXISTS (SELECT 1 FROM p WHERE p.slide = q.slide AND kind = 'baked_crop_regions.json')", "missing_crop_disclosure", E),
    ("quality = 'preservation' AND NOT EXISTS (SELECT 1 FROM p WHERE p.slide = q.slide AND kind = 'editability_inventory.md')", "missing_inventory_disclosure", E),
    ("quality = 'draft'", "invalid_quality", E)]) + """
UNION ALL SELECT 'quality_mode', slide, id, 'missing_artifact', 'error' FROM g
UNION ALL SELECT 'quality_mode', v.slide, id, gate || '_' || rule, 'error' FROM (SELECT gate, slide, id, rule, level FROM rc UNION ALL SELECT gate, slide, id, rule, level FROM qa UNION ALL SELECT gate, slide, id, rule, level FROM bu
  UNION ALL SELECT 'claims', slide, metric, rule, 'error' FROM cm UNION ALL SELECT 'hashes', slide, CAST(slide AS VARCHAR), 'hashes_invalid', 'error' FROM hs WHERE NOT hashes_valid) v
  JOIN q ON q.slide = v.slide WHERE quality = 'reconstruction' AND level = 'error'""", "fx_qa fx_receipts fx_crops fx_artifacts")
def _(t):
    slides = t.orders.select(c("o_orderkey").alias("slide"), F.expr(QUALITY).alias("quality"))
    present = t.lineitem.select(c("l_orderkey").alias("slide"), F.get(F.array(*map(F.lit, HELD)), ((c("l_linenumber") * 5 + c("l_partkey")) % len(HELD)).cast("int")).alias("kind"))
    counted = gt.relabel(claims(t), "claims", c("rule"), "error", "metric")
    hashed = gt.relabel(hashes(t).where("NOT hashes_valid"), "hashes", "hashes_invalid", "error", "slide")
    return gt.gate_quality_mode(slides, present, [gt.gate_receipts(receipts(t)), gt.gate_qa_result(qa_results(t)), crop_budget(t), counted, hashed]).select(*COLS)


@query("gate_orchestration", """WITH s AS (SELECT deck, count(*) FILTER (status = 'fail' OR severity = 'blocking' OR blocking > 0) AS b, count(*) FILTER (status = 'needs_polish') AS n, count(*) FILTER (slide <= 0) AS z FROM fx_deck_slides GROUP BY deck),
d AS (SELECT f.*, f.deck AS slide, b, n, z FROM fx_states f LEFT JOIN s ON s.deck = f.deck)
""" + violations("orchestration", "d", "deck", [
    ("schema_version <> '0.1.0'", "unsupported_schema", E), ("project_root = ''", "project_root_missing", E), ("quality_level = 'loose'", "unsupported_quality_level", E), ("z > 0", "slides_not_positive", E),
    ("quality_level <> 'canary' AND b > 0", "blocking_slides_remain", E), ("quality_level = 'strict' AND n > 0", "polish_slides_remain", E),
    ("b IS NULL AND quality_level <> 'canary' AND fail_slides > 0", "state_has_fail_slides", E), ("b IS NULL AND quality_level <> 'canary' AND fail_slides IS NULL", "summary_missing", E)]
    + [(f"{a} IS NULL", "artifact_missing_" + a, E) for a in ("pptx", "html", "summary_file", "trace_file")]), "fx_states fx_deck_slides")
def _(t):
    return gt.gate_orchestration(t.fx_states, t.fx_deck_slides).select(*COLS)


CAL_RULES = [("NOT json_valid(profile)", "unreadable", E), ("json_valid(profile) AND json_extract_string(j, '$.schemaVersion') IS DISTINCT FROM '" + vocab.CALIBRATION_SCHEMA + "'", "wrong_schema", E)] + [
    (f"json_valid(profile) AND coalesce(json_type(j, '$.{g}.{k}.{f}') IN ('DOUBLE', 'UBIGINT', 'BIGINT'), false) = false", f"not_numeric_{g}.{k}.{f}", E)
    for g, fields in gt.BAND_FIELDS.items() for k in (vocab.SOURCE_KIND, vocab.PAIR_KIND) for f in fields]


@query("gate_calibration_profile", "WITH pj AS (SELECT slide, profile, CASE WHEN json_valid(profile) THEN profile::JSON END AS j FROM fx_calibration)\n" + violations("calibration_profile", "pj", "slide", CAL_RULES), "fx_calibration")
def _(t):
    return gt.gate_calibration_profile(t.fx_calibration).select(*COLS)


@query("gate_worker_package", violations("worker_package", "(SELECT p_partkey AS slide, p_size, p_brand FROM part) pk", "slide", [
    ("p_size % 9 = 0", "canvas_size_missing", E), ("p_brand = 'Brand#3'", "profile_id_missing", E), ("p_size % 8 = 0", "confidence_missing", E), ("p_size % 5 = 0 OR p_size % 7 = 0", "fragment_function", E)]) + "\nUNION ALL "
    + violations("worker_package", "fx_crops", "CASE WHEN supp_no % 20 = 0 THEN '' ELSE name END", [("supp_no % 20 = 0", "crop_name_missing", E), ("supp_no % 30 = 0", "crop_x_not_numeric", E)]), "fx_crops")
def _(t):
    p = t.part.withColumnRenamed("p_partkey", "slide")
    head = p.select("slide", F.when(c("p_size") % 9 != 0, 1672).alias("canvas_width"), F.lit(941).alias("canvas_height"),
                    F.when(c("p_brand") != "Brand#3", c("p_brand")).alias("profile_id"), F.when(c("p_size") % 8 != 0, "high").alias("confidence"))
    fn = F.concat(F.lit("function s"), F.when(c("p_size") % 7 == 0, c("slide") + 1).otherwise(c("slide")).cast("string"), F.lit("(s){ K.text(s) }"),
                  F.when(c("p_size") % 5 == 0, " function helper ( s ) {}").otherwise(" function other(a) {}"))
    crops = t.fx_crops.select("slide", F.when(c("supp_no") % 20 == 0, "").otherwise(c("name")).alias("name"),
                              F.when(c("supp_no") % 30 == 0, "wide").otherwise(c("x").cast("string")).alias("x"), *[c(n).cast("string").alias(n) for n in "ywh"])
    return gt.gate_worker_package(head, crops, p.select("slide", fn.alias("source"))).select(*COLS)


@query("gate_captures", violations("captures", "fx_captures", "slide", [
    ("actual_width IS NULL", "dimensions_unreadable", E), ("actual_width = 1600", "dimensions_differ", E), ("scale = 2", "scale_not_one", E), ("NOT qa_static", "not_static", E), ("modified_html", "modified_html", E),
    ("viewport_width IS DISTINCT FROM 1672", "viewport_differs", E), ("html_sha <> current_html_sha", "html_changed", E), ("current_output_sha IS NULL", "image_changed", E)]), "fx_captures")
def _(t):
    return gt.gate_captures(t.fx_captures, 1672, 941).select(*COLS)
