"""Rule gates: expectation tables over evidence.

A gate is a list of (condition, rule name, level). Every rule of a gate is tested
in one pass over its rows; a row yields one output row per rule it breaks. A gate
fails for a slide when any error is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.columns import blank, rank_of
from .evidence import duplicates
from .texts import lint_fix_text

c = F.col
Rule = tuple[Column, str, str]


def apply_rules(rows: DataFrame, gate: str, rules: list[Rule], id_column: str | Column = "id") -> DataFrame:
    """Rows ``gate, slide, id, rule, level, message`` for every broken rule."""
    ident = c(id_column) if isinstance(id_column, str) else id_column
    marks = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level")))
                      for cond, rule, level in rules])
    # a plain list stays in generated code and is made once; a compacted one is made a second time by the filter that Spark infers for it
    hits = rows.select("slide", ident.cast("string").alias("id"), F.explode(marks).alias("r")).where("r IS NOT NULL")
    return _shape(hits.select(F.lit(gate).alias("gate"), "slide", "id", "r.rule", "r.level"))


def _shape(hits: DataFrame) -> DataFrame:
    text = F.concat_ws(": ", "id", F.replace("rule", F.lit("_"), F.lit(" ")))
    return hits.select("gate", "slide", "id", "rule", "level", text.alias("message"))


def relabel(rows: DataFrame, gate: str, rule: Column | str, level: str = "error", id_column: str = "id") -> DataFrame:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return _shape(rows.select(F.lit(gate).alias("gate"), "slide", c(id_column).cast("string").alias("id"), rule.alias("rule"), F.lit(level).alias("level")))


def gate_status(violations: DataFrame, slides: DataFrame | None = None, gate: str | None = None) -> DataFrame:
    """pass / fail per gate and slide; with ``slides`` (column ``slide``) and ``gate`` also for slides without a finding.

    Findings on slides that the list does not name stay."""
    found = violations.groupBy("gate", "slide").agg(F.count_if(c("level") == "error").alias("errors"), F.count_if(c("level") == "warning").alias("warnings"))
    if slides is not None:
        every = slides.select(F.lit(gate).alias("gate"), "slide").distinct()
        found = every.join(found, ["gate", "slide"], "full").select("gate", "slide", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("errors", "warnings")])
    return found.withColumn("status", F.when(c("errors") > 0, "fail").otherwise("pass"))


def _true(name: str) -> Column:
    return F.coalesce(c(name), F.lit(False))


def gate_text_regions(regions: DataFrame, unique: str = "region_key") -> DataFrame:
    cls = c("class")
    pseudo = cls.isin(vocab.PSEUDO_CLASSES)
    rules = [
        (~F.coalesce(cls, F.lit("")).isin(vocab.REGION_CLASSES), "invalid_class", "error"),
        (reduce(lambda a, b: a | b, [c(n).isNull() for n in "xywh"]), "bbox_not_numeric", "error"),
        (c("w") <= 0, "bbox_w_not_positive", "error"),
        (c("h") <= 0, "bbox_h_not_positive", "error"),
        (~blank(c("ocr_text")) & blank(c("notes")), "ocr_without_notes", "warning"),
        ((cls == "semantic_text") & blank(c("corrected_text")), "semantic_without_text", "error"),
        ((cls == "semantic_text") & (c("previous_class") == "pseudo_text") & ~_true("promotion_approved"), "silent_promotion", "error"),
        (pseudo & ~blank(c("corrected_text")), "pseudo_with_text", "error"),
        (pseudo & ~blank(c("native_text")), "pseudo_with_native_text", "error"),
        ((cls == "unknown_text") & ~(_true("exception_approved") & ~blank(c("exception_reason"))), "unknown_unresolved", "error"),
    ]
    broken = apply_rules(regions, "text_regions", rules, unique)
    again = duplicates(regions.select("slide", "id", unique), ["slide", "id"], [unique])
    return broken.unionByName(relabel(again, "text_regions", "duplicate_id", "error", unique))


def gate_background_repair(backgrounds: DataFrame, unique: str = "region_key") -> DataFrame:
    bg, method = c("background_type"), c("repair_method")
    redraw = bg.isin(vocab.REDRAW_TYPES) | (c("recommended_repair") == "redraw")
    rules = [
        (~F.coalesce(bg, F.lit("")).isin(vocab.BACKGROUND_TYPES), "invalid_background_type", "error"),
        (~F.coalesce("recommended_repair", F.lit("")).isin(vocab.REPAIR_METHODS), "invalid_recommendation", "error"),
        (~F.coalesce(method, F.lit("")).isin(vocab.REPAIR_METHODS), "invalid_repair_method", "error"),
        (F.coalesce(redraw, F.lit(False)) & (method == "inpaint"), "must_redraw", "error"),
        ((bg == "complex_unknown") & (c("status") == "pass") & ((method == "inpaint") | blank(c("notes"))), "unknown_passed_without_evidence", "error"),
    ]
    return apply_rules(backgrounds, "background_repair", rules, unique)


def gate_residual(reports: DataFrame, max_risk: str = "medium", unique: str = "region_key") -> DataFrame:
    rank = rank_of(c("residual_risk"), vocab.RISK_RANK, 2)
    over = rank > vocab.RISK_RANK[max_risk]
    return apply_rules(reports, "residual", [
        (over, "risk_above_max", "error"), (~over & (c("residual_risk") == "medium"), "medium_needs_review", "warning"),
        (c("status") == "fail", "report_failed", "error")], unique)


def gate_crop_manifest(crops: DataFrame, width: int = vocab.CANVAS_W, height: int = vocab.CANVAS_H, unique: str = "name") -> DataFrame:
    share = (c("w") * c("h")).cast("double") / (width * height)
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    textual = c("name").rlike("(?i)text|caption|title|table|bullet|label|heading") | kind.isin(vocab.TEXTUAL_TYPES)
    rules: list[Rule] = [(c(f).isNull() | (c(f).cast("string") == ""), "missing_" + f, "error") for f in vocab.CROP_REQUIRED]
    rules += [
        ((kind != "") & ~kind.isin(vocab.CROP_TYPES), "invalid_content_type", "error"),
        ((share > 0.85) & ~(_true("allow_large_crop") & ~blank(c("reason"))), "large_without_reason", "error"),
        ((share > 0.65) & c("file").rlike(r"(?i)slide\s*\d+\.(png|jpe?g|webp)$"), "reuses_source_image", "error"),
        (textual & blank(c("reason")) & blank(c("reconstruction_reason")), "text_without_reason", "error"),
    ]
    return apply_rules(crops, "crop_manifest", rules, unique)


def crop_metadata_incomplete() -> Column:
    return (blank(c("content_type")) | blank(c("reconstruction_reason")) | blank(c("editable_replacement"))
            | F.coalesce(c("reconstruction_reason").rlike(vocab.LEGACY_REASON_PATTERN), F.lit(False)))


def gate_crop_budget(coverage: DataFrame, crops: DataFrame, excused_slides: DataFrame, unique: str = "name") -> DataFrame:
    """Area budget per slide, complete metadata and excused textual crops.

    ``crops`` carries ``excused`` (see ``textual_crop_excused``); ``excused_slides``
    lists image-led slides.
    """
    per = coverage.join(excused_slides.select("slide", F.lit(True).alias("image_led")), "slide", "left")
    budget = apply_rules(per, "crop_budget", [
        (c("largest_ratio") > 0.35, "largest_over_budget", "error"),
        ((c("total_ratio") > 0.45) & ~_true("image_led"), "total_over_budget", "error"),
        (c("text_ratio") > 0.10, "text_over_budget", "error"),
        (c("dense_ratio") > 0.25, "dense_over_budget", "error")], "slide")
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    each = apply_rules(crops, "crop_budget", [
        (crop_metadata_incomplete(), "incomplete_metadata", "error"),
        (kind.isin(vocab.TEXTUAL_TYPES) & ~_true("excused"), "textual_without_exception", "error")], unique)
    return budget.unionByName(each)


def gate_trace(traces: DataFrame) -> DataFrame:
    """``fields`` is a map of trace fields; flags are columns of their own."""
    rules: list[Rule] = [(F.coalesce(F.try_element_at("fields", F.lit(f)), F.lit("")) == "", "missing_" + f, "error") for f in vocab.TRACE_FIELDS]
    rules += [
        (_true("enforcement_disabled"), "enforcement_disabled", "error"),
        (F.try_element_at("fields", F.lit("dependencyResolutionMode")) == "missing", "dependencies_unresolved", "error"),
        (c("missing_packages") > 0, "missing_packages", "error"),
        (~_true("invoked_by_pipeline"), "not_invoked_by_pipeline", "error"),
        (~_true("preflight_passed"), "preflight_not_passed", "error"),
        (~_true("postbuild_passed"), "postbuild_not_passed", "error"),
        (~_true("final_passed"), "final_not_passed", "error"),
        (F.lower(F.try_element_at("fields", F.lit("projectRoot"))) != F.lower("expected_root"), "project_root_differs", "error"),
    ]
    return apply_rules(traces, "trace", rules, "slide")


def gate_visual_mode(slides: DataFrame, mode: str) -> DataFrame:
    """Draft stops only critical issues, polish stops blocking ones, strict both kinds.

    A slide without status or severity counts as failed and blocking.
    """
    status, severity = F.coalesce("status", F.lit("fail")), F.coalesce("severity", F.lit("blocking"))
    blocking = (severity == "blocking") | (status == "fail") | (F.coalesce("blocking", F.lit(0)) > 0)
    noticeable = (severity == "noticeable") | (status == "needs_polish") | (F.coalesce("noticeable", F.lit(0)) > 0)
    by_mode = {
        "qa-draft": [(_true("critical"), "critical_issue", "error"), (~_true("critical") & (blocking | noticeable), "allowed_in_draft", "warning")],
        "qa-polish": [(blocking, "blocking_left", "error"), (~blocking & noticeable, "needs_polish", "warning")],
        "qa-strict": [(blocking | noticeable, "not_clean", "error"), (_true("pair_mismatch"), "pair_mismatch", "error")],
    }
    resized = (_true("resize_applied") & blank(c("resize_reason")), "unrecorded_resize", "error")
    return apply_rules(slides, "visual_mode_" + mode, [*by_mode[mode], resized], "slide")


def gate_fix_plan(slides: DataFrame, issues: DataFrame, fixes: DataFrame, mode: str = "qa-polish") -> DataFrame:
    """A plan exists when needed, covers every actionable issue, and each fix is usable."""
    hot = c("severity").isin("blocking", "noticeable")
    found = issues.where(hot).groupBy("slide").agg(F.count(F.lit(1)).alias("open_issues"))
    planned = fixes.groupBy("slide").agg(F.count_if(hot).alias("planned"), F.count(F.lit(1)).alias("fixes"))
    per = slides.join(found, "slide", "left").join(planned, "slide", "left")
    needed = c("status").isin("fail", "needs_polish") | hot
    slide_rules: list[Rule] = [(needed & c("fixes").isNull(), "plan_missing", "error")]
    if mode == "qa-polish":
        slide_rules.append((c("fixes").isNotNull() & (c("planned") < F.coalesce("open_issues", F.lit(0))), "plan_incomplete", "error"))
    out = apply_rules(per, "fix_plan", slide_rules, "slide")
    if mode != "qa-polish":
        return out
    acted = fixes.where(hot)
    each = apply_rules(acted, "fix_plan", [
        (blank(c("recommended_fix")) | blank(c("target_file")) | c("region_x").isNull(), "fix_unusable", "error"),
        (~c("safe_to_auto_apply").eqNullSafe(False), "auto_apply_not_false", "error")])
    return out.unionByName(each).unionByName(relabel(lint_fix_text(acted), "fix_plan", c("rule")))


def gate_qa_result(results: DataFrame) -> DataFrame:
    fields = ["status", "visual_fidelity", "native_editability", "crop_policy"]
    rules: list[Rule] = [(~c(f).eqNullSafe("pass"), f + "_not_pass", "error") for f in fields]
    rules += [(c(f).isNull(), f + "_not_a_list", "error") for f in ("blocking_issues", "noticeable_issues", "minor_issues")]
    no_image = ~_true("has_raster") & ~_true("has_html")
    rules += [
        (F.size("blocking_issues") > 0, "blocking_issues_left", "error"),
        (c("report").rlike(vocab.DRAFT_WORDING), "draft_wording", "error"),
        (blank(c("evidence")), "evidence_not_referenced", "error"),
        (no_image & ~(F.lower(F.coalesce("method", F.lit(""))).eqNullSafe("manual") & ~blank(c("method_notes"))), "no_image_needs_manual_notes", "error"),
    ]
    return apply_rules(results, "qa_result", rules, "slide")


def gate_receipts(receipts: DataFrame) -> DataFrame:
    rules: list[Rule] = [
        (~c("slide").eqNullSafe(c("receipt_slide")), "wrong_slide", "error"),
        (~c("worker").eqNullSafe(vocab.RECEIPT_WORKER), "wrong_worker", "error"),
        (~c("status").eqNullSafe("completed"), "not_completed", "error"),
        (~c("shared_files_edited").eqNullSafe(False), "shared_files_edited", "error"),
        (c("artifacts").isNull(), "artifacts_not_a_list", "error"),
    ]
    held = F.coalesce("artifacts", F.array().cast("array<string>"))
    rules += [(~F.array_contains(held, n), "missing_" + n, "error") for n in vocab.RECEIPT_ARTIFACTS]
    rules.append((~F.array_contains(held, F.concat(F.lit("s"), c("slide").cast("string"), F.lit(".fragment.js"))), "missing_fragment", "error"))
    return apply_rules(receipts, "receipts", rules, "slide")


def gate_quality_mode(slides: DataFrame, present: DataFrame, violations: list[DataFrame]) -> DataFrame:
    """What a slide must show depends on its quality level.

    canary only warns when nothing is there; preservation needs two disclosures;
    reconstruction needs every artifact and takes over the given gates' findings.
    """
    known = ["baked_crop_regions.json", *vocab.RECONSTRUCTION_ARTIFACTS]
    have = present.groupBy("slide").agg(  # a fixed number of flags per slide, whatever is present
        *[F.max(c("kind") == k).alias("has_" + str(i)) for i, k in enumerate(known)], F.lit(True).alias("any"))
    have = have.select("slide", "any", F.array_compact(F.array(*[F.when(c("has_" + str(i)), F.lit(k)) for i, k in enumerate(known)])).alias("kinds"))
    rows = slides.join(have, "slide", "left")
    kinds = F.coalesce("kinds", F.array().cast("array<string>"))
    level = c("quality")
    soft = apply_rules(rows, "quality_mode", [
        ((level == "canary") & c("any").isNull(), "no_artifacts", "warning"),
        ((level == "preservation") & ~F.array_contains(kinds, "baked_crop_regions.json"), "missing_crop_disclosure", "error"),
        ((level == "preservation") & ~F.array_contains(kinds, "editability_inventory.md"), "missing_inventory_disclosure", "error"),
        (~F.coalesce(level, F.lit("")).isin("canary", "preservation", "reconstruction"), "invalid_quality", "error")], "slide")
    full = slides.where(level == "reconstruction")
    # what is absent is read off the flags; no list of expected artifacts has to meet the table again
    absent = F.array_except(F.array(*map(F.lit, vocab.RECONSTRUCTION_ARTIFACTS)), kinds)
    gone = rows.where(level == "reconstruction").select("slide", F.explode(absent).alias("kind"))
    out = soft.unionByName(relabel(gone, "quality_mode", "missing_artifact", "error", "kind"))
    for v in violations:
        taken = v.join(full.select("slide"), "slide", "left_semi").where(c("level") == "error")
        out = out.unionByName(relabel(taken, "quality_mode", F.concat_ws("_", "gate", "rule")))
    return out


def gate_orchestration(states: DataFrame, summaries: DataFrame) -> DataFrame:
    """Deck states against their latest slide summaries (``deck`` is the key).

    A deck without summaries is judged by the failed slides that its state names
    (``fail_slides``); without these too it does not pass.
    """
    level = F.coalesce("quality_level", F.lit(""))
    alone = c("blocking_slides").isNull() & (level != "canary")
    if "fail_slides" not in states.columns:
        states = states.withColumn("fail_slides", F.lit(None).cast("bigint"))
    rules: list[Rule] = [
        (~c("schema_version").eqNullSafe("0.1.0"), "unsupported_schema", "error"),
        (blank(c("project_root")), "project_root_missing", "error"),
        (~F.coalesce(level, F.lit("")).isin(vocab.QUALITY_LEVELS), "unsupported_quality_level", "error"),
        (c("bad_slides") > 0, "slides_not_positive", "error"),
        ((level != "canary") & (c("blocking_slides") > 0), "blocking_slides_remain", "error"),
        ((level == "strict") & (c("polish_slides") > 0), "polish_slides_remain", "error"),
        (alone & (c("fail_slides") > 0), "state_has_fail_slides", "error"),
        (alone & c("fail_slides").isNull(), "summary_missing", "error"),
    ]
    rules += [(blank(c(a)), "artifact_missing_" + a, "error") for a in ("pptx", "html", "summary_file", "trace_file")]
    hot = (c("status") == "fail") | (c("severity") == "blocking") | (c("blocking") > 0)
    per = summaries.groupBy("deck").agg(F.count_if(hot).alias("blocking_slides"), F.count_if(c("status") == "needs_polish").alias("polish_slides"),
                                        F.count_if(c("slide") <= 0).alias("bad_slides"))
    rows = states.join(per, "deck", "left").withColumn("slide", c("deck"))
    return apply_rules(rows, "orchestration", rules, "deck")


BAND_FIELDS = {
    "knownGoodMetricBands": ["pixelMax", "maeMax", "edgeMax", "ssimMin", "paletteMax"],
    "borderlineMetricBands": ["pixelMax", "maeMax", "edgeMax", "ssimMin", "paletteMax"],
    "knownBadMetricBands": ["pixelMin", "maeMin", "edgeMin", "ssimMax", "paletteMin", "requiredSignalsForBlocking"],
}


def gate_calibration_profile(profiles: DataFrame, column: str = "profile") -> DataFrame:
    """A calibration profile is complete and numeric (true/false are not numbers)."""
    doc = F.try_parse_json(c(column))
    rows = profiles.withColumn("_v", doc)
    read = c("_v").isNotNull()

    def kind(path):
        return F.coalesce(F.schema_of_variant(F.try_variant_get("_v", path, "variant")), F.lit(""))

    rules: list[Rule] = [
        (~read, "unreadable", "error"),
        (read & ~F.try_variant_get("_v", "$.schemaVersion", "string").eqNullSafe(vocab.CALIBRATION_SCHEMA), "wrong_schema", "error")]
    for group, fields in BAND_FIELDS.items():
        for side in (vocab.SOURCE_KIND, vocab.PAIR_KIND):
            for f in fields:
                number = kind(f"$.{group}.{side}.{f}").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
                rules.append((read & ~number, f"not_numeric_{group}.{side}.{f}", "error"))
    return apply_rules(rows, "calibration_profile", rules, "slide")


def gate_worker_package(packages: DataFrame, crops: DataFrame, fragments: DataFrame) -> DataFrame:
    """Canvas size, profile id and confidence, numeric crops, one function per fragment."""
    head = apply_rules(packages, "worker_package", [
        (c("canvas_width").isNull() | c("canvas_height").isNull(), "canvas_size_missing", "error"),
        (blank(c("profile_id")), "profile_id_missing", "error"),
        (blank(c("confidence")), "confidence_missing", "error")], "slide")
    numeric = [(c(n).try_cast("double").isNull(), "crop_" + n + "_not_numeric", "error") for n in "xywh"]
    each = apply_rules(crops, "worker_package", [(blank(c("name")), "crop_name_missing", "error"), *numeric], "name")
    names = F.regexp_extract_all("source", F.lit(r"\bfunction\s+([A-Za-z_$][\w$]*)\s*\(\s*s\s*\)"), 1)
    want = F.concat(F.lit("s"), c("slide").cast("string"))
    code = apply_rules(fragments.withColumn("_f", names), "worker_package", [
        ((F.size("_f") != 1) | ~F.get("_f", F.lit(0)).eqNullSafe(want), "fragment_function", "error")], "slide")
    return head.unionByName(each).unionByName(code)


def gate_captures(captures: DataFrame, width: int, height: int) -> DataFrame:
    return apply_rules(captures, "captures", [
        (c("actual_width").isNull() | c("actual_height").isNull(), "dimensions_unreadable", "error"),
        ((c("actual_width") != width) | (c("actual_height") != height), "dimensions_differ", "error"),
        (~c("scale").eqNullSafe(F.lit(1)), "scale_not_one", "error"),
        (~_true("qa_static"), "not_static", "error"),
        (_true("modified_html"), "modified_html", "error"),
        (~c("viewport_width").eqNullSafe(width) | ~c("viewport_height").eqNullSafe(height), "viewport_differs", "error"),
        (~c("html_sha").eqNullSafe(c("current_html_sha")), "html_changed", "error"),
        (~c("output_sha").eqNullSafe(c("current_output_sha")), "image_changed", "error")], "slide")
