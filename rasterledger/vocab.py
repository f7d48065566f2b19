"""Word lists, enums, thresholds and default rows.

Results depend on these being exactly as listed, so they are stated plainly
here and nowhere else.
"""

# Canvas size used when a deck does not state one.
CANVAS_W = 1672
CANVAS_H = 941

# Severities, worst last, and the status each one gives.
SEVERITY_RANK = {"pass": 0, "minor": 1, "noticeable": 2, "blocking": 3}
RISK_RANK = {"low": 0, "medium": 1, "high": 2}

# Signal types that block on their own.
CRITICAL_SIGNALS = [
    "missing_artifact", "missing_content", "full_slide_shortcut", "crop_shortcut",
    "content_loss", "missing_key_content", "clipping", "layout_break",
    "readability_loss", "wrong_slide",
]

# Comparison labels and the calibration kind of each.
COMPARISONS = {
    "pptx_vs_source": ("source", "pptx", "sourceRenderSimilarity"),
    "html_vs_source": ("source", "html", "sourceRenderSimilarity"),
    "pptx_vs_html": ("pptx", "html", "pptxHtmlConsistency"),
}
SOURCE_KIND = "sourceRenderSimilarity"
PAIR_KIND = "pptxHtmlConsistency"

# Calibration bands (metric thresholds per kind).
CALIBRATION_SCHEMA = "slide-visual-polish-qa.calibration-profile.v1"
CALIBRATION = {
    "schemaVersion": CALIBRATION_SCHEMA,
    "knownGoodMetricBands": {
        "sourceRenderSimilarity": {"pixelMax": 0.21, "maeMax": 0.105, "edgeMax": 0.115, "ssimMin": 0.6, "paletteMax": 0.15},
        "pptxHtmlConsistency": {"pixelMax": 0.11, "maeMax": 0.055, "edgeMax": 0.09, "ssimMin": 0.79, "paletteMax": 0.055},
    },
    "borderlineMetricBands": {
        "sourceRenderSimilarity": {"pixelMax": 0.24, "maeMax": 0.13, "edgeMax": 0.135, "ssimMin": 0.44, "paletteMax": 0.23},
        "pptxHtmlConsistency": {"pixelMax": 0.13, "maeMax": 0.065, "edgeMax": 0.09, "ssimMin": 0.74, "paletteMax": 0.07},
    },
    "knownBadMetricBands": {
        "sourceRenderSimilarity": {"pixelMin": 0.25, "maeMin": 0.14, "edgeMin": 0.145, "ssimMax": 0.42, "paletteMin": 0.28, "requiredSignalsForBlocking": 2},
        "pptxHtmlConsistency": {"pixelMin": 0.13, "maeMin": 0.065, "edgeMin": 0.095, "ssimMax": 0.72, "paletteMin": 0.08, "requiredSignalsForBlocking": 3},
    },
}
# Metric column behind each threshold name stem.
METRIC_OF = {
    "pixel": "pixel_difference_ratio",
    "mae": "mean_absolute_error",
    "edge": "edge_difference_ratio",
    "palette": "color_palette_drift",
    "ssim": "approx_ssim",
}

# Domain lexicons.
LEXICONS = {
    "technical": ["cargo pump", "pump", "hpu", "hydraulic", "power unit", "power supply", "esd",
                  "discharge valve", "stripping", "heating", "cooling", "manifold", "valve"],
    "schematic": ["cargo system flow", "line routing", "routing control", "liquid flow", "vapour return",
                  "drain", "sample point", "deck line", "flow"],
    "board": ["line-up board", "lineup board", "board", "open", "closed", "isolated", "date / time", "sign"],
    "stop": ["stop criteria", "trigger", "wrong line-up suspicion"],
}
BOARD_HEADINGS = ["line-up board", "lineup board"]
SCHEMATIC_PHRASES = ["cargo system flow", "line routing", "routing control", "manifold watch"]
TECHNICAL_PHRASES = ["engine support", "pump · hpu", "pump hpu", "power · esd"]
TECHNICAL_EXCLUDED = "independent verification"

# JSON keys that hold readable text.
TEXT_KEYS = ["correctedtext", "text", "ocrtext", "nativereplacement", "title", "label", "name", "content"]

# Text region classes and repair routing.
REGION_CLASSES = ["semantic_text", "pseudo_text", "micro_text", "decorative_glyph", "unknown_text"]
PSEUDO_CLASSES = ["pseudo_text", "decorative_glyph"]
BACKGROUND_TYPES = ["flat_color", "gradient", "panel", "table_cell", "rule_line", "icon_area",
                    "chart_area", "photo_texture", "complex_unknown"]
REPAIR_METHODS = ["redraw", "inpaint", "native_reconstruct", "manual_review"]
REPAIR_OF = {
    "flat_color": "redraw", "panel": "redraw", "table_cell": "redraw",
    "rule_line": "native_reconstruct", "gradient": "inpaint", "photo_texture": "inpaint",
    "icon_area": "manual_review", "chart_area": "manual_review", "complex_unknown": "manual_review",
}
REDRAW_TYPES = ["flat_color", "panel", "table_cell"]

# Background words, tried in this order, with the confidence of each hit.
BACKGROUND_WORDS = [
    ("chart_area", 0.82, ["chart", "axis", "plot", "graph", "data point"]),
    ("icon_area", 0.78, ["icon", "glyph", "pictogram"]),
    ("table_cell", 0.80, ["table", "cell", "matrix", "row", "column", "grid"]),
    ("rule_line", 0.72, ["rule", "divider", "underline", "border line"]),
    ("panel", 0.78, ["panel", "card", "badge", "box", "callout", "input_doc", "warning", "flow",
                     "category", "bottom_statement", "page_indicator", "slide_code"]),
    ("photo_texture", 0.82, ["photo", "texture", "photoreal", "image"]),
    ("gradient", 0.72, ["gradient", "glow"]),
]
TITLE_WORDS = ["title", "header", "headline", "bold", "label"]
SHADOW_WORDS = ["shadow", "glow", "halo", "blur"]

# Crop content types and legacy defaults.
CROP_TYPES = ["photoreal", "3d", "continuous_tone", "text", "table", "chart", "label", "bullet",
              "dense_infographic", "mixed_text_visual", "decorative", "unspecified"]
TEXTUAL_TYPES = ["text", "table", "chart", "label", "bullet", "mixed_text_visual"]
DENSE_TYPES = ["dense_infographic", "unspecified"]
PHOTO_TYPES = ["photoreal", "3d", "continuous_tone"]
LEGACY_REASON = "legacy crop metadata not supplied; review before reconstruction delivery"
LEGACY_REASON_PATTERN = "(?i)legacy crop metadata not supplied"
FORBIDDEN_CROP_TYPES = ["label", "micro_text", "pseudo_text", "semantic_text", "table", "text"]
ALLOWED_CROP_TYPES = ["3d", "technical", "decorative", "texture", "photo"]
BOARD_CROP_TYPES = ["decorative", "texture", "3d"]
CROP_REQUIRED = ["name", "slide", "x", "y", "w", "h", "file", "content_type", "reconstruction_reason", "editable_replacement"]

# Repair strategies per issue type, and the priority order of types.
STRATEGIES = {
    "missing_detail_density": "add native line/node/icon/rule density first; consider small non-text detail crops only if needed",
    "technical_diagram_under_detailed": "add native line/node/connector density; allow metadata-rich non-text technical crops; never text/table/label crops",
    "schematic_density_low": "trace native route/connectors and valve/node approximations; small non-text technical crops only",
    "board_texture_missing": "keep board text/table native; use small decorative board-material crops; no whole-board crop",
    "checklist_table_fidelity_low": "source-guided native grid/table tracing with row/column/rule reconstruction; prefer crop coverage 0",
    "edge_density_low": "improve rule density, panel/card boundaries, line thickness, connector density",
    "pptx_html_edge_mismatch": "check helper parity and deck-level geometry; do not loosen thresholds",
    "pptx_html_mismatch": "check helper parity, coordinates, font/line-height behavior, and capture mode",
    "palette_drift": "adjust profile/local colors and panel fills; use non-text texture crops only where appropriate",
}
DEFAULT_STRATEGY = "review visual_polish_fixes.json and repair natively first"
ISSUE_PRIORITY = [
    "checklist_table_fidelity_low", "technical_diagram_under_detailed", "schematic_density_low",
    "missing_detail_density", "board_texture_missing", "edge_density_low", "palette_drift",
    "pptx_html_edge_mismatch", "pptx_html_mismatch",
]

# Native object categories counted per slide (object type -> category).
OBJECT_CATEGORY = {
    "text": "text", "panel": "panels", "rule": "rules", "line": "rules", "icon": "icons",
    "image": "images", "table": "tables", "chart": "charts", "badge": "badges", "callout": "callouts",
}

# Artifact names required per worker package / receipt / slide.
RECEIPT_ARTIFACTS = ["measurements.json", "profile_override.json", "crop_plan.json",
                     "editability_inventory.md", "reconstruction_score.json", "qa_report.md"]
RECEIPT_WORKER = "slide_reconstruct_worker"
RECONSTRUCTION_ARTIFACTS = ["measurements.json", "profile_override.json", "crop_plan.json", "reconstruction_notes.md",
                            "editability_inventory.md", "reconstruction_score.json", "qa_report.md", "worker_receipt.json",
                            "qa_result.json", "qa_evidence.json"]
TEXT_LAYER_ARTIFACTS = ["text_regions.json", "text_mask.png", "pseudo_text_mask.png", "inpaint_mask.png",
                        "mask_overlay.png", "clean_background.png", "inpainting_report.json", "inpainting_report.md"]
VISUAL_ARTIFACTS = {
    "always": ["source.png", "visual_metrics.json", "visual_polish_report.md"],
    "pptx": ["pptx_raster.png", "pptx_diff.png", "pptx_edge_diff.png"],
    "html": ["html_screenshot.png", "html_diff.png", "html_edge_diff.png"],
}
TRACE_FIELDS = ["skillRoot", "projectRoot", "buildJsPath", "slidesJsPath", "kitJsPath", "atomsPptxPath", "atomsHtmlPath",
                "pptxOut", "htmlOut", "hashes", "enforcementDisabled", "strictMode", "invokedByPipeline",
                "preflightValidation", "postbuildValidation", "finalValidation", "startTimeMs", "dependencyResolutionMode"]
QUALITY_LEVELS = ["canary", "blocking-zero", "polish", "strict"]
ITERATION_LIMIT = {"canary": 1, "blocking-zero": 6, "polish": 10, "strict": 20}
TEXT_REGION_SCHEMA = "slide-text-layer-inpaint.text_regions.v1"

# Default palette (hex) of a deck without a profile.
PALETTE = {
    "bg": "020812", "panel": "0B1B2D", "line": "2A4A6E", "white": "F2F7FC", "sub": "AEC4DA",
    "gold": "E9B84A", "cyan": "3BC4ED", "badge": "1F6FB5", "badgeRed": "C13A33", "red": "D8453B",
    "green": "3FB950", "chevOn": "1E6FB0", "orange": "E08A3C", "steel": "7FB6E6",
}

# What counts as a colour text, and as a comment of a source file.
HEX_COLOUR = "^#?[0-9A-Fa-f]{6}$"
CSS_COLOUR = r"(?i)^rgba?\(\s*([\d.]+)\s*,\s*([\d.]+)\s*,\s*([\d.]+)\s*(?:,\s*([\d.]+)\s*)?\)$"
BLOCK_COMMENT = r"/\*[\s\S]*?\*/"
LINE_COMMENT = r"(?m)(^|[^:])//.*$"

# Patterns of the token scan (label, pattern).
#: What a slide fragment must not hold.
FRAGMENT_PATTERNS = [
    ("require(", r"require\s*\("),
    ("module.exports", r"module\.exports"),
    ("exports.", r"\bexports\."),
    ("TARGET", r"\bTARGET\b"),
    ("makePptxSurface", r"\bmakePptxSurface\b"),
    ("makeHtmlSurface", r"\bmakeHtmlSurface\b"),
    ("pptx", r"(?i)\bpptx\b"),
    ("html", r"(?i)\bhtml\b"),
]
FORBIDDEN_PATTERNS = [
    ("new pptxgen(", r"(?i)new\s+pptxgen\s*\("),
    ("pptxgenjs", r"(?i)pptxgenjs"),
    ("python-pptx", r"(?i)python-pptx"),
    ("Presentation()", r"\bPresentation\s*\(\s*\)"),
    ("html-to-pptx", r"(?i)html-to-pptx"),
    (".pptx write/copy", r"(?i)(?:writeFileSync|writeFile|copyFileSync|copy-item|cp\s+|copy\s+).{0,120}\.pptx"),
    ("soffice --convert-to pptx", r"(?i)soffice.{0,120}--convert-to\s+pptx"),
]
DRAFT_WORDING = r"(?i)not\s+run|qa\s+pending|preservation\s+only|approximate|draft"
BACKEND_TOKENS = ["pptxgenjs", "pptx.", "addSlide", "writeFile({ fileName", "makePptxSurface", "makeHtmlSurface",
                  "document.", "window.", "<html", "<body", "python-pptx", "libreoffice", "soffice",
                  "html-to-pptx", "html to pptx", "pdf-to-pptx"]
EMU_EXTREME = 1_000_000_000

# Fixed values of package checks.
REQUIRED_PARTS = ("[Content_Types].xml", "_rels/.rels", "ppt/presentation.xml", "ppt/_rels/presentation.xml.rels")
REQUIRED_DEFAULTS = ("xml", "rels")
MEDIA_DEFAULTS = ("png", "jpg", "jpeg", "svg")
NOT_A_NUMBER = r"(?i)\b(?:nan|infinity|undefined)\b"
NULL_FOR_NUMBER = r"""(?i)(?:x|y|cx|cy|w|h|rot|sz|val|pos|off|ext)\s*=\s*["'][^"']*\b(null)\b"""
