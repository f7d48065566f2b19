"""From metrics to severities, issue types and slide status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions.columns import lookup, name_of, rank_of


def _checks(group: dict) -> list[tuple[str, str, float]]:
    """(metric, operator, threshold) for each threshold of a band."""
    out = []
    for name, value in group.items():
        stem, end = name[:-3], name[-3:]
        if stem in vocab.METRIC_OF and end in ("Max", "Min"):
            out.append((vocab.METRIC_OF[stem], "<=" if end == "Max" else ">=", float(value)))
    return out


def _holds(metric: str, op: str, threshold: float) -> Column:
    value = F.col(metric)
    return value <= threshold if op == "<=" else value >= threshold


def _by_kind(build, group: str, profile: dict) -> Column:
    """Evaluate ``build(band)`` for the row's comparison kind."""
    bands = profile[group]
    out = None
    for kind, band in bands.items():
        value = build(band)
        out = F.when(F.col("kind") == kind, value) if out is None else out.when(F.col("kind") == kind, value)
    return out


def _inside(band: dict) -> Column:
    # a missing metric is never inside a band
    return reduce(lambda a, b: a & b, [F.coalesce(_holds(*c), F.lit(False)) for c in _checks(band)])


def _signals(band: dict) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(_holds(*c), F.lit(False)).cast("int") for c in _checks(band)])


def band_facts(metrics: DataFrame, profile: dict = vocab.CALIBRATION) -> DataFrame:
    """Signal count and band membership of each comparison; no shuffle. A comparison without pixel metric was not made and has no row."""
    metrics = metrics.where("pixel_difference_ratio IS NOT NULL")
    kinds = {label: kind for label, (_, _, kind) in vocab.COMPARISONS.items()}
    return (metrics.withColumn("kind", lookup(F.col("comparison"), kinds))
            .withColumn("signal_count", _by_kind(_signals, "knownBadMetricBands", profile).cast("bigint"))
            .withColumn("required", _by_kind(lambda b: F.lit(int(b["requiredSignalsForBlocking"])), "knownBadMetricBands", profile))
            .withColumn("within_good", _by_kind(_inside, "knownGoodMetricBands", profile))
            .withColumn("within_borderline", _by_kind(_inside, "borderlineMetricBands", profile)))


def _severity_rank(pair_blocks: Column) -> Column:
    """Rank from the band facts; a render-to-render mismatch blocks only in context."""
    bad = F.col("signal_count") >= F.col("required")
    soft = (F.col("kind") == vocab.PAIR_KIND) & ~pair_blocks
    return F.when(bad & ~soft, 3).when(bad, 2).when(F.col("within_good"), 1).otherwise(2)


def explicit_block(severity: Column, type_: Column) -> Column:
    return F.coalesce((severity == "blocking") & type_.isin(vocab.CRITICAL_SIGNALS), F.lit(False))


def classify_comparison(metrics: DataFrame, signals: DataFrame | None = None, profile: dict = vocab.CALIBRATION) -> DataFrame:
    """Class and severity of each comparison row."""
    facts = band_facts(metrics, profile)
    bad = F.col("signal_count") >= F.col("required")
    same = W.partitionBy("slide")
    source_blocks = F.coalesce(F.max((F.col("kind") == vocab.SOURCE_KIND) & bad).over(same), F.lit(False))
    if signals is None:
        context = facts.withColumn("pair_blocks", source_blocks)
    else:
        critical = signals.groupBy("slide").agg(F.max(explicit_block(F.col("severity"), F.col("type"))).alias("critical"))
        context = facts.join(critical, "slide", "left").withColumn("pair_blocks", source_blocks | F.coalesce("critical", F.lit(False)))
    rank = _severity_rank(F.col("pair_blocks"))
    cls = (F.when(bad & (F.col("kind") == vocab.PAIR_KIND) & ~F.col("pair_blocks"), "material_mismatch_needs_review")
           .when(bad, "known_bad_like").when(F.col("within_good"), "known_good_like")
           .when(F.col("within_borderline"), "borderline_like").otherwise("out_of_band"))
    return (context.withColumn("classification", cls).withColumn("severity", name_of(rank, vocab.SEVERITY_RANK))
            .drop("pair_blocks", "critical", "required"))


def status_of(severity: Column) -> Column:
    return F.when(severity == "blocking", "fail").when(severity == "noticeable", "needs_polish").otherwise("pass")


def slide_severity(metrics: DataFrame, signals: DataFrame, mode: str = "qa-polish", profile: dict = vocab.CALIBRATION) -> DataFrame:
    """Status, severity, confidence and tolerance per slide.

    Comparison facts and signals are stacked and folded in one aggregation, so
    the slide's own context (a blocking source comparison or signal) is known
    when the render-to-render comparison is judged. Map-side partial aggregates
    keep a slide with very many signals cheap.
    """
    facts = band_facts(metrics, profile).select(
        "slide", "kind", "within_good", (F.col("signal_count") >= F.col("required")).alias("bad"))
    marks = signals.select("slide", rank_of(F.coalesce("severity", F.lit("noticeable")), vocab.SEVERITY_RANK, 0).alias("signal_rank"),
                           explicit_block(F.col("severity"), F.col("type")).alias("critical"))
    both = facts.unionByName(marks, allowMissingColumns=True)
    is_source, is_pair = F.col("kind") == vocab.SOURCE_KIND, F.col("kind") == vocab.PAIR_KIND

    def any_of(cond):
        return F.coalesce(F.max(cond), F.lit(False))

    folded = both.groupBy("slide").agg(
        any_of(is_source & F.col("bad")).alias("source_bad"),
        any_of(F.col("critical")).alias("critical"),
        F.max(F.when(is_source, F.when(F.col("bad"), 3).when(F.col("within_good"), 1).otherwise(2))).alias("source_rank"),
        F.max(F.when(is_pair, F.col("bad"))).alias("pair_bad"),
        F.max(F.when(is_pair, F.col("within_good"))).alias("pair_good"),
        any_of(is_source & ~F.col("within_good")).alias("source_not_good"),
        F.max("signal_rank").alias("signal_rank"))
    pair_rank = (F.when(F.col("pair_bad") & (F.col("source_bad") | F.col("critical")), 3).when(F.col("pair_bad"), 2)
                 .when(F.col("pair_good"), 1).when(F.col("pair_good").isNotNull(), 2))
    rank = F.greatest(F.coalesce("source_rank", F.lit(0)), F.coalesce(pair_rank, F.lit(0)), F.coalesce("signal_rank", F.lit(0)))
    out = folded.withColumn("severity", name_of(rank, vocab.SEVERITY_RANK))
    confidence = (F.when(F.col("critical") | (F.col("severity") == "blocking"), 0.9)
                  .when(~F.col("source_not_good") & F.coalesce("pair_good", F.lit(True)), 0.86)
                  .when(F.col("severity") == "noticeable", 0.78).otherwise(0.72))
    tolerant = F.lit(mode in ("qa-draft", "qa-polish")) & F.col("severity").isin("minor", "noticeable") & ~F.col("critical")
    return out.select("slide", status_of(F.col("severity")).alias("status"), "severity", confidence.alias("confidence"),
                      tolerant.alias("tolerance_applied"))


def fix_plan(classified: DataFrame, tags: DataFrame) -> DataFrame:
    """Issue type and repair strategy of every comparison that needs one."""
    rows = classified.where(F.col("severity").isin("blocking", "noticeable")).join(tags, "slide", "left")

    def num(name):
        return F.coalesce(F.col(name), F.lit(0.0))

    def tag(name):
        return F.coalesce(F.col(name), F.lit(False))

    edge = num("edge_difference_ratio")
    palette = num("color_palette_drift") >= 0.22
    high_edge = edge >= 0.135
    low = (num("edge_density_delta") >= 0.006) & (edge >= 0.10)
    pair = F.col("comparison") == "pptx_vs_html"
    dense = ["edge_density_low", "non_text_detail_crop_candidate"]
    # decision order: the first rule that applies wins
    rules = [
        (pair & ((edge >= 0.095) | (edge > num("pixel_difference_ratio") * 0.75)), "pptx_html_edge_mismatch", "helper_layout_parity", False, []),
        (pair, "pptx_html_mismatch", "helper_layout_parity", False, []),
        (tag("board") & palette, "board_texture_missing", "native_board_structure_plus_non_text_texture", True, ["palette_drift", "non_text_detail_crop_candidate"]),
        (tag("stop_flow") & (low | high_edge), "missing_detail_density", "native_stop_flow_detail_density", False, ["edge_density_low"]),
        (tag("stop_flow") & palette, "missing_detail_density", "native_stop_flow_detail_density", False, ["palette_drift"]),
        (tag("technical_diagram") & (high_edge | palette | low), "technical_diagram_under_detailed", "native_technical_density_then_small_non_text_crops", True, dense),
        (tag("schematic") & (high_edge | low), "schematic_density_low", "native_schematic_density_then_small_non_text_crops", True, dense),
        (low | high_edge, "edge_density_low", "native_edge_density", False, ["missing_detail_density"]),
        (palette, "palette_drift", "palette_and_material_tuning", False, []),
        (F.col("classification") == "out_of_band", "acceptable_native_simplification", "inspect_editable_simplification", False, []),
        (F.lit(True), "spacing", "spacing_layout_tuning", False, []),
    ]
    pick = None
    for cond, type_, strategy, crop, extra in rules:
        row = F.struct(F.lit(type_).alias("type"), F.lit(strategy).alias("fix_strategy"), F.lit(crop).alias("crop_allowed"),
                       F.array(*[F.lit(e) for e in extra]).cast("array<string>").alias("secondary_issue_types"))
        pick = F.when(cond, row) if pick is None else pick.when(cond, row)
    return rows.withColumn("plan", pick).select(
        "slide", "comparison", "severity", "plan.type", "plan.fix_strategy", "plan.crop_allowed", "plan.secondary_issue_types",
        F.when(F.col("plan.crop_allowed"), F.when(F.col("plan.type") == "board_texture_missing", F.array(*map(F.lit, vocab.BOARD_CROP_TYPES)))
               .otherwise(F.array(*map(F.lit, vocab.ALLOWED_CROP_TYPES)))).alias("allowed_content_types"))


def crop_policy_check(issues: DataFrame, crops: DataFrame) -> DataFrame:
    """May this crop's content type be used for this issue? Forbidden beats allowed."""
    kind = F.lower(F.trim(F.col("content_type")))
    allowed = F.coalesce(F.array_contains(F.col("allowed_content_types"), kind), F.lit(False)) & ~kind.isin(vocab.FORBIDDEN_CROP_TYPES)
    return issues.join(crops, "slide").withColumn("allowed", F.coalesce(allowed, F.lit(False)))


def domain_tags(texts: DataFrame, values: str = "values") -> DataFrame:
    """Subject tags of a slide from its text values (substring matches)."""
    from ..functions.columns import contains_any, count_hits
    whole = F.lower(F.array_join(F.col(values), " "))
    head = F.lower(F.array_join(F.slice(F.col(values), 1, 8), " "))
    rows = texts.withColumn("_t", whole).withColumn("_h", head)
    text = F.col("_t")
    rows = rows.select("*", *[count_hits(text, words).alias(name + "_hits") for name, words in vocab.LEXICONS.items()])
    return rows.select(
        "slide", *[F.col(n + "_hits").cast("bigint").alias(n + "_hits") for n in vocab.LEXICONS],
        (F.col("stop_hits") > 0).alias("stop_flow"),
        contains_any(F.col("_h"), vocab.BOARD_HEADINGS).alias("board"),
        (contains_any(text, vocab.SCHEMATIC_PHRASES) | ((F.col("schematic_hits") >= 3) & F.contains(text, F.lit("flow")))).alias("schematic"),
        (contains_any(text, vocab.TECHNICAL_PHRASES) | ((F.col("technical_hits") >= 4) & ~F.contains(text, F.lit(vocab.TECHNICAL_EXCLUDED)))).alias("technical_diagram"))
