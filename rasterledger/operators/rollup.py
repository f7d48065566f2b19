"""Deck roll-ups, rankings and repair waves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions.columns import lookup, rank_of
from ..functions.ranking import running_number


def deck_summary(slides: DataFrame, issues: DataFrame) -> DataFrame:
    """Counts per slide status, issue severity, type, strategy and crop advice.

    All issue counts come from one pass over the issues (grouping sets); with
    partial aggregation only the handful of group keys is shuffled.
    """
    known = F.when(F.col("status").isin("pass", "fail", "needs_polish"), F.col("status")).otherwise(F.lit("missing"))
    by_status = slides.groupBy(known.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("status").alias("measure"), "key", "n")
    prepared = issues.select("severity", F.coalesce("type", F.lit("other")).alias("type"), "fix_strategy",
                             F.coalesce("crop_allowed", F.lit(False)).alias("crop_allowed"))
    sets = prepared.groupingSets([["severity"], ["type"], ["fix_strategy"], ["crop_allowed"]], "severity", "type", "fix_strategy", "crop_allowed").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("severity").alias("g1"), F.grouping("type").alias("g2"),
        F.grouping("fix_strategy").alias("g3"))
    named = sets.select(
        F.when(F.col("g1") == 0, "issue_severity").when(F.col("g2") == 0, "issue_type").when(F.col("g3") == 0, "fix_strategy")
        .otherwise("crop_recommended").alias("measure"),
        F.when(F.col("g1") == 0, F.col("severity")).when(F.col("g2") == 0, F.col("type")).when(F.col("g3") == 0, F.col("fix_strategy"))
        .otherwise(F.col("crop_allowed").cast("string")).alias("key"), "n")
    wanted = F.col("key").isNotNull() & ((F.col("measure") != "crop_recommended") | (F.col("key") == "true"))
    return by_status.unionByName(named.where(wanted))


def common_types(issues: DataFrame) -> DataFrame:
    counts = issues.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "type")


def worst_slides(slides: DataFrame, k: int = 10, unknown_rank: int = 3) -> DataFrame:
    """The ``k`` worst slides; a missing or unknown severity ranks as ``unknown_rank`` (3, with the worst, in the deck summary)."""
    rank = rank_of(F.col("severity"), vocab.SEVERITY_RANK, unknown_rank)
    return slides.orderBy(rank.desc(), F.desc("issue_count"), F.asc("slide")).limit(k)


def blocks(prefix: str = "") -> Column:
    return (F.col("status") == "fail") | (F.col("severity") == "blocking") | (F.col("blocking") > 0)


def backlog(slides: DataFrame) -> DataFrame:
    """One row per (list, slide): pass, needs_polish, fail and blocking lists."""
    state = F.when(F.col("status").isin("pass", "needs_polish"), F.col("status")).otherwise(F.lit("fail"))
    lists = F.array(state, F.when(F.coalesce(blocks(), F.lit(False)), F.lit("blocking")))
    return slides.select("slide", F.explode(F.array_compact(lists)).alias("list")).select("list", "slide")


def _wanted(level: str) -> Column:
    if level == "canary":
        return F.lit(False)
    if level == "strict":
        return F.col("status") != "pass"
    if level == "polish":
        return blocks() | (F.col("status") == "needs_polish")
    return blocks()


def slide_types(issues: DataFrame) -> DataFrame:
    """Distinct issue types of a slide with the place each was first seen."""
    return issues.where(F.col("type").isNotNull()).groupBy("slide", "type").agg(F.min("event_id").alias("first_seen"))


def repair_score(slides: DataFrame, issues: DataFrame, level: str = "blocking-zero") -> DataFrame:
    """Score of every slide that the quality level sends to repair."""
    weight = {t: len(vocab.ISSUE_PRIORITY) - i for i, t in enumerate(vocab.ISSUE_PRIORITY)}
    bonus = slide_types(issues).groupBy("slide").agg(
        F.sum(lookup(F.col("type"), weight, 0)).alias("bonus"), F.count(F.lit(1)).alias("type_count"))
    picked = slides.where(_wanted(level)).join(bonus, "slide", "left")
    score = (F.when(F.col("status") == "fail", 1000).otherwise(0) + F.when(F.col("severity") == "blocking", 500).otherwise(0)
             + F.coalesce("blocking", F.lit(0)) * 100 + F.coalesce("issue_count", F.lit(0)) * 10 + F.coalesce("bonus", F.lit(0)))
    return picked.select("slide", "status", "severity", "issue_count", F.coalesce("type_count", F.lit(0)).alias("type_count"),
                         score.cast("bigint").alias("score"))


def waves(scored: DataFrame, issues: DataFrame, size: int = 5) -> DataFrame:
    """Ranked slides cut into waves; a wave holds at most ``size`` slides."""
    ranked = running_number(scored, [], [(F.col("score"), True)], "slide", "place", coarse=F.floor(-F.col("score") / 100))
    placed = ranked.withColumn("wave", F.floor((F.col("place") - 1) / size) + 1)
    types = slide_types(issues).join(placed.select("slide", "wave", "place"), "slide")
    first = types.groupBy("wave", "type").agg(F.min(F.struct("place", "first_seen")).alias("at"))
    type_list = first.groupBy("wave").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "type"))), lambda r: r["type"]), ",").alias("issue_types"))
    slide_list = placed.groupBy("wave").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "slide"))), lambda r: r["slide"].cast("string")), ",").alias("slides"))
    return (slide_list.join(type_list, "wave", "left")
            .select(F.concat(F.lit("repair-wave-"), F.col("wave").cast("string")).alias("wave_id"), "slides", "issue_types"))


def number_issues(issues: DataFrame, order: str = "event_id") -> DataFrame:
    """Running id ``s{slide}_issue_{000}`` in emission order."""
    numbered = running_number(issues, ["slide"], [], order, "n")
    return numbered.withColumn("issue_id", F.format_string("s%d_issue_%03d", F.col("slide"), F.col("n")))


def strategy_lookup(issues: DataFrame) -> DataFrame:
    return issues.withColumn("strategy", lookup(F.col("type"), vocab.STRATEGIES, vocab.DEFAULT_STRATEGY))


def layout_drift(boxes: DataFrame) -> DataFrame:
    """Sum of absolute box differences per pair: count, mean and max per slide."""
    d = sum((F.abs(F.col("s" + c) - F.col("r" + c)) for c in "xywh"), F.lit(0.0))
    return (boxes.withColumn("d", d).where(F.col("d").isNotNull()).groupBy("slide").agg(
        F.count(F.lit(1)).alias("box_count"), F.avg("d").alias("mean_drift"), F.max("d").alias("max_drift")))


def convergence(history: DataFrame, level: str = "blocking-zero") -> DataFrame:
    """Blocking slides per repair iteration and whether the loop may stop there.

    ``history`` has one or more rows per (slide, iteration); the last status of a
    slide counts from the iteration it was seen in until it is seen again.
    """
    last = history.groupBy("slide", "iteration").agg(F.max_by("severity", "event_id").alias("severity"))
    w = W.partitionBy("slide").orderBy("iteration")
    blocking = (F.col("severity") == "blocking").cast("int")
    change = blocking - F.coalesce(F.lag(blocking).over(w), F.lit(0))
    steps = last.withColumn("change", change).groupBy("iteration").agg(F.sum("change").alias("change"))
    upto = W.orderBy("iteration").rowsBetween(W.unboundedPreceding, W.currentRow)  # one row per iteration
    limit = vocab.ITERATION_LIMIT[level]
    return steps.select("iteration", F.sum("change").over(upto).alias("blocking_slides"),
                        F.row_number().over(W.orderBy("iteration")).cast("bigint").alias("round")) \
        .select("iteration", "round", "blocking_slides", ((F.col("blocking_slides") == 0) | (F.col("round") >= limit)).alias("stop"))


def last_status(history: DataFrame) -> DataFrame:
    """Latest known status per slide (partial aggregation, no ordering of rows)."""
    return history.groupBy("slide").agg(F.max_by("severity", "event_id").alias("severity"), F.max("iteration").alias("iteration"))
