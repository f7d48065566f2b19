"""From raw surfaces to slide status: the flagship job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import vocab
from ..operators import pixels, severity


def assess_slides(surfaces: DataFrame, signals: DataFrame, mode: str = "qa-polish", threshold: float = 0.08,
                  profile: dict = vocab.CALIBRATION) -> DataFrame:
    """Status, severity and confidence per slide."""
    metrics = pixels.compare_surfaces(surfaces, threshold)
    return severity.slide_severity(metrics, signals, mode, profile)


def plan_fixes(surfaces: DataFrame, signals: DataFrame, tags: DataFrame, threshold: float = 0.08,
               profile: dict = vocab.CALIBRATION) -> DataFrame:
    """Repair advice for every comparison that is noticeable or blocking."""
    metrics = pixels.compare_surfaces(surfaces, threshold)
    return severity.fix_plan(severity.classify_comparison(metrics, signals, profile), tags)
