"""What to repair next, and whether the loop may stop."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import rollup


def next_waves(slides: DataFrame, issues: DataFrame, level: str = "blocking-zero", size: int = 5) -> DataFrame:
    """Repair waves of the slides that the quality level does not accept."""
    return rollup.waves(rollup.repair_score(slides, issues, level), issues, size)


def stop_table(history: DataFrame, level: str = "blocking-zero") -> DataFrame:
    return rollup.convergence(history, level)
