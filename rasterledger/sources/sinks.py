"""Sinks: result tables and report lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def write_evidence(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write through Spark's commit protocol. Partition by a column of few values
    (a deck or a status), not by slide number, or a large run makes as many folders."""
    writer = df.write.mode("overwrite").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


SCHEMA_VERSION = "rasterledger.evidence.v1"


def publish(df: DataFrame, path: str, partition_by: list[str], version: str = SCHEMA_VERSION) -> None:
    """Replace the partitions (a deck, a status) that ``df`` has rows of and leave all others as they are.

    Files are staged and moved on commit, so a job that fails leaves the table as it was. Every
    row carries ``schema_version``.
    """
    rows = df.withColumn("schema_version", F.lit(version))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def read_published(spark: SparkSession, path: str, version: str = SCHEMA_VERSION) -> DataFrame:
    """A published table; an error where rows of another version (or of none) are found."""
    rows = spark.read.parquet(path)
    if "schema_version" not in rows.columns:
        raise ValueError(f"{path} has no schema version")
    others = [r[0] for r in rows.where(~c("schema_version").eqNullSafe(version)).select("schema_version").distinct().limit(3).collect()]
    if others:
        raise ValueError(f"{path} holds schema versions {others}, not {version}")
    return rows.drop("schema_version")


def report_lines(slides: DataFrame, metrics: DataFrame, issues: DataFrame, mode: str = "qa-polish") -> DataFrame:
    """Text report as rows ``slide, section, place, line``; sort by these to print.

    Rows, not one string per slide, so a slide with very many issues stays spread.
    """
    def text(v):
        return F.format_string("%.4f", v)

    head = slides.select("slide", F.lit(0).alias("section"), F.posexplode(F.array(
        F.concat(F.lit("# Slide "), c("slide").cast("string"), F.lit(" Visual Polish Report")),
        F.concat(F.lit("- Mode: `" + mode + "`")), F.concat(F.lit("- Status: `"), "status", F.lit("`")),
        F.concat(F.lit("- Severity: `"), "severity", F.lit("`")), F.lit("## Metrics"))).alias("place", "line"))
    order = F.when(c("comparison") == "pptx_vs_source", 0).when(c("comparison") == "html_vs_source", 1).otherwise(2)
    body = metrics.select("slide", F.lit(1).alias("section"), order.alias("place"), F.concat(
        F.lit("- "), "comparison", F.lit(": pixel_diff="), text(c("pixel_difference_ratio")), F.lit(", mae="), text(c("mean_absolute_error")),
        F.lit(", edge_diff="), text(c("edge_difference_ratio")), F.lit(", ssim="), F.coalesce(text_or_none("approx_ssim"), F.lit("unavailable")),
        F.lit(", palette_drift="), text(c("color_palette_drift"))).alias("line"))
    tail = issues.select("slide", F.lit(2).alias("section"), order.alias("place"), F.concat(
        F.lit("- ["), "severity", F.lit("/"), "type", F.lit("] fix strategy: "), "fix_strategy", F.lit("; crop allowed: "),
        F.when(c("crop_allowed"), "yes").otherwise("no")).alias("line"))
    return head.unionByName(body).unionByName(tail)


def text_or_none(name: str):
    return F.when(c(name).isNotNull(), F.format_string("%.4f", c(name)))
