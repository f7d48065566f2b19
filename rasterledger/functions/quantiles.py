"""Exact quantiles that never gather one group's values in one task.

The built-in ``percentile`` holds every distinct value of a group in a single
buffer. Here values are first counted (map-side combine), then located through a
coarse histogram with a bounded number of buckets per group, and only the bucket
that holds the wanted rank is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exact_quantile(values: DataFrame, keys: list[str], value: str, q: float, bucket: Column, out: str = "quantile",
                   weight: str | None = None) -> DataFrame:
    """Linear-interpolation quantile per ``keys``.

    ``bucket`` must be a non-decreasing function of ``value`` with a bounded
    number of results; ``weight`` is an optional count column.
    """
    cnt = F.sum(weight) if weight else F.count(F.lit(1))
    counted = (values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(cnt.alias("_n"))
               .withColumn("_bucket", F.coalesce(bucket, F.lit(-1))))  # never null: both uses below then share one exchange
    per_bucket = counted.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_bn"))
    upto = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*keys)
    located = (per_bucket
               .withColumn("_end", F.sum("_bn").over(upto))
               .withColumn("_total", F.sum("_bn").over(whole))
               .withColumn("_pos", F.lit(q) * (F.col("_total") - 1))
               .withColumn("_lo", F.floor("_pos"))
               .withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_total") - 1))
               .withColumn("_start", F.col("_end") - F.col("_bn"))
               .where((F.col("_lo") < F.col("_end")) & (F.col("_hi") >= F.col("_start")))
               .select(*keys, "_bucket", "_start", "_pos", "_lo", "_hi"))
    inside = W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = (counted.join(located, [*keys, "_bucket"])
              .withColumn("_to", F.col("_start") + F.sum("_n").over(inside))
              .withColumn("_from", F.col("_to") - F.col("_n")))
    v = F.col(value).cast("double")
    picked = ranked.groupBy(*keys).agg(
        F.max(F.when((F.col("_lo") >= F.col("_from")) & (F.col("_lo") < F.col("_to")), v)).alias("_vlo"),
        F.max(F.when((F.col("_hi") >= F.col("_from")) & (F.col("_hi") < F.col("_to")), v)).alias("_vhi"),
        F.max(F.col("_pos") - F.col("_lo")).alias("_frac"),
    )
    return picked.select(*keys, (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias(out))
