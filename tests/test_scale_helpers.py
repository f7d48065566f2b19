"""Running numbers, quantiles and duplicate search on skewed keys."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterledger.functions.quantiles import exact_quantile
from rasterledger.functions.ranking import crowded, running_number, salted_lookup
from rasterledger.operators import evidence as ev


@pytest.fixture(scope="module")
def skewed(spark):
    n = F.col("id")
    return spark.range(30000).select(F.when(n % 3 == 0, 0).otherwise(n % 50).alias("k"), n.alias("i"), (n * 7919 % 13).alias("score"), (n * 31 % 997).alias("v")).cache()


def test_running_number_per_key(skewed):
    got = running_number(skewed, ["k"], [], "i", "rn").withColumn("want", F.row_number().over(W.partitionBy("k").orderBy("i")))
    assert got.where("rn <> want").isEmpty() and got.count() == 30000


def test_running_number_whole_table(skewed):
    got = running_number(skewed, [], [(F.col("score"), True)], "i", "rn").withColumn("want", F.row_number().over(W.orderBy(F.desc("score"), "i")))
    assert got.where("rn <> want").isEmpty() and got.count() == 30000


def test_running_number_in_bands(skewed):
    wide = skewed.withColumn("y", F.col("v") * 3)
    got = running_number(wide, ["k"], [(F.col("y"), False)], "i", "rn", coarse=F.floor(F.col("y") / 100))
    got = got.withColumn("want", F.row_number().over(W.partitionBy("k").orderBy("y", "i")))
    assert got.where("rn <> want").isEmpty() and got.count() == 30000 and got.columns == [*wide.columns, "rn", "want"]
    hashed = wide.withColumn("h", F.md5(F.col("i").cast("string")))
    got = running_number(hashed, ["k"], [(F.col("y"), False)], "h", "rn", F.substring("h", 1, 1), F.floor(F.col("y") / 100))
    assert got.withColumn("want", F.row_number().over(W.partitionBy("k").orderBy("y", "h"))).where("rn <> want").isEmpty()


@pytest.mark.parametrize("q", [0.0, 0.5, 0.7, 0.85, 1.0])
def test_exact_quantile(skewed, q):
    got = {r.k: r.quantile for r in exact_quantile(skewed, ["k"], "v", q, F.floor(F.col("v") / 50)).collect()}
    pdf = skewed.toPandas()
    for k, part in pdf.groupby("k"):
        assert got[k] == pytest.approx(np.percentile(part["v"], q * 100))


def test_duplicates_of_a_hot_key(skewed):
    assert ev.duplicates(skewed.select("k", "i"), ["k"], ["i"]).count() == 30000 - skewed.select("k").distinct().count()


def test_salted_lookup_equals_join(skewed):
    small = skewed.groupBy("k").agg(F.max("i").alias("top"))
    assert salted_lookup(skewed, small, ["k"]).agg(F.sum("top")).collect() == skewed.join(small, "k").agg(F.sum("top")).collect()


def test_changed_keys(spark):
    req = spark.createDataFrame([("a", "1", "f"), ("a", "1", "f"), ("b", "2", "f"), ("c", "3", "f")], "key string, sha256 string, fingerprint string")
    cache = spark.createDataFrame([("a", "1", "f"), ("b", "2", "old"), ("c", "0", "f")], "key string, sha256 string, fingerprint string")
    assert sorted(r.key for r in ev.changed_keys(req, cache).collect()) == ["b", "c"]


def test_exact_copies_are_counted(spark):
    rows = spark.createDataFrame([(1, "a")] * 4 + [(1, "b"), (2, "c"), (3, None), (3, None)], "k bigint, o string")
    assert sorted((r.k, r.o or "") for r in ev.duplicates(rows, ["k"], ["o"]).collect()) == [(1, "a")] * 3 + [(1, "b"), (3, "")]
    both = ev.merge_partitions([rows, rows.where("k = 2")], "k", ["o"])
    assert both.where("NOT duplicate").count() == 3 and both.count() == 9


def _exchanged(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_few_rows_per_key_move_once(spark):
    """Keys with few rows each: rows move once and the first of a key goes back to no salts."""
    rows = spark.range(20000).select((F.col("id") % 9000).alias("k"), F.col("id").alias("i"))
    found = ev.duplicates(rows, ["k"], ["i"])
    assert found.count() == 11000 and _exchanged(found) == 1


def test_null_keys_are_a_key(spark):
    """Rows of null keys are numbered as SQL does, however many there are."""
    for n in (10, 20000):
        rows = spark.range(n).select(F.lit(None).cast("bigint").alias("k"), F.col("id").alias("i"))
        assert ev.duplicates(rows, ["k"], ["i"]).count() == n - 1
        assert running_number(rows, ["k"], [], "i").agg(F.max("rn")).first()[0] == n


def test_running_number_of_small_and_hot_keys(spark):
    """One exchange where keys hold few rows; the same numbers where one key holds most rows."""
    even = spark.range(20000).select((F.col("id") % 5000).alias("k"), (F.col("id") * 7919 % 20000).alias("i"))
    number = lambda df: running_number(df, ["k"], [(F.col("i") % 10, True)], "i")
    assert _exchanged(number(even)) == 1
    hot = even.withColumn("k", F.when(F.col("i") % 3 > 0, F.lit(-1)).otherwise(F.col("k")))
    assert crowded(hot, ["k"]) is not None
    want = hot.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy(F.desc(F.col("i") % 10), "i")).cast("bigint"))
    assert number(hot).exceptAll(want).isEmpty() and number(hot).count() == 20000


def _exchanged(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
