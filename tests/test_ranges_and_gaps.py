"""Traces with huge ranges, free numbers among huge used ones, statuses of unlisted slides, publishing of partitions."""

import random

import pytest
from pyspark.sql import functions as F

from rasterledger.operators import gates, regions, texts
from rasterledger.session import checkpoint_folder
from rasterledger.sources import sinks


def test_trace_values(spark):
    cases = {
        '{"slides":"3-5,4,9"}': [3, 4, 5, 9], '{"slides":[3,"2",2]}': [3, 2, 2], '{"slides":"5-2","x":{"requestedSlides":"2,1-3"}}': [2, 1, 3], '{"a":[{"source_slides":[7,{"x":1}]}]}': [], '{"a":{"Slides":[{"id":4},{"slide":"6"}]}}': [4, 6],
        '{"slides":"99999999999999999999"}': [], '{"slides":1e30}': [], '{"deep":{"slides":"1-"}}': [], '{"deep":{"slides":"4,4-6"}}': [4, 5, 6], "bad": [],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id bigint, trace string")
    found = {}
    for r in sorted(texts.trace_slides(df).collect(), key=lambda r: (r["id"], r["place"])):
        found.setdefault(r["id"], []).append(r["slide"])
    assert [found.get(i, []) for i in range(len(cases))] == list(cases.values())


@pytest.mark.parametrize("doc", ['{"slides":"1-3000000000"}', '{"deep":{"slides":"1-3000000000"}}'])
def test_a_huge_range_is_written_out_in_blocks(spark, doc):
    rows = texts.trace_slides(spark.createDataFrame([(1, doc)], "id bigint, trace string"))
    assert [tuple(r) for r in rows.limit(3).collect()] == [(1, 0, 1), (1, 1, 2), (1, 2, 3)]
    assert texts.trace_slides(spark.createDataFrame([(1, doc.replace("3000000000", "100000"))], "id bigint, trace string")).agg(F.sum("slide"), F.max("place")).first() == (100_000 * 100_001 // 2, 99_999)


def test_free_numbers(spark):
    rnd = random.Random(8)
    used = {1: set(), 2: {1, 2, 3, 7}, 3: {10**9, 5}, 4: set(rnd.sample(range(1, 30_000), 12_000)), 5: set(range(1, 9000)), 6: {2 * i for i in range(1, 5000)}}
    asked = [(s, k) for s, n in ((1, 5), (2, 6), (3, 8), (4, 9000), (5, 3), (6, 9000)) for k in range(1, n + 1)]
    got = regions.free_numbers(spark.createDataFrame(asked, "slide bigint, _k bigint"), spark.createDataFrame([(s, n) for s, own in used.items() for n in own], "slide bigint, num bigint"))
    want, free = [], {}
    for s, own in used.items():
        free[s] = [n for n in range(1, 45_000) if n not in own]
    want = sorted((s, k, free[s][k - 1]) for s, k in asked)
    assert sorted((r["slide"], r["_k"], r["num"]) for r in got.collect()) == want


def test_findings_of_unlisted_slides_stay(spark):
    hits = spark.createDataFrame([("g", 1, "error"), ("g", 3, "error"), ("g", None, "warning")], "gate string, slide bigint, level string")
    rows = gates.gate_status(hits, spark.createDataFrame([(1,), (2,)], "slide bigint"), "g").collect()
    assert {(r["slide"], r["errors"], r["warnings"], r["status"]) for r in rows} == {(1, 1, 0, "fail"), (2, 0, 0, "pass"), (3, 1, 0, "fail"), (None, 0, 1, "pass")}


def test_publishing_replaces_its_own_partitions(spark, tmp_path):
    path = f"{checkpoint_folder(spark)}/{tmp_path.name}"
    df = spark.createDataFrame([(1, "pass", 1), (2, "fail", 1), (3, "fail", 1)], "slide int, status string, run int")
    sinks.publish(df, path, ["status"])
    sinks.publish(df.where("slide = 2").withColumn("run", F.lit(2)), path, ["status"])
    assert sorted((r["slide"], r["status"], r["run"]) for r in sinks.read_published(spark, path).collect()) == [(1, "pass", 1), (2, "fail", 2)]
    sinks.publish(df.where("slide = 1"), path, ["status"], version="other")
    with pytest.raises(ValueError, match="other"):
        sinks.read_published(spark, path)
    df.write.parquet(f"{path}-plain")
    with pytest.raises(ValueError, match="no schema version"):
        sinks.read_published(spark, f"{path}-plain")


def test_free_numbers_of_crowded_and_other_slides(spark, monkeypatch):
    """Bands of numbers are for crowded slides alone; both ways give the same."""
    used = {1: [*range(1, 9000, 3)], 2: [1, 2, 5], 3: [7], 4: []}
    asked = [(s, k) for s, n in ((1, 7000), (2, 4), (3, 8), (4, 2)) for k in range(1, n + 1)]
    want = {(s, k): n for s, own in used.items() for k, n in enumerate((n for n in range(1, 20_000) if n not in set(own)), 1) if k <= {1: 7000, 2: 4, 3: 8, 4: 2}[s]}
    left = spark.createDataFrame(asked, "slide bigint, _k bigint")
    right = spark.createDataFrame([(s, n) for s, own in used.items() for n in own], "slide bigint, num bigint")
    banded, bands = [], regions._free_numbers_in_bands
    monkeypatch.setattr(regions, "_free_numbers_in_bands", lambda *sides: banded.append(1) or bands(*sides))
    for hot, times in ((None, 0), (F.col("slide") == 1, 1), (F.col("slide") > 0, 2)):
        monkeypatch.setattr(regions, "crowded", lambda *_, hot=hot: hot)
        assert {(r["slide"], r["_k"]): r["num"] for r in regions.free_numbers(left, right).collect()} == want
        assert len(banded) == times


def test_short_ranges_are_dealt_to_all_tasks(spark):
    """Rows whose ranges start alike do not meet in one task."""
    pieces = spark.range(2000).selectExpr("id", "named_struct('low', 1L, 'high', 2L, 'before', 0L) _p")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = texts.written_out(pieces, ["id"]).withColumn("task", F.spark_partition_id())
        tasks = out.groupBy("task").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 4000


def test_odd_trace_values(spark):
    cases = {
        '{"slides":["x","2"]}': [], '{"slides":["3.7"," 5 ",".5e1"]}': [3, 5, 5], '{"slides":[{"id":"a"},{"slide":3.5},7]}': [3], '{"slides":" [1,2"}': [],
        '{"slides":"[1,2]"}': [1, 2], '{"slides":null,"render":{"slides":"8-9"}}': [8, 9], '{"selectedSlides":"","slides":"4"}': [4], '{"slides":"+3"}': [], '{"slides":"\\t3 - 5"}': [3, 4, 5],
    }
    found = {}
    for r in sorted(texts.trace_slides(spark.createDataFrame(list(enumerate(cases)), "id bigint, trace string")).collect(), key=lambda r: (r["id"], r["place"])):
        found.setdefault(r["id"], []).append(r["slide"])
    assert {i: found.get(i, []) for i in range(len(cases))} == dict(enumerate(cases.values()))


def test_rules_are_tested_once(spark):
    rows = spark.createDataFrame([(1, "needle"), (2, "x"), (3, None)], "slide bigint, x string")
    out = gates.apply_rules(rows, "g", [(F.col("x").rlike("need+le"), "one", "error"), (F.col("x") != "x", "two", "warning")], "slide")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("need+le") == 1
    assert sorted((r["slide"], r["rule"], r["level"]) for r in out.collect()) == [(1, "one", "error"), (1, "two", "warning")]


def test_absent_artifacts_are_read_off_the_flags(spark):
    kinds = gates.vocab.RECONSTRUCTION_ARTIFACTS
    slides = spark.createDataFrame([(1, "reconstruction"), (2, "reconstruction"), (3, "canary"), (4, None)], "slide bigint, quality string")
    present = spark.createDataFrame([(1, k) for k in (*kinds[1:], kinds[1], "other", None)], "slide bigint, kind string")
    out = gates.gate_quality_mode(slides, present, [])
    got = sorted((r["slide"], r["id"], r["rule"]) for r in out.collect())
    assert got == sorted([(1, kinds[0], "missing_artifact"), *((2, k, "missing_artifact") for k in kinds), (3, "3", "no_artifacts"), (4, "4", "invalid_quality")])
    assert "LeftAnti" not in out._jdf.queryExecution().optimizedPlan().toString()
