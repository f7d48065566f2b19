"""Nearest profile against plain comparison, with nulls, ties and one look for most slides."""

import random

import pytest

from rasterledger.functions import ranking
from rasterledger.operators import evidence as ev

DIMS = ["background", "geometry", "header", "step"]
SHAPE = "id bigint, " + ", ".join(f"{d} string" for d in DIMS)


def plain(slides, library):
    out = []
    for sid, *look in slides:
        best = max(((sum(a is not None and a == b for a, b in zip(look, own, strict=True)), -pid) for pid, *own in library), default=(0, 0))
        out.append((sid, -best[1] if best[0] else None, best[0], "high" if best[0] == 4 else "partial" if best[0] else "none"))
    return sorted(out)


@pytest.mark.parametrize("least", [4096, 3])
def test_against_plain_comparison(spark, monkeypatch, least):
    monkeypatch.setattr(ranking.hot_lookup, "__defaults__", (20, least))
    rnd = random.Random(4)
    values = ["a", "b", 'c"]', None, "|"]
    slides = [(i, *(rnd.choice([*values, "own"]) for _ in DIMS)) for i in range(150)] + [(i, "a", "b", "a", "b") for i in range(150, 400)] + [(400, None, None, None, None)]
    library = [(i, *(rnd.choice(values) for _ in DIMS)) for i in range(30)] + [(90, "a", "b", "a", "b"), (80, "a", "b", "a", "b")]
    s, lib = spark.createDataFrame(slides, SHAPE), spark.createDataFrame(library, SHAPE)
    assert sorted(tuple(r) for r in ev.style_match(s, lib, DIMS).collect()) == plain(slides, library)
    assert sorted(tuple(r) for r in ev.style_match(s, lib.limit(0), DIMS).collect()) == plain(slides, [])


def test_rows_of_hot_keys_stay_in_place(spark):
    big = spark.range(50_000).selectExpr("case when id < 30000 then 1 else id end k", "id v")
    small = spark.range(0, 60_000, 2).selectExpr("id k", "id * 10 w")
    out = ranking.hot_lookup(big, small, ["k"])
    assert out.where("w is null").count() == 30_000 + 10_000 and out.count() == 50_000
    assert out.where("k > 1 and k % 2 = 0 and w <> k * 10").count() == 0
    again = ranking.hot_lookup(big, small.unionByName(spark.sql("select 1L k, 7L w")), ["k"])
    assert again.where("k = 1 and w = 7").count() == 30_000
