"""Connected components against union-find; hot centres, chains, and files that rounds leave."""

import random
from pathlib import Path

import pytest

from rasterledger.functions import rounds, stars


def plain(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k, u, v in edges:
        if u != v:
            a, b = sorted((find((k, u)), find((k, v))))
            up[b] = a
    return sorted((*x, find(x)[1]) for x in list(up))


def some(rnd):
    edges = [(1, 7, i) for i in range(100, 400)] + [(1, i, 5) for i in range(100, 104)]  # one hot centre
    edges += [(2, i, i + 1) for i in range(120)]  # a chain
    edges += [(3, rnd.randrange(300), rnd.randrange(300)) for _ in range(200)]
    edges += [(4, 900 - i, i) for i in range(60)] + [(4, 3, 3), (4, 1, 899), (4, 1, 899)]
    edges += [(5, 50 + i % 5, i) for i in range(45)] + [(6, 1, 1)]
    return edges


@pytest.mark.parametrize(("least_hot", "local"), [(4096, 50_000), (8, 150)])
def test_against_union_find(spark, monkeypatch, least_hot, local):
    for f in (stars.with_least, stars.flagged):
        monkeypatch.setattr(f, "__defaults__", (least_hot,))
    edges = some(random.Random(1))
    df = spark.createDataFrame([*edges, (None, 1, 2), (9, None, 4)], "slide bigint, u bigint, v bigint")
    assert sorted(tuple(r) for r in stars.components(df, ["slide"], local).collect()) == plain(edges)
    assert stars.components(df.limit(0), ["slide"]).count() == 0


def test_edges_of_hot_nodes_do_not_move(spark):
    """Of a star with most of all edges, only other nodes' edges reach an exchange of the join."""
    edges = spark.range(1, 9000).selectExpr("1L slide", "id a", "0L b").unionByName(spark.range(1, 50).selectExpr("2L slide", "id a", "id - 1 b"))
    both = edges.unionByName(edges.selectExpr("slide", "b a", "a b"))
    out = stars.with_least(both, ["slide"], 2 * 9048, least_hot=500)
    assert out.count() == both.count() and out.where("m > least(a, b)").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_earlier_rounds_are_removed(spark, monkeypatch):
    made = []
    start = rounds.Rounds.__init__

    def noted(self, session):
        start(self, session)
        made.append(self)

    monkeypatch.setattr(rounds.Rounds, "__init__", noted)
    out = stars.components(spark.range(60).selectExpr("1L slide", "id u", "id + 1 v"), ["slide"], local=0)
    assert out.where("label <> 0").count() == 0 and out.count() == 61
    (own,) = made
    left = [p for p in Path(own.root.removeprefix("file:")).iterdir() if p.is_dir()]
    assert own.n > 10 and len(left) <= own.n // 3
