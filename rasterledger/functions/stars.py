"""Connected components: small groups by union-find in bounded Arrow groups, others by alternating large and small stars."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import Rounds

#: A node with more than one in so many of all edge ends is hot; there are never more hot nodes than this.
HOT_SHARE = 4096
#: Fewer edges than this never make a node hot.
HOT_LEAST = 4096
#: A group of up to so many edges is finished by one task.
LOCAL_EDGES = 50_000


def with_least(edges: DataFrame, keys: list[str], rows: int, least_hot: int = HOT_LEAST) -> DataFrame:
    """``edges`` (``keys, a, b``) with ``m``, the smallest of ``a`` and its ``b``.

    Minima are combined before they move. The edges of hot nodes do not move at all:
    at most ``HOT_SHARE`` nodes have more than ``rows / HOT_SHARE`` edges, so their minima are
    broadcast; the others join by key, and no key has more rows than that.
    """
    bound = max(least_hot, rows // HOT_SHARE)
    if rows <= bound:  # no node can be hot
        plain = edges.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        return edges.join(plain.select(*keys, "a", F.least("a", "m").alias("m")), [*keys, "a"])
    least = edges.groupBy(*keys, "a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).select(*keys, "a", F.least("a", "m").alias("m"), (F.col("degree") > bound).alias("hot"))
    hot = F.broadcast(least.where("hot").drop("hot"))
    named = [*keys, "a"]
    warm = edges.join(hot, named, "left")
    rest = warm.where("m is null").drop("m").join(least.where("not hot").drop("hot"), named)
    return warm.where("m is not null").select(*named, "b", "m").unionByName(rest.select(*named, "b", "m"))


def flagged(edges: DataFrame, keys: list[str], end: str, members: DataFrame, rows: int, least_hot: int = HOT_LEAST) -> DataFrame:
    """``edges`` with ``flag``: is the node at ``end`` among ``members`` (``keys, c``, distinct)? Hot nodes are looked up in a bounded broadcast."""
    named = [*keys, end]
    known = members.select(*keys, F.col("c").alias(end), F.lit(True).alias("flag"))
    if rows <= max(least_hot, rows // HOT_SHARE):
        return edges.join(known, named, "left").fillna(False, ["flag"])
    hot = edges.groupBy(*named).agg(F.count("*").alias("n")).where(F.col("n") > max(least_hot, rows // HOT_SHARE)).drop("n")
    warm = edges.join(F.broadcast(hot.join(known, named, "left").fillna(False, ["flag"])), named, "left")
    rest = warm.where("flag is null").drop("flag").join(known, named, "left").fillna(False, ["flag"])
    return warm.where("flag is not null").select(*edges.columns, "flag").unionByName(rest.select(*edges.columns, "flag"))


def _in_one_task(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The same by union-find, for groups of a bounded number of edges ``keys, a, b`` with whole-number nodes."""
    kinds = [(f.name, f.dataType.simpleString()) for f in edges.schema if f.name in keys]

    def solve(group: pa.Table) -> pa.Table:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (higher := up.setdefault(x, x)) != x:
                up[x] = up[higher]
                x = up[x]
            return x

        for u, v in zip(group["a"].to_pylist(), group["b"].to_pylist(), strict=True):
            x, y = top(u), top(v)
            up[max(x, y)] = min(x, y)
        out = {k: pa.repeat(group[k][0], len(up)) for k, _ in kinds}
        return pa.table(out | {"node": pa.array(list(up), pa.int64()), "label": pa.array([top(x) for x in list(up)], pa.int64())})

    return edges.groupBy(*keys).applyInArrow(solve, ", ".join(f"{k} {t}" for k, t in kinds) + ", node long, label long")


def components(edges: DataFrame, keys: list[str], local: int = LOCAL_EDGES) -> DataFrame:
    """``keys, node, label`` of every node in the edges ``keys, u, v`` (whole numbers): the smallest node that it is linked with.

    Groups of at most ``local`` edges are solved where they are, one task each. In the others, rounds of stars
    follow: in a large star a node hangs its larger neighbours on the smallest one it sees, in a small star its
    smaller ones and itself. A star is done in one round, a chain shortens by half or more. What has become a
    star is set aside, so later rounds carry unfinished components only. Edges with a null in keys or ends are left out.
    """
    rounds = Rounds(edges.sparkSession)
    whole = edges.where("u <> v").dropna(subset=keys)
    every = rounds.save(whole.select(*keys, F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), lasting=True)
    large = every.groupBy(*keys).count().where(F.col("count") > local).drop("count")
    if large.isEmpty():
        return _in_one_task(every, keys)
    # at most one group in ``local`` edges is large, so this list is short beside the edges
    small_groups = _in_one_task(every.join(large, keys, "left_anti"), keys)
    return small_groups.unionByName(_by_stars(rounds, rounds.save(every.join(large, keys, "left_semi")), keys))


def _by_stars(rounds: Rounds, current: DataFrame, keys: list[str]) -> DataFrame:
    done: list[DataFrame] = []
    while rows := 2 * current.count():
        both = current.unionByName(current.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, keys, rows).where("b > a").select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        kept = rounds.save(large.where("a <> b").distinct())
        ends = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")
        small = rounds.save(with_least(kept, keys, rows).select(*keys, ends).select(*keys, "e.*").where("a <> b").distinct())
        # a star is finished if nothing is below its centre and its leaves hang on it alone
        many = small.groupBy(*keys, "a").agg(F.count("*").alias("n")).where("n > 1").select(*keys, F.col("a").alias("c"))
        centres = small.select(*keys, F.col("b").alias("c")).distinct()
        middle = flagged(small, keys, "a", centres, rows).where("flag").select(*keys, F.col("a").alias("c"))
        loose = rounds.save(many.unionByName(middle).distinct())
        below = flagged(small, keys, "a", loose, rows).where("flag").select(*keys, F.col("b").alias("c"))
        moving = rounds.save(loose.unionByName(below).distinct())
        split = flagged(small, keys, "b", moving, rows)
        done.append(rounds.save(split.where("not flag").drop("flag"), lasting=True))
        current = rounds.save(split.where("flag").drop("flag"))
        rounds.keep_last(1)
    stars = reduce(DataFrame.unionByName, done, current)
    return stars.select(*keys, F.col("a").alias("node"), F.col("b").alias("label")).unionByName(stars.select(*keys, F.col("b").alias("node"), F.col("b").alias("label")).distinct())
