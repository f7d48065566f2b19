"""Connected components over edge tables, and groups dealt out in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Up to so many edges (16 bytes each, some ten times that while they are joined) are finished by one task.
LOCAL_EDGES = 2_000_000


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) of every id in the edges ``a, b``.

    Large and small stars in turn: each id links its larger, then its smaller
    neighbours to the smallest id that it sees. Chains shorten by half or more each
    time, a star is done at once; minima are combined before they move, and each round
    is saved. Once at most ``LOCAL_EDGES`` edges are left, one task finishes them, as rounds
    over so little cost a cluster far more than the work itself.
    """
    current = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while current.limit(LOCAL_EDGES + 1).count() > LOCAL_EDGES:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        kept = saved(large)
        least = kept.groupBy("a").agg(F.min("b").alias("m"))
        small = kept.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        following = saved(small)
        if following.groupBy("a").count().where("count > 1").isEmpty() and following.select("a").intersect(following.select("b")).isEmpty():
            return following.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(following.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        current = following
    return saved(current.coalesce(1).mapInArrow(_in_one_task, "id long, component long"))


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of a bounded number of edges: each node takes the smallest label beside it, and that node's label."""
    parts = [np.stack([batch.column(c).to_numpy() for c in "ab"]) for batch in batches if batch.num_rows]
    if not parts:
        return
    ids, ends = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    a, b = ends.reshape(2, -1)
    label = np.arange(len(ids))
    while (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        for side in (a, b):
            np.minimum.at(label, label[side], least)
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["id", "component"])


def paired_chunks(members: DataFrame, key: str, member: str, weight: str, most: float) -> DataFrame:
    """``members`` with ``left, right``: every pair of members of one ``key`` meets in at least one (key, left, right).

    A key of more than ``most`` weight is dealt into chunks by a hash of the member, and
    each pair of chunks is a group of its own, so a group holds about twice ``most``.
    """
    size = members.groupBy(key).agg(F.sum(weight).alias("_w"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("_w") / most)).cast("int")
    dealt = members.join(size, key).withColumn("_n", chunks).withColumn("chunk", F.pmod(F.xxhash64(member, F.lit(11)), F.col("_n")).cast("int"))
    # with n > 1 chunks each pair (i, j), i < j, holds both chunks whole; with one chunk there is (0, 0)
    other = F.expr("case when _n = 1 then array(0) else filter(sequence(0, _n - 1), x -> x <> chunk) end")
    return dealt.withColumn("_o", F.explode(other)).withColumn("left", F.least("chunk", "_o")).withColumn("right", F.greatest("chunk", "_o")).drop("_w", "_n", "_o")
