"""Exact top-k inner products by block-at-a-time pruning.

Vectors are rounded to whole numbers and dealt into shards of bounded size. Inside a
shard they are ordered so that neighbours are alike and cut into document-range blocks;
a block keeps the largest and smallest value of each term (component) and its own
forward index. For a query, the summed term maxima bound every score of a block:
blocks are taken in the order of that bound and scored through their forward index
until the bound falls below the kth score. Queries travel in blocks to every shard,
each pair returns at most k rows per query, and the best k of these are kept.

A stated set of queries meets all rows, so the work is queries times vectors by
definition; no task holds more than one query block and one shard.

Vectors that are null, hold a null or non-finite component, or have no id take no
part. Rows are told apart by a number of their own, so rows of one id all take part: each is a
candidate of the others, and each that is a query has its own ranks.
Components beyond a shorter vector's end count as 0. Ties go to the smaller id.
Fewer than k candidates give fewer rows; an empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SHARD_ROWS, QUERY_ROWS, BLOCK = 8192, 512, 64
_PACKED = "id long, width int, rows binary, ids binary, values binary"
_FOUND = "query_row long, query_id long, vec_id long, score long"


def rounded(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 1024) -> DataFrame:
    """``row, vec_id, e``: whole numbers (held as doubles) of all vectors that take part, and a number for each row; to be saved at once."""
    e = F.col("e")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("e"))
        .where(F.col("vec_id").isNotNull() & e.isNotNull() & fine)
        .select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("double")).alias("e"))
    )


def _packed(rows: DataFrame, parts: int) -> DataFrame:
    """One row per group of vectors: ids and values as binary."""

    def pack(group: pa.Table) -> pa.Table:
        table = group.sort_by("vec_id")
        lists = table["e"].combine_chunks()
        own = [np.asarray(x, float) for x in lists.to_pylist()]
        width = max(map(len, own))
        values = np.zeros((len(own), width))
        for i, x in enumerate(own):
            values[i, : len(x)] = x
        return pa.table({"id": table["part"].slice(0, 1), "width": pa.array([width], pa.int32()), "rows": pa.array([table["row"].to_numpy().tobytes()], pa.binary()), "ids": pa.array([table["vec_id"].to_numpy().tobytes()], pa.binary()), "values": pa.array([values.tobytes()], pa.binary())})

    return rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("long")).groupBy("part").applyInArrow(pack, _PACKED)


def alike_order(values: np.ndarray, least: int = BLOCK) -> np.ndarray:
    """An order in which ranges of ``least`` vectors are alike: halves along the most varied component, again and again."""
    done, todo = [], [np.arange(len(values))]
    while todo:
        own = todo.pop()
        if len(own) <= least or values.shape[1] == 0:
            done.append(own)
            continue
        half = max(least, len(own) // 2 // least * least)
        order = own[np.argsort(values[own, values[own].var(0).argmax()], kind="stable")]
        todo += [order[half:], order[:half]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


class Shard:
    def __init__(self, rows: np.ndarray, ids: np.ndarray, values: np.ndarray):
        order = alike_order(values)
        self.rows, self.ids, self.values = rows[order], ids[order], values[order]
        starts = np.arange(0, len(ids), BLOCK)
        self.most, self.least = np.maximum.reduceat(self.values, starts), np.minimum.reduceat(self.values, starts)
        self.ends = np.append(starts[1:], len(ids))
        self.starts = starts

    def search(self, own_row: int, query: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places in the shard and scores of the best k rows other than the query's own, and the number of blocks scored."""
        order = np.argsort(-bound, kind="stable")
        places, scores, at = np.zeros(0, np.int64), np.zeros(0), 0
        while at < len(order):
            kth = scores[-1] if len(scores) >= k else -np.inf
            take = order[at : at + 4]
            take = take[bound[take] >= kth]
            if not len(take):
                break
            new = np.concatenate([np.arange(self.starts[b], self.ends[b]) for b in take])
            new = new[self.rows[new] != own_row]
            places, scores = np.concatenate([places, new]), np.concatenate([scores, self.values[new] @ query])
            best = np.lexsort((self.ids[places], -scores))[:k]
            places, scores = places[best], scores[best]
            at += 4
        return places, scores, at


def _whole(scores: np.ndarray, shard: Shard, places: np.ndarray, query: np.ndarray) -> list[int]:
    """Scores as whole numbers; beyond the exact range of doubles they are added up anew."""
    if np.abs(scores).max(initial=0) < 2**52:
        return scores.astype(np.int64).tolist()
    exact = [sum(int(a) * int(b) for a, b in zip(shard.values[i], query, strict=True)) for i in places]
    return [max(-(2**63), min(2**63 - 1, x)) for x in exact]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, **columns: str) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``is_query`` (on ``vec_id``) its best ``k`` among all other rows."""
    rows = saved(rounded(vectors, **columns))
    n, asked = rows.agg(F.count("*"), F.count_if(is_query)).first()
    shards, chunks = max(1, -(-n // SHARD_ROWS)), max(1, -(-asked // QUERY_ROWS))
    index = _packed(rows, shards).select(F.col("id").alias("shard"), "width", "rows", "ids", "values")
    queries = _packed(rows.where(is_query), chunks).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.col("width").alias("q_width"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                width = max(r["width"], r["q_width"])
                wide = lambda ids, values, own: np.pad(np.frombuffer(values).reshape(len(ids), own), ((0, 0), (0, width - own)))  # noqa: B023, E731
                ids, q_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                q_rows = np.frombuffer(r["q_rows"], np.int64).tolist()
                shard, asked_for = Shard(np.frombuffer(r["rows"], np.int64), ids, wide(ids, r["values"], r["width"])), wide(q_ids, r["q_values"], r["q_width"])
                bounds = np.maximum(asked_for, 0) @ shard.most.T + np.minimum(asked_for, 0) @ shard.least.T
                out: list[tuple[int, int, int, int]] = []
                for row, q, query, bound in zip(q_rows, q_ids.tolist(), asked_for, bounds, strict=True):
                    places, scores, _ = shard.search(row, query, bound, k)
                    out += zip([row] * len(places), [q] * len(places), shard.ids[places].tolist(), _whole(scores, shard, places, query), strict=True)
                columns = list(zip(*out, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_row", "query_id", "vec_id", "score"])

    found = queries.join(index, "shard").mapInArrow(search, _FOUND)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
