"""Top-k against scores of all pairs; blocks really are skipped."""

import math

import numpy as np
from pyspark.sql import functions as F

from rasterledger.llm import topk


def _plain(rows, k):
    held = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows]
    out = []
    for at, (q, own) in enumerate(held):
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for other, (i, v) in enumerate(held) if other != at)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def _run(spark, rows, k=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0, k).collect()))


def test_all_pairs(spark, rng, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 150)
    vectors = {i: [rng.gauss(0, 1) for _ in range(rng.choice([7, 8]))] for i in range(0, 900, 2)}
    vectors |= {i: [0.5] * 8 for i in range(1, 300, 2)}  # ties
    rows = [(i, v, "x") for i, v in vectors.items()]
    odd = [(1000, None, "x"), (1001, [1.0, None], "x"), (1100, [float("nan")], "x"), (1102, [float("inf")], "x"), (None, [1.0], "x")]
    again = rows[:5] + [(0, [3.0] * 8, "x"), (2, [-1.0] * 7, "x"), (100, [2.0] * 8, "x")]  # repeated rows, and ids with another vector
    assert _run(spark, rows + again + odd) == _plain(rows + again, 10)


def test_few_rows_and_large_numbers(spark):
    assert _run(spark, []) == []
    assert _run(spark, [(100, [1.0], "x")]) == []
    vectors = {0: [2.0**30 + 1, 3.0], 1: [2.0**12 + 1 / 1024, -1.0], 2: [0.0, 5e-4]}
    rows = [(i, v, "x") for i, v in vectors.items()]
    assert _run(spark, rows) == _plain(rows, 10)


def test_blocks_below_the_kth_score_are_not_read():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 400, (40, 16)).round()
    values = (np.repeat(centres, 100, 0) + rng.normal(0, 20, (4000, 16))).round()
    shard = topk.Shard(np.arange(4000), np.arange(4000), values)
    blocks = []
    for q in range(0, 4000, 200):
        bound = np.maximum(values[q], 0) @ shard.most.T + np.minimum(values[q], 0) @ shard.least.T
        _, scores, read = shard.search(q, values[q], bound, 10)
        plain = values @ values[q]
        plain[q] = -np.inf
        assert scores.tolist() == np.sort(plain)[::-1][:10].tolist()
        blocks.append(read)
    assert np.mean(blocks) <= len(shard.starts) / 3
