"""Best-fit packing by minimum bin slack.

Documents become token pieces (ids, then the end id; only longer ones are cut). A
bin is filled with the fullest combination of the available lengths, found by a
subset-sum program over a bit set: bit s of the set says that some pieces sum to s.
The combination is removed as often as the lengths last, so the plan has at most a
few lines per length however many documents there are, and only the counts per
length (at most ``capacity`` numbers) meet on the driver. Pieces get running
numbers per length by blocks, never by one window over a length, and find their
place in the plan with a binary search.

Null text is an empty document (one piece: the end id). Repeated rows are packed
each for itself. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, saved, texts
from .tokens import ENCODED_BYTES, encoder

PIECES = "id long, piece int, start long, length int, ids_crc32 long"
PLACED = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
BLOCK_ROWS = 50_000


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece of at most ``capacity`` tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, False)
        for batch in batches:
            for part in by_bytes(batch, limit=ENCODED_BYTES):
                ids, bounds = enc.encode(texts(part.column("text")).to_pylist())
                sizes = np.diff(bounds) + 1
                tail = np.array([end_id], "<u4").tobytes()
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(capacity, sizes[row] - start)
                crc = np.zeros(len(row), np.int64)
                for k, (i, s, n) in enumerate(zip(row.tolist(), start.tolist(), length.tolist(), strict=True)):
                    own = ids[bounds[i] + s : min(bounds[i] + s + n, bounds[i + 1])]
                    crc[k] = zlib.crc32(own.astype("<u4").tobytes() + (tail if s + n == sizes[i] else b""))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc)], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(cut, PIECES)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, longest first, whose sum is the largest one not over ``room`` that ``counts`` allows."""
    mask = (1 << (room + 1)) - 1
    reached, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            more = (reached | reached << length) & mask
            if more == reached:
                break
            steps.append((length, reached))
            reached = more
            if reached >> room & 1:
                break
        if reached >> room & 1:
            break
    left, chosen = reached.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> left & 1:
            chosen.append(length)
            left -= length
    return sorted(chosen, reverse=True)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots ``(length, first rank, number of ranks, first sequence, offset)`` and the number of sequences.

    Each bin holds the longest length left and the fullest combination beside it.
    """
    left, used, slots, sequence = {k: v for k, v in counts.items() if v}, dict.fromkeys(counts, 0), [], 0
    while left:
        first = max(left)
        rest = dict(left)
        rest[first] -= 1
        if not rest[first]:
            del rest[first]
        chosen = [first, *fullest(rest, capacity - first)]
        need = {x: chosen.count(x) for x in chosen}
        times = min(left[x] // n for x, n in need.items())
        offset = 0
        for length in chosen:
            slots.append((length, used[length], times, sequence, offset))
            used[length] += times
            offset += length
        for length, n in need.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequence += times
    return slots, sequence


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every document."""
    pieces = saved(token_pieces(docs, path, capacity, end_id, id_column, text_column).withColumn("at", F.monotonically_increasing_id()))
    by_length = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    counts = {r["length"]: r["n"] for r in by_length}
    slots, _ = plan(counts, capacity)
    slots.sort()
    length, rank, _, sequence, offset = (np.array(x, np.int64) for x in zip(*slots, strict=True)) if slots else (np.zeros(0, np.int64),) * 5
    key = (length << 44) + rank

    blocks = max(1, -(-max(counts.values(), default=1) // BLOCK_ROWS))
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int"))
    before = blocked.groupBy("length", "block").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = (
        blocked.withColumn("nr", F.row_number().over(Window.partitionBy("length", "block").orderBy("at")))
        .join(before.select("length", "block", F.coalesce("before", F.lit(0)).alias("before")), ["length", "block"])
        .select("id", "piece", "start", "length", "ids_crc32", (F.col("nr") - 1 + F.col("before")).cast("long").alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_length = batch.column("length").to_numpy().astype(np.int64)
            own_rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, (own_length << 44) + own_rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "piece", "start")), pa.array(own_length), batch.column("ids_crc32"), pa.array(sequence[at] + own_rank - rank[at]), pa.array(offset[at])], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PLACED)
