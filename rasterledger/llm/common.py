"""Shared helpers of the training-data operators: tables, saved steps, byte-sized batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder

BATCH_BYTES = 1 << 20
#: The size of the map in ``maybe_among``; a row of it holds 64 bits.
MAP_BITS = 24
#: What gives back memory that a Python worker keeps for other work; called where that work is over.
RELEASE: list[Callable[[], None]] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most_rows: int = 300_000, of: DataFrame | None = None) -> DataFrame:
    """A broadcast hint behind a count of ``df`` or of the rows ``of`` that its lists hold (saved rows of a few bytes); beyond the bound the join shuffles."""
    return F.broadcast(df) if (df if of is None else of).limit(most_rows + 1).count() <= most_rows else df


def maybe_among(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str, name: str) -> DataFrame:
    """``df`` with ``name``: false only where ``key`` is no ``wanted_key`` of ``wanted``.

    A bit map of 2 ** ``MAP_BITS`` bits, 64 to a row, goes to all tasks whatever the number of wanted keys, so that
    rows which a join would not find are left out before they move."""
    bit = lambda column: F.xxhash64(column).bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    held = wanted.select(bit(wanted_key).alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_bit & 63 as int)))").alias("_held"))
    marked = df.withColumn("_bit", bit(key)).join(F.broadcast(held), F.shiftright("_bit", 6) == F.col("_word"), "left")
    return marked.withColumn(name, F.expr("coalesce(shiftright(_held, cast(_bit & 63 as int)) & 1, 0) = 1")).drop("_bit", "_word", "_held")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo ``n``; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def texts(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Nulls become empty texts; one contiguous array."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return pc.fill_null(array, "") if array.null_count else array


def byte_lengths(array: pa.Array) -> np.ndarray:
    return pc.binary_length(array).to_numpy(zero_copy_only=False).astype(np.int64)


def raw_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the n+1 offsets between them; ``array`` holds no null."""
    for release in RELEASE:
        release()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if len(array) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def by_bytes(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes of text (a longer text is alone), a row counting as 256 more; rows keep their order."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 256
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
