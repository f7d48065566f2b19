"""Benchmark decontamination by random-walk embeddings and bit sampling.

Texts and benchmark items are sequences of words (letters, digits and all non-ASCII,
lower-cased). A CGK walk reads a sequence from a window's start: at step j it puts out
the word under the pointer and moves on by a random bit that depends on j and that
word, so few edits change few outputs: edit distance becomes Hamming distance. Each
repeat draws another walk and samples a few of its steps; windows whose samples equal
those of an item are candidates. A window that cannot match any item at the sampled
steps so far is walked no further. Windows start at every word and have the size of
the item. Candidates are verified: the edit distance in words between item and window
must be at most ``share`` of the item's words.

The texts never move: items go to the tasks in blocks of at most ``block_items``, one
pass over the texts for each block. Repeats and samples are set so that recall within
the edit bound is at least 0.9 (measured in the tests); an unedited passage is found by
every repeat.

Null or empty texts match nothing. Items that are null or have fewer than
``least_words`` words are not searched. Repeated texts and repeated items each give
their rows; empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, raw_bytes, texts
from .edits import prefix_distances
from .hashing import PUNCTUATION, mix, span_hashes, word_spans

REPEATS, SAMPLES, SHARE, LEAST_WORDS, BLOCK_ITEMS = 8, 4, 0.15, 5, 5000
_TABLE = 1 << 16
MATCHES = "id long, item_id long, start_word long, edit_distance int, item_words int"


def sequences(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, each text closed by a 0, and the n+1 bounds (a text's 0 is its last)."""
    body, offsets = raw_bytes(pc.utf8_lower(texts(array)))
    starts, ends, bounds = word_spans(body, offsets, PUNCTUATION)
    n, sizes = len(bounds) - 1, np.diff(bounds)
    out = np.zeros(len(starts) + n, np.uint64)
    out[np.arange(len(starts)) + np.repeat(np.arange(n), sizes)] = span_hashes(body, starts, ends)
    return out, bounds + np.arange(n + 1)


def _walk(coins: np.ndarray, at: np.ndarray, first: int, last: int) -> np.ndarray:
    """Pointers after the steps ``first`` to ``last`` - 1; the closing 0 never moves on."""
    for j in range(first, last):
        at = at + ((coins[at] >> np.uint64(3 + j % 59)) & np.uint64(1)).astype(np.int64)
    return at


class _Repeat:
    """One walk with its sampled steps: two early ones for all items, the rest by size class of the items."""

    def __init__(self, seed: int, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, samples: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.factor = rng.integers(1, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.early = sorted(rng.choice(6, 2, replace=False).tolist())
        coins = words * self.factor
        a = _walk(coins, starts, 0, self.early[0])
        b = _walk(coins, a, self.early[0], self.early[1])
        self.one, self.two = np.zeros(_TABLE, bool), np.zeros(_TABLE, bool)
        self.one[words[a] & np.uint64(_TABLE - 1)] = True
        pair = mix(words[a] * np.uint64(3) + words[b], 1)
        self.two[pair & np.uint64(_TABLE - 1)] = True
        self.classes = []
        kind = np.floor(np.log(sizes) / np.log(1.5)).astype(int)
        for k in np.unique(kind):
            own = np.flatnonzero(kind == k)
            room = np.arange(self.early[1] + 1, max(self.early[1] + samples, int(1.5 * sizes[own].min())))
            late = sorted(rng.choice(room, min(samples - 2, len(room)), replace=False).tolist())
            key = self._late(words, coins, b[own], pair[own], late)
            order = np.argsort(key, kind="stable")
            self.classes.append((late, key[order], own[order]))

    def _late(self, words: np.ndarray, coins: np.ndarray, at: np.ndarray, key: np.ndarray, late: list[int]) -> np.ndarray:
        step = self.early[1]
        for j in late:
            at = _walk(coins, at, step, j)
            key, step = mix(key * np.uint64(3) + words[at], 2), j
        return key

    def candidates(self, words: np.ndarray, low: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items with equal samples."""
        coins = words * self.factor
        at = _walk(coins, windows, 0, self.early[0])
        keep = self.one[low[at]]
        windows, at = windows[keep], at[keep]
        first = words[at]
        at = _walk(coins, at, *self.early)
        pair = mix(first * np.uint64(3) + words[at], 1)
        keep = self.two[pair & np.uint64(_TABLE - 1)]
        windows, at, pair = windows[keep], at[keep], pair[keep]
        found, items = [], []
        for late, keys, own in self.classes:
            key = self._late(words, coins, at, pair, late)
            left, right = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            hit = np.flatnonzero(right > left)
            times = (right - left)[hit]
            found.append(np.repeat(windows[hit], times))
            items.append(own[np.repeat(left[hit] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))])
        return np.concatenate(found), np.concatenate(items)


def edit_distance(pattern: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Least edit distance in words between ``pattern`` and any beginning of ``window``, and the length of that beginning."""
    return min(((score, length) for length, score in enumerate(prefix_distances(pattern.tolist(), window.tolist()), 1)), default=(len(pattern), 0))


class Index:
    """Tables of all repeats over a block of items."""

    def __init__(self, ids: list[int], items: pa.Array, repeats: int = REPEATS, samples: int = SAMPLES, share: float = SHARE, least_words: int = LEAST_WORDS):
        words, bounds = sequences(items)
        sizes = np.diff(bounds) - 1
        kept = np.flatnonzero(sizes >= least_words)
        self.ids, self.share = [ids[i] for i in kept], share
        self.items = [words[bounds[i] : bounds[i + 1] - 1] for i in kept]
        self.members = [np.unique(x) for x in self.items]
        self.repeats = [_Repeat(1000 + r, words, bounds[:-1][kept], sizes[kept], samples) for r in range(repeats)] if len(kept) else []

    def matches(self, array: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """``(row, item_id, start_word, distance, item words)``: the nearest window of each text and item within the bound."""
        words, bounds = sequences(array)
        low = (words & np.uint64(_TABLE - 1)).astype(np.uint16)
        every = np.flatnonzero(words)
        found = [r.candidates(words, low, every) for r in self.repeats]
        if not found:
            return
        pairs = np.unique(np.concatenate([np.stack(x) for x in found], 1), axis=1)
        row = np.searchsorted(bounds, pairs[0], "right") - 1
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for item in np.unique(pairs[1]).tolist():
            own = pairs[1] == item
            starts, rows = pairs[0][own], row[own]
            pattern = self.items[item]
            n = len(pattern)
            most = int(self.share * n)
            window = np.minimum(starts[:, None] + np.arange(n), len(words) - 1)
            member = np.isin(words[window], self.members[item]) & (window < bounds[rows + 1][:, None] - 1)
            for start, r in zip(starts[(near := member.sum(1) >= n - 2 * most)].tolist(), rows[near].tolist(), strict=True):
                distance, _ = edit_distance(pattern, words[start : min(start + n + most, bounds[r + 1] - 1)])
                if distance <= most:
                    best[r, item] = min(best.get((r, item), (n, 0)), (distance, start - int(bounds[r])))
        for (r, item), (distance, start) in sorted(best.items()):
            yield r, self.ids[item], start, distance, len(self.items[item])


def _indexes(benchmark: DataFrame, item_id: str, item_text: str, block_items: int, options: dict[str, float]) -> Iterator[Index]:
    """The items in blocks of about ``block_items``; one block at a time is on the driver."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where(F.col("text").isNotNull())
    blocks = max(1, -(-items.count() // block_items))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).sort("item", "text").collect()
        yield Index([r["item"] for r in rows], pa.array([r["text"] for r in rows], pa.string()), **options)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS, **options: float) -> DataFrame:
    """``id, item_id, start_word, edit_distance, item_words``: one row per text and item that it holds."""
    own = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))

    def one_block(index: Index) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in by_bytes(batch):
                    columns = list(zip(*index.matches(part.column("text")), strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int32())], names=["id", "item_id", "start_word", "edit_distance", "item_words"])

        return own.mapInArrow(find, MATCHES)

    return reduce(DataFrame.unionByName, map(one_block, _indexes(benchmark, item_id, item_text, block_items, options)))


def clean(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_id: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS, **options: float) -> DataFrame:
    """The rows of ``docs`` whose text holds no item."""

    def without(rows: DataFrame, index: Index) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in by_bytes(batch, text_column):
                    good = np.ones(part.num_rows, bool)
                    good[[m[0] for m in index.matches(part.column(text_column))]] = False
                    yield part.filter(pa.array(good))

        return rows.mapInArrow(keep, rows.schema)

    return reduce(without, _indexes(benchmark, item_id, item_text, block_items, options), docs)
