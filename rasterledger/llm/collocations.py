"""Phrase collocations by SON partitioning: local mining, union, exact global count.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into
words; phrases are 1 to 4 words in a row inside a piece, counted for each language.

1. Each document belongs to one of ``SHARDS`` shards (a hash of its id). A shard is mined
   completely: all its phrases are counted, combined inside tasks and then by shard and phrase
   hash, so a shard is spread over all tasks whatever its size. Its local support is
   the global one times its share of the language's bytes, rounded up: a phrase below
   it in every shard is below the support in total. Words and pairs come first; phrases
   of 3 and 4 words are counted where all their pairs are locally frequent somewhere.
   Hashes (44 bits) move as arrays of their low 32 bits by shard and high bits.
2. The union of what is locally frequent is a bit map of fixed size (2 ** ``BITS`` bits, two for each
   phrase). Like equal hashes, it can only let more through as it fills.
3. All occurrences that the map lets through are counted exactly, as phrases, not as hashes.

``mine`` scores the candidates from these counts alone: parts of a frequent phrase
are frequent.

Null text is empty; a null language is ``und``; null and repeated ids and repeated rows count as rows; an
empty table gives an empty result; a long text is cut at the end of pieces. Ties in the ranking go to the
larger count, then to the smaller phrase in byte order. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, by_bytes, raw_bytes, saved, small_side, texts
from .hashing import LOWER, mix, span_hashes, word_spans

LONGEST = 4
SHARDS = 4
BITS, HIGH, LOW = 27, 12, 32
#: Phrases, and bytes of text, that a task combines at once.
MOST_HELD, MOST_BYTES = 1_000_000, 8 << 20
#: Pairs of shard and local support that a task combines at once.
MOST_CODES = 1 << 18
#: First places of a language are chosen within so many salts, then among their winners.
SALTS = 32
#: Fixed: words end at blanks and tabs, pieces at these.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09]] = True
STOP = np.zeros(256, bool)
STOP[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PLACES = mix(np.arange(1, LONGEST + 1, dtype=np.uint64), 77) | np.uint64(1)


class Words:
    """The words of some lower-cased texts: hashes, whether the next word stands in the same piece, the row of each."""

    def __init__(self, array: pa.Array):
        body, offsets = raw_bytes(array)
        body = LOWER[body]
        self.starts, self.ends, bounds = word_spans(body, offsets, BLANK | STOP)
        self.row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        piece = np.cumsum(STOP[body])[self.starts] if len(body) else np.zeros(0, np.int64)
        self.joined = (piece[1:] == piece[:-1]) & (self.row[1:] == self.row[:-1])
        self.hashes = span_hashes(body, self.starts, self.ends)
        self.body = body

    def phrases(self, k: int) -> np.ndarray:
        """First words of all phrases of ``k`` words."""
        n = len(self.starts) - k + 1
        ok = np.ones(max(n, 0), bool)
        for j in range(k - 1):
            ok &= self.joined[j : j + len(ok)]
        return np.flatnonzero(ok)

    def keys(self, first: np.ndarray, k: int, language: np.ndarray) -> np.ndarray:
        """Hashes of the phrases of ``k`` words in the language (a number per row)."""
        out = language[self.row[first]]
        for j in range(k):
            out = out + self.hashes[first + j] * _PLACES[j]
        return mix(out, k)

    def joined_text(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one blank behind each, and where each starts and ends in it."""
        lengths = self.ends - self.starts
        ends = np.cumsum(lengths + 1) - 1
        out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
        place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[place + np.repeat(ends - lengths, lengths)] = self.body[place + np.repeat(self.starts, lengths)]
        return out.tobytes(), ends - lengths, ends


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about ``BATCH_BYTES`` of text; a longer text is cut behind ends of pieces."""
    for batch in batches:
        for part in by_bytes(batch):
            text = part.column("text")[0].as_py() if part.num_rows == 1 else None
            if text is None or len(text) <= BATCH_BYTES:
                yield part
                continue
            body, begin = text.encode(), 0
            stops = np.flatnonzero(STOP[np.frombuffer(body, np.uint8)]) + 1
            while begin < len(body):
                i = int(np.searchsorted(stops, begin + BATCH_BYTES))
                end = len(body) if i == len(stops) else int(stops[i - 1]) if i and stops[i - 1] > begin else int(stops[i])
                slice_ = pa.array([body[begin:end].decode()], pa.string())
                yield part.set_column(part.schema.get_field_index("text"), "text", slice_)
                begin = end


_numbers: dict[str, int] = {}


def _languages(array: pa.Array) -> np.ndarray:
    for x in set(array.to_pylist()) - _numbers.keys():
        _numbers[x] = int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
    return np.fromiter(map(_numbers.__getitem__, array.to_pylist()), np.uint64, len(array))


def _let_through(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    keys = keys >> np.uint64(64 - HIGH - LOW)
    one, two = keys >> np.uint64(HIGH + LOW - BITS), keys & np.uint64((1 << BITS) - 1)
    found = (bits[one >> np.uint64(6)] >> (one & np.uint64(63))) & (bits[two >> np.uint64(6)] >> (two & np.uint64(63)))
    return (found & np.uint64(1)).astype(bool)


def _read(docs: DataFrame, id_column: str, text_column: str, lang_column: str, shards: int) -> DataFrame:
    return docs.select(
        F.pmod(F.xxhash64(F.col(id_column).cast("string")), F.lit(shards)).cast("int").alias("shard"),
        F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )


def _combined(keys: list[np.ndarray], codes: list[np.ndarray], names: list[tuple[int, int]]) -> pa.RecordBatch:
    """Counts of phrases as rows ``shard, least, high, lows, ns``; a code stands for a shard and its local support."""
    bits = 64 - HIGH - LOW
    keys, codes = np.concatenate(keys) >> np.uint64(bits), np.concatenate(codes).astype(np.uint64)
    # a worker meets few pairs of shard and support; they go above the hash, so one plain sort does
    rows = (codes << np.uint64(HIGH + LOW)) | keys
    rows.sort()
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    ns = np.diff(np.append(first, len(rows))).astype(np.int32)
    rows = rows[first]
    groups = rows >> np.uint64(LOW)
    start = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    bounds = pa.array(np.append(start, len(rows)).astype(np.int32))
    group = groups[start]
    shard, least = (np.array(x, np.int64)[group >> np.uint64(HIGH)] for x in zip(*names, strict=True))
    lows = (rows & np.uint64((1 << LOW) - 1)).astype(np.uint32).view(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(shard.astype(np.int32)), pa.array(least), pa.array((group & np.uint64((1 << HIGH) - 1)).astype(np.int32)), pa.ListArray.from_arrays(bounds, pa.array(lows)), pa.ListArray.from_arrays(bounds, pa.array(ns))],
        names=["shard", "least", "high", "lows", "ns"],
    )


def _local_counts(rows: DataFrame, lengths: tuple[int, ...], pairs: np.ndarray | None) -> DataFrame:
    """``least, high, low, n`` of all phrases of these lengths, in each shard, whose pairs the map ``pairs`` lets through."""
    held = rows.sparkSession.sparkContext.broadcast(pairs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, codes, names, size = [], [], {}, 0
        for part in _parts(batches):
            words, language = Words(texts(part.column("text"))), _languages(part.column("lang"))
            code = np.array([names.setdefault(x, len(names)) for x in zip(part.column("shard").to_pylist(), part.column("least").to_pylist(), strict=True)], np.int32)
            if held.value is not None:
                two = words.phrases(2)
                known = np.zeros(len(words.starts), bool)
                known[two] = _let_through(held.value, words.keys(two, 2, language))
            for k in lengths:
                first = words.phrases(k)
                if held.value is not None:
                    for j in range(k - 1):
                        first = first[known[first + j]]
                keys.append(words.keys(first, k, language))
                codes.append(code[words.row[first]])
                size += len(first)
            if size > MOST_HELD or len(names) > MOST_CODES:
                if size:
                    yield _combined(keys, codes, list(names))
                keys, codes, names, size = [], [], {}, 0
        if size:
            yield _combined(keys, codes, list(names))

    moved = rows.mapInArrow(count, "shard int, least long, high int, lows array<int>, ns array<int>").repartition("shard", "high")
    each = moved.select("shard", "least", "high", F.explode(F.arrays_zip("lows", "ns")).alias("x")).select("shard", "least", "high", F.col("x.lows").alias("low"), F.col("x.ns").alias("n"))
    return each.groupBy("shard", "high", "low").agg(F.sum("n").alias("n"), F.min("least").alias("least"))


def _union(local: DataFrame) -> np.ndarray:
    """The bit map of all phrases that reach the local support in their shard; its size is fixed."""
    key = F.shiftleft(F.col("high").cast("long"), LOW).bitwiseOR(F.col("low").cast("long").bitwiseAND(F.lit((1 << LOW) - 1)))
    frequent = local.where("n >= least").select(key.alias("key"))
    bits = frequent.select(F.explode(F.array(F.shiftright("key", HIGH + LOW - BITS), F.col("key").bitwiseAND(F.lit((1 << BITS) - 1)))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _global_counts(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """``lang, phrase, n`` of every phrase that the map lets through, and the number of words of a language as phrase ''."""
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def flush(bodies: list, keys: list, starts: list, ends: list, at: list, names: list, total: list) -> pa.RecordBatch:
        body, keys = b"".join(bodies), np.concatenate(keys)
        _, first, n = np.unique(keys, return_index=True, return_counts=True)
        phrases = [body[a:b] for a, b in zip(np.concatenate(starts)[first].tolist(), np.concatenate(ends)[first].tolist(), strict=True)]
        lang = pa.array(names, pa.string())
        code = np.concatenate([np.concatenate(at)[first], np.arange(len(names))])
        return pa.RecordBatch.from_arrays([lang.take(pa.array(code, pa.int32())), pa.array(phrases + [b""] * len(names), pa.binary()).cast(pa.string()), pa.array(np.concatenate([n, total]).astype(np.int64))], names=["lang", "phrase", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = lambda: ([], [], [], [], [], {}, {}, 0)
        bodies, keys, starts, ends, at, names, total, size = state()
        for part in _parts(batches):
            words, language = Words(texts(part.column("text"))), _languages(part.column("lang"))
            code = np.array([names.setdefault(x, len(names)) for x in part.column("lang").to_pylist()], np.int32)
            for i, n in enumerate(np.bincount(code[words.row], minlength=len(names)).tolist()):
                total[i] = total.get(i, 0) + n
            body, a, b = words.joined_text()
            for k in range(1, LONGEST + 1):
                first = words.phrases(k)
                key = words.keys(first, k, language)
                ok = _let_through(held.value, key)
                first, key = first[ok], key[ok]
                keys.append(key)
                starts.append(a[first] + size)
                ends.append(b[first + k - 1] + size)
                at.append(code[words.row[first]])
            bodies.append(body)
            size += len(body)
            if size > MOST_BYTES or sum(map(len, keys)) > MOST_HELD:
                yield flush(bodies, keys, starts, ends, at, list(names), [total[i] for i in range(len(names))])
                bodies, keys, starts, ends, at, names, total, size = state()
        if bodies:
            yield flush(bodies, keys, starts, ends, at, list(names), [total[i] for i in range(len(names))])

    return rows.select("lang", "text").mapInArrow(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, support: int = 30, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``lang, phrase, n``: every phrase of 1 to 4 words with ``n >= support``; phrase '' holds the number of words of the language."""
    rows = _read(docs, id_column, text_column, lang_column, shards)
    share = rows.groupBy("shard", "lang").agg(F.sum(F.octet_length("text").cast("long")).alias("own"))
    whole = share.groupBy("lang").agg(F.sum("own").alias("whole"))
    least = saved(share.join(whole, "lang").where("own > 0").select("shard", "lang", F.expr(f"({support} * own + whole - 1) div whole").alias("least")))
    supported = rows.join(small_side(least), ["shard", "lang"])
    bits = _union(_local_counts(supported, (1, 2), None))
    bits |= _union(_local_counts(supported, tuple(range(3, LONGEST + 1)), bits))
    return _global_counts(rows, bits).where((F.col("n") >= support) | (F.col("phrase") == ""))


def mine(docs: DataFrame, support: int = 30, cover: int = 80, first: int = 2000, **columns) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first phrases of 2 to 4 words of each language.

    The score is ``2000000 * a / (l + r)``, rounded down, at the weakest cut; a phrase
    inside a longer candidate of at least ``cover`` per cent of its count is left out.
    """
    counts = saved(frequent_phrases(docs, support, **columns))
    words = F.split("phrase", " ")
    found = counts.where("phrase <> ''").select("lang", "phrase", words.alias("w"), "n").where(F.size("w") > 1)
    text = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = found.select("lang", "phrase", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", text(1, F.col("k")).alias("left"), text(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    of = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (l + r)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    longer = found.where(F.size("w") > 2).select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover))
    total = counts.where("phrase = ''").select("lang", "n")
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    near = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
