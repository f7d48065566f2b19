"""Prefix trie of conversations by a splitter skeleton.

A conversation is a path: 16 bytes of SHA-256 for each turn's role and text. Equal
paths are folded first, so a conversation with many copies is one row. A sample of
paths, taken by hash and by length and cut to ``SPLITTER_TURNS`` turns, gives range splitters, about one for
``SHARD_BYTES`` of paths; they alone are broadcast (at most ``16 * SPLITTER_TURNS`` bytes each).

The skeleton is the trie of the splitters: a node that is no prefix of a splitter lies in one
shard as a whole. Each sorted shard finishes these nodes by itself; for the few skeleton
nodes that it touches (prefixes of its own two splitters) it gives partial sums, which
are added up over shards and then along the skeleton.

The ids of conversations that end at a node are joined in ranges of 1024 ids; the one
ordered text behind a SHA-256 is then read as a stream of these pieces, in order, and never
held as a whole. A conversation's path (16 bytes a turn) is one row, and so must fit one.

Null role or text is empty. Turns are ordered by ``turn``, null first; turns of one number by the digest of
role and text, so repeated rows are turns of their own. Rows without a conv_id belong to no conversation and are
left out. An empty table has no node, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small_side

DIGEST = 16
SHARD_BYTES = 8 << 20
LEAST_SHARD_BYTES = 64 << 10
FEW_SHARDS = 16
SPLITTER_TURNS = 32
SAMPLES = 4
ID_BITS = 10
NOTHING = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, turn binary, skeleton boolean, key binary"


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation in order, as ``key`` (hex digest) and ``words``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * DIGEST)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("int")
    rows = rows.select("conv_id", F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", digest.alias("key"), words.alias("words")).alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(own: DataFrame, group: int = 20, head: Column | None = None, most_head: int = 3) -> DataFrame:
    """Conversations that take their first ``head`` turns from the first conversation of their ``group``; ``head`` is at most ``most_head``."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most_head + 1) if head is None else head
    leads = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("lead"), F.slice("turns", 1, most_head).alias("start"))
    with_lead = own.withColumn("h", head.cast("int")).withColumn("lead", F.col("conv_id") - F.col("conv_id") % group).join(leads, "lead", "left")
    start = F.coalesce(F.expr("slice(start, 1, h)"), F.expr("slice(turns, 1, 0)"))
    return with_lead.select("conv_id", F.concat(start, F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")).alias("turns"))


def _folded(conversations: DataFrame) -> DataFrame:
    """``path, words, n, conv_id, ends``: different paths with how many conversations they are, the smallest of these and the digest of all."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    rows = saved(conversations.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")).withColumn("pid", F.sha2("path", 256)))
    ids = rows.groupBy("pid", F.shiftright("conv_id", ID_BITS).alias("range")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            pids, ends = [], []
            for pid, text in zip(batch.column("pid").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if pid == current:
                    state.update(b"," + text.encode())
                    continue
                if current is not None:
                    pids.append(current)
                    ends.append(state.digest())
                current, state = pid, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(pids, pa.string()), pa.array(ends, pa.binary())], names=["pid", "ends"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([state.digest()], pa.binary())], names=["pid", "ends"])

    ends = ids.repartition("pid").sortWithinPartitions("pid", "range").mapInArrow(digest, "pid string, ends binary")
    folded = rows.groupBy("pid", "path", "words").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    return folded.join(ends, "pid").drop("pid")


def splitters(paths: DataFrame) -> list[bytes]:
    """Sorted range splitters, about one for ``SHARD_BYTES`` of ``path``; taken by hash, so the same rows give the same ones."""
    total = paths.agg(F.sum(F.octet_length("path") + DIGEST)).first()[0] or 0
    shards = max(-(-total // SHARD_BYTES), min(FEW_SHARDS, -(-total // LEAST_SHARD_BYTES)), 1)
    if shards == 1:
        return []
    share = F.pmod(F.xxhash64("path"), F.lit(max(1, total // (SAMPLES * shards)))) < F.octet_length("path") + DIGEST
    sample = sorted({bytes(r[0]) for r in paths.where(share).select(F.expr(f"substring(path, 1, {DIGEST * SPLITTER_TURNS})").alias("path")).distinct().toLocalIterator()})
    return [s for s in sample[SAMPLES // 2 :: SAMPLES] if s]


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // DIGEST
    x, y = np.frombuffer(a, np.uint8, most), np.frombuffer(b, np.uint8, most)
    return int(np.argmax(x != y)) // DIGEST


def finish_shard(paths: list[bytes], words: list[list[int]], n: list[int], ids: list[int], ends: list[bytes], low: bytes | None, high: bytes | None) -> dict[str, list]:
    """All nodes of a shard of different sorted paths between two splitters; those of the skeleton hold partial sums.

    Sums of a node take in everything below it inside the shard. What a skeleton node adds by itself
    (children of the skeleton, being a leaf, its own saved words) is left to the reduction.
    """
    depth, convs, least, kids, leaves, saves, parent, own_words, end, bone, key, last = ([] for _ in range(12))
    stack: list[int] = []

    def close(i: int) -> None:
        if not bone[i]:
            leaves[i] += not kids[i]
            saves[i] += (convs[i] - 1) * own_words[i]
        if (up := parent[i]) >= 0:
            convs[up] += convs[i]
            least[up] = min(least[up], least[i])
            leaves[up] += leaves[i]
            saves[up] += saves[i]
            kids[up] += not bone[i]

    before = b""
    for path, own, count, smallest, digest in zip(paths, words, n, ids, ends, strict=True):
        keep = _shared(before, path) + 1 if stack else 0
        while len(stack) > keep:
            close(stack.pop())
        edge = max(_shared(path, s) if s is not None else 0 for s in (low, high))
        for d in range(keep, len(path) // DIGEST + 1):
            depth.append(d)
            convs.append(0)
            least.append(smallest)
            kids.append(0)
            leaves.append(0)
            saves.append(0)
            parent.append(stack[-1] if stack else -1)
            own_words.append(own[d - 1] if d else 0)
            end.append(None)
            bone.append(d <= edge)
            key.append(path[: DIGEST * d] if d <= edge else None)
            last.append(path[DIGEST * (d - 1) : DIGEST * d] if d else None)
            stack.append(len(depth) - 1)
        top = stack[-1]
        convs[top] += count
        least[top] = min(least[top], smallest)
        end[top] = digest
        before = path
    while stack:
        close(stack.pop())
    above = [-1 if p < 0 or bone[p] else p for p in parent]
    return {
        "conv_id": least, "depth": depth, "parent_conv_id": [None if p < 0 else least[p] for p in above], "n_convs": convs, "n_children": kids, "n_leaves": leaves, "saved_tokens": saves,
        "ends": end, "turn": last, "skeleton": bone, "key": [k if b else key[p] if p >= 0 and bone[p] else None for k, b, p in zip(key, bone, parent, strict=True)], "words": own_words,
    }


def _reduced(partial: DataFrame) -> DataFrame:
    """Whole skeleton nodes from the partial sums of shards."""
    total = saved(partial.groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("words").alias("words"), F.max("ends").alias("ends"), F.max("turn").alias("turn")))
    up = F.expr(f"substring(key, 1, {DIGEST} * (int(depth) - 1))")
    bones = total.where("depth > 0").groupBy(up.alias("key")).agg(F.count("*").alias("bones"))
    total = total.join(bones, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("bones", F.lit(0))).drop("bones")
    above = F.explode(F.transform(F.sequence(F.lit(0), F.col("depth").cast("int")), lambda d: F.expr("key").substr(F.lit(1), d * DIGEST))).alias("key")
    own = total.select(above, (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    added = own.groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    total = total.join(added, "key").withColumn("n_leaves", F.col("n_leaves") + F.col("leaf")).withColumn("saved_tokens", F.col("saved_tokens") + F.col("own"))
    parents = total.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    return total.withColumn("up", F.when(F.col("depth") > 0, up)).join(parents, "up", "left")


def trie(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn`` per node of ``conv_id, turns`` rows.

    ``turn`` is the hex digest of the node's last turn (null at the root), as in ``sequences``.
    """
    spark = conversations.sparkSession
    paths = saved(_folded(conversations))
    held = spark.sparkContext.broadcast(splitters(paths))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = [bisect_right(held.value, p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], names=[*batch.schema.names, "shard"])

    def finish(group: pa.Table) -> pa.Table:
        group = group.sort_by("path")
        i = group["shard"][0].as_py()
        low, high = held.value[i - 1] if i else None, held.value[i] if i < len(held.value) else None
        return pa.table(finish_shard(*(group[c].to_pylist() for c in ("path", "words", "n", "conv_id", "ends")), low, high), schema=nodes_schema)

    columns = [c.split() for c in f"{NODES}, words long".split(", ")]
    nodes_schema = pa.schema([(name, {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[kind]) for name, kind in columns])
    schema = "path binary, words array<int>, n long, conv_id long, ends binary, shard int"
    nodes = saved(paths.select("path", "words", "n", "conv_id", "ends").mapInArrow(place, schema).groupBy("shard").applyInArrow(finish, f"{NODES}, words long"))
    skeleton = saved(_reduced(nodes.where("skeleton")))
    local = nodes.where("not skeleton")
    hung = local.where("key is not null").drop("parent_conv_id").join(small_side(skeleton.select("key", F.col("conv_id").alias("parent_conv_id"))), "key")
    ends = F.coalesce(F.lower(F.hex("ends")), F.lit(NOTHING)).alias("ends_sha256")
    shape = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends, F.lower(F.hex("turn")).alias("turn")]
    return skeleton.select(*shape).unionByName(local.where("key is null").select(*shape)).unionByName(hung.select(*shape))
