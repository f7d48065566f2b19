"""The prefix trie against plain sets of prefixes, with few and many shards, hot copies and hot first turns."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from rasterledger.llm import prefix_trie, queries


def _digest(turn):
    role, text = turn
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def _plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, _digest((role or "", text or "")), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = (*own.get(c - c % 20, [])[:h], *turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, len(path) == d))
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
    least = {p: min(c for c, _ in m) for p, m in members.items()}
    ends = lambda m: hashlib.sha256(",".join(map(str, sorted(c for c, e in m if e))).encode()).hexdigest()
    return sorted((least[p], len(p), least[p[:-1]] if p else -1, len(m), len(kids[p]), leaves[p], saved[p], ends(m)) for p, m in members.items())


def _rows(rng, n):
    rows = []
    for c in range(n):
        if c % 7 == 3:  # exact copies, beyond a range of ids
            turns = [("user", "same words here"), ("bot", "an answer")]
        elif c % 3 == 0:  # one first turn for a third of all
            turns = [("user", "hello there"), *[(rng.choice(["bot", "user", None]), rng.choice(["a b", "c", "", None, "d\te\x0bf"])) for _ in range(rng.randint(0, 6))]]
        else:
            turns = [(rng.choice(["bot", "user"]), rng.choice(["x y z", "w", "v u"])) for _ in range(rng.randint(1, 5))]
        rows += [(c, t, *turn) for t, turn in enumerate(turns) if c % 40 or n < 100]
    rows += [(5, None, "user", "first of all"), (5, 1, "user", "tie"), (5, 1, "bot", "tie"), (5, 1, "bot", "tie"), (None, 0, "user", "nobody's"), (-25, 0, "user", "below zero"), (10**12 + 1, 0, None, None)]
    rows += [(n + 1, t, "user", f"turn {t % 3}") for t in range(200)] + [(n + 2, t, "user", f"turn {t % 3}") for t in range(190)]
    return rows


@pytest.mark.parametrize(("bytes_", "turns", "n"), [(1 << 20, 32, 60), (600, 32, 400), (100, 2, 400)])
def test_against_plain_sets(spark, rng, monkeypatch, tmp_path, bytes_, turns, n):
    monkeypatch.setattr(prefix_trie, "SHARD_BYTES", bytes_)
    monkeypatch.setattr(prefix_trie, "LEAST_SHARD_BYTES", bytes_)
    monkeypatch.setattr(prefix_trie, "SPLITTER_TURNS", turns)
    monkeypatch.setattr(prefix_trie, "ID_BITS", 3)
    rows = [(*r, "x", "y") for r in _rows(rng, n)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, words string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op13_conversation_prefix_trie"](spark, str(tmp_path)).collect()
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got) == _plain([r[:4] for r in rows])


def test_a_turnless_conversation_and_no_table(spark):
    shape = "conv_id long, turn long, role string, text string"
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    (root,) = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(spark.createDataFrame([(lone, 0, "user", "gone")], shape)))).collect()
    assert (root["conv_id"], root["depth"], root["parent_conv_id"], root["n_convs"], root["n_children"], root["n_leaves"], root["saved_tokens"]) == (lone, 0, None, 1, 0, 1, 0)
    assert root["ends_sha256"] == hashlib.sha256(str(lone).encode()).hexdigest()
    assert prefix_trie.trie(prefix_trie.sequences(spark.createDataFrame([], shape))).count() == 0


def test_splitters_are_a_bounded_sample(spark):
    paths = spark.range(3000).select(prefix_trie.F.expr("unhex(repeat(sha2(cast(id as string), 256), 3))").alias("path"))
    held = prefix_trie.splitters(paths)
    assert held == sorted(set(held)) and 2 <= len(held) <= 40
