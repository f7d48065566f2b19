"""Language-model scores: counts and base by brute force, probabilities that sum to one, better than the base on unseen texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from rasterledger.llm import suffix_tree
from rasterledger.llm.common import crc_mod


def _words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def test_against_brute_force(docs_of, rng, monkeypatch):
    monkeypatch.setattr(suffix_tree, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(suffix_tree, "MOST_WORDS", 50)
    parts = ["th", "ing", "er", "ou", "Ä", "ß", "st"]
    texts = [" ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    texts += [None, "", " \t\n", "\x0bA\x0cB C\x1cD", "x" * 3000, "The\x00 the", "word " * 4000, texts[0], texts[0]]
    ids = [*range(len(texts) - 1), None]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i in ids]
    counts, total = Counter(), 0
    for t, h in zip(texts, held, strict=True):
        if not h:
            counts.update([*_words(t), ""])
    total = sum(counts.values())
    got = {r["id"]: r for r in suffix_tree.score(docs_of(texts, ids), crc_mod("doc_id", 10) == 0).collect()}
    assert len(got) == len(texts)
    for i, t, h in zip(ids, texts, held, strict=True):
        own = [*_words(t), ""]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in own)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, len(own), sum(counts[w] > 0 for w in own), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


def test_unseen_texts_are_likelier_than_under_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = suffix_tree.score(docs, crc_mod("doc_id", 10) == 0).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_next_symbols_sum_to_one(spark):
    words = spark.createDataFrame([(b"the", 900), (b"then", 400), (b"other", 300), (b"ox", 5)], "word binary, n long")
    inner = suffix_tree.Tree(suffix_tree.states(suffix_tree.inner_counts(words), 5, 8).collect(), 5, 8)
    docs = spark.createDataFrame([("the other then ox the",)] * 60, "text string")
    outer = suffix_tree.Tree(suffix_tree.states(suffix_tree.outer_counts(docs), 3, 16).collect(), 3, 16)
    assert sum(len(level[0]) for level in inner.levels) > 3 and sum(len(level[0]) for level in outer.levels) > 2
    model = suffix_tree.Model(inner, outer, int(outer.root.sum()), 7)
    for context in (0x20, 0x2074, 0x207468, 0x20746865, 0x746865, 0x78, 0x206F):
        keys = (np.full(256, context, np.int64) << 8) | np.arange(256)
        assert math.isclose(inner.probability(keys, model.bytes).sum(), 1, rel_tol=1e-6)
    assert math.isclose(model.first.sum(), 1, rel_tol=1e-2)
    for context in (0, 0x65, 0x686574, 0x6865):
        assert math.isclose((10 ** model.edges((np.full(1 << 16, context, np.int64) << 16) | np.arange(1 << 16))).sum(), 1, rel_tol=1e-2)
    got = model.words(pa.array([b"the", b"eht"]), np.array([900, 0]))
    assert got[0] > got[1]


def test_pruned_trees_sum_to_one_and_keep_all_edges(spark):
    """A context keeps its rarest edges however large the corpus is; fewer states mean shorter contexts, not lost mass."""
    words = spark.createDataFrame([(b"the", 9_000_000), (b"thx", 1), (b"then", 400), (b"other", 300), (b"axe", 6)], "word binary, n long")
    counts = suffix_tree.inner_counts(words).cache()
    sizes = []
    for most in (10**6, 12):
        rows = suffix_tree.states(counts, 5, 8, most_edges=most).collect()
        tree = suffix_tree.Tree(rows, 5, 8)
        sizes.append(len(rows))
        root = (tree.root + 0.5) / (tree.root.sum() + 128)
        for context in (0x20, 0x207468, 0x7468, 0x6178, 0x68):
            keys = (np.full(256, context, np.int64) << 8) | np.arange(256)
            assert math.isclose(tree.probability(keys, root).sum(), 1, rel_tol=1e-9)
    assert sizes[0] > sizes[1] > 0
    edges = {(r["k"], r["context"], r["symbol"]) for r in suffix_tree.states(counts, 5, 8).collect()}
    assert (1, 0x68, ord("x")) in edges


def test_contexts_without_news_are_dropped(spark):
    keys = [(a << 16 | b << 8, 200) for a in range(97, 107) for b in range(97, 107)]
    kept = suffix_tree.states(spark.createDataFrame(keys, "key long, n long"), 1, 16).where("k > 0")
    assert kept.count() == 0


def test_edges_of_words():
    body = np.frombuffer(b"ab c\n\nxyzw", np.uint8)
    key, bounds = suffix_tree.word_edges(body, np.array([0, 5, 6, 6, 10]))
    two = lambda s: s[0] << 8 | s[1]
    end = 0x0A << 8
    assert bounds.tolist() == [0, 3, 4, 5, 7]
    assert key.tolist() == [two(b"ab"), 0x206162 << 16 | two(b"c "), 0x2063 << 16 | end, end, end, two(b"xy"), 0x797A77 << 16 | end]


def test_empty_table(docs_of):
    assert suffix_tree.score(docs_of([]), crc_mod("doc_id", 10) == 0).count() == 0


def test_a_tree_too_large_for_one_place_scores_alike(docs_of, rng, monkeypatch):
    parts = ["th", "ing", "er", "ou", "Ä", "st", "a", "\x00"]
    texts = [" ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 60))) for _ in range(200)] + [None, "", "x" * 3000]
    monkeypatch.setattr(suffix_tree, "CHUNK_BYTES", 2000)
    levels, tree = [], suffix_tree.Tree

    def noted(edges, depth, bits):
        levels.append(max(row[0] for row in edges))
        return tree(edges, depth, bits)

    monkeypatch.setattr(suffix_tree, "Tree", noted)
    docs = docs_of(texts)
    want, got = [], []
    for most, rows in ((10**6, want), (0, got)):
        monkeypatch.setattr(suffix_tree, "MOST_EDGES", most)
        rows += sorted(suffix_tree.score(docs, crc_mod("doc_id", 10) == 0).collect(), key=lambda r: r["id"])
    assert levels[0] > 2 and levels[1] > 0
    assert levels[2] <= 2 and levels[3] == 0
    assert [r[:6] for r in got] == [r[:6] for r in want]
    assert all(math.isclose(g["score"], w["score"], rel_tol=1e-12) for g, w in zip(got, want, strict=True))
