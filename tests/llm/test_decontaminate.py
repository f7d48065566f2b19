"""Decontamination against the exact edit distance of every window."""

import numpy as np
import pyarrow as pa

from rasterledger.llm import decontaminate as d


def _plain(pattern, text):
    """Least edits between the pattern and any window (rows of the usual table, free start)."""
    row = np.zeros(len(text) + 1, int)
    for i, w in enumerate(pattern, 1):
        diagonal, row[0] = row[0], i
        for j, v in enumerate(text, 1):
            diagonal, row[j] = row[j], min(diagonal + (w != v), row[j] + 1, row[j - 1] + 1)
    return int(row.min())


def _edited(words, edits, vocabulary, rng):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        rng.choice([lambda: words.__setitem__(at, rng.choice(vocabulary)), lambda: words.pop(at), lambda: words.insert(at, rng.choice(vocabulary))])()
    return words


def _case(rng, n=260):
    vocabulary = ["the", "of", "and", *(f"w{rng.randrange(400)}" for _ in range(300))]
    items = [rng.choices(vocabulary, k=rng.randint(12, 60)) for _ in range(25)]
    texts = []
    for _ in range(n):
        own = rng.choice(items)
        inside = _edited(own, rng.randint(0, int(0.2 * len(own))), vocabulary, rng) if rng.random() < 0.6 else []
        texts.append(rng.choices(vocabulary, k=rng.randint(0, 40)) + inside + rng.choices(vocabulary, k=rng.randint(0, 40)))
    return items, texts


def test_recall_and_no_false_match(rng):
    items, texts = _case(rng)
    index = d.Index(list(range(len(items))), pa.array([" ".join(x) for x in items]))
    got = {(r, i): e for r, i, _, e, _ in index.matches(pa.array([" ".join(x) for x in texts]))}
    wanted = {}
    for r, text in enumerate(texts):
        for i, item in enumerate(items):
            if len(set(item) & set(text)) >= 0.6 * len(set(item)) and (e := _plain(item, text)) <= int(0.15 * len(item)):
                wanted[r, i] = e
    assert len(wanted) > 80 and set(got) <= set(wanted)
    assert len(set(got) & set(wanted)) >= 0.9 * len(wanted)
    assert all(k in got for k, e in wanted.items() if e == 0) and all(got[k] >= wanted[k] for k in got)


def test_edit_distance_of_beginnings(rng):
    for _ in range(200):
        a, b = (np.array([rng.randrange(1, 5) for _ in range(rng.randint(1, 70))], np.uint64) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        table[:, 0], table[0] = range(len(a) + 1), range(len(b) + 1)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i, j] = min(table[i - 1, j - 1] + (a[i - 1] != b[j - 1]), table[i - 1, j] + 1, table[i, j - 1] + 1)
        assert d.edit_distance(a, b)[0] == table[len(a)].min()


def test_edges(spark, docs_of):
    item = "One two, three FOUR five six seven eight nine ten eleven twelve"
    texts = [None, "", item, f"x\n{item.upper()}!! y", item, "word " * 30000 + item, " ".join(item.split()[:8]), "ten " * 20]
    benchmark = spark.createDataFrame([(1, item, "a"), (1, item, "a"), (2, None, "a"), (3, "too short", "a"), (None, item, "b")], "item_id long, text string, doc_id string")
    got = d.contaminated(docs_of(texts), benchmark, block_items=2).collect()
    assert sorted((r["id"], r["item_id"] or 0, r["start_word"], r["edit_distance"]) for r in got) == sorted((i, k, s, 0) for i, s in ((2, 0), (3, 1), (4, 0), (5, 30000)) for k in (0, 1, 1))
    assert d.contaminated(docs_of([]), benchmark).count() == 0 and d.contaminated(docs_of(texts), benchmark.limit(0)).count() == 0
