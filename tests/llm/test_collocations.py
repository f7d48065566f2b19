"""Collocations against plain counting; local supports that lose nothing; bit maps that are full."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rasterledger.llm import collocations, queries


def _pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def _plain(rows, support, cover, first):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for words in _pieces(text):
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                f[lang or "und"].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if a >= support and " " in p}
        rows = []
        for p, a in found.items():
            w = p.split(" ")
            if any(100 * b >= cover * a and len(q) > len(p) and f" {p} " in f" {q} " for q, b in found.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (x + y), k, x, y) for k in range(1, len(w)) for x, y in [(count[" ".join(w[:k])], count[" ".join(w[k:])])])
            rows.append((score, a, p, l, r))
        rows.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(rows[:first], 1)]
    return sorted(out)


def _texts(rng):
    words = ["the", "Of", "ß", "über", "x\x0by", "a'b", "tor", "in", "é", "new", "york", "city"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))).replace("tor in", "tor, in") for _ in range(120)]
    texts += ["New York\tCity   hall"] * 70 + [None, "", ".", " \t", "a.b;c!d?e", "the " * 5000, "one\x1ctwo three four"] + ["big. " * 900] * 2
    langs = [rng.choice(["en", "de", None]) for _ in texts]
    return texts, langs


@pytest.mark.parametrize("shards", [1, 4, 37])
def test_against_plain_counts(docs_of, rng, monkeypatch, shards):
    monkeypatch.setattr(collocations, "MOST_HELD", 700)
    monkeypatch.setattr(collocations, "BATCH_BYTES", 900)
    texts, langs = _texts(rng)
    docs = docs_of(texts, [*range(len(texts) - 40), *[3] * 39, None], lang=langs)
    got = collocations.mine(docs, support=20, first=50, shards=shards).collect()
    assert sorted(tuple(r) for r in got) == _plain(list(zip(texts, langs, strict=True)), 20, 80, 50)
    assert collocations.mine(docs_of([])).count() == 0 and collocations.mine(docs_of([None, "", "a b"])).count() == 0


def test_a_full_map_changes_nothing(docs_of, rng, monkeypatch):
    texts, langs = _texts(rng)
    docs = docs_of(texts, lang=langs)
    want = sorted(tuple(r) for r in collocations.mine(docs, support=20).collect())
    monkeypatch.setattr(collocations, "_let_through", lambda bits, keys: np.ones(len(keys), bool))
    assert sorted(tuple(r) for r in collocations.mine(docs, support=20).collect()) == want


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 4 * 10**13
    counts = spark.createDataFrame([("en", "a b", big), ("en", "a", big), ("en", "b", big + 7), ("en", "", 9 * big)], "lang string, phrase string, n long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda docs, support: counts)
    (row,) = collocations.mine(None).collect()
    assert (row["score"], row["l"], row["r"], row["n"]) == (2_000_000 * big // (2 * big + 7), big, big + 7, 9 * big)


def test_the_query_is_the_operator(docs_of, rng, spark, tmp_path):
    texts, langs = _texts(rng)
    docs_of(texts, lang=langs).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_phrase_collocation_mining"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == _plain(list(zip(texts, langs, strict=True)), 30, 80, 2000)
