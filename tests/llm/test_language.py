"""Language ID: held-out accuracy, and every edge case."""

import numpy as np
import pyarrow as pa

from rasterledger.llm import language

WORDS = {"en": "the that with shining thing house", "de": "der die nicht schön straße über", "fr": "le été être français où les", "es": "el niño qué años los dónde", "xx": "kwa zuri habari ndiyo"}


def _rows(rng, n):
    langs = [rng.choice(list(WORDS)) for _ in range(n)]
    return [" ".join(rng.choices(WORDS[x].split(), k=rng.randint(3, 40))) for x in langs], langs


def test_held_out_accuracy_and_edges(docs_of, rng):
    texts, langs = _rows(rng, 240)
    train = docs_of(texts[:160], lang=langs[:160]).withColumnRenamed("doc_id", "key")
    model = language.train(train, per_language=30)
    assert {tuple(sorted(x)) for x in model.families} >= {("en",), } or any("en" in x and "de" in x for x in model.families)
    odd = [None, "", " ", "1234 !!", "£", "é", "a", "the " * 40000]
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs_of(texts[160:] + odd), model).collect()}
    assert np.mean([got[i][0] == x for i, x in enumerate(langs[160:])]) > 0.95
    assert [got[80 + k][0] for k in range(5)] == ["und"] * 5 and all(got[80 + k][1] == 0 for k in range(5))
    assert got[85][0] in WORDS and got[87][0] == "en" and all(0 <= s <= 1 for _, s in got.values())


def test_nothing_to_learn_from(docs_of):
    empty = docs_of([]).withColumnRenamed("doc_id", "key")
    model = language.train(empty)
    assert language.predict(docs_of(["abc", None]), model).select("lang_pred").distinct().collect() == [("und",)]
    assert language.predict(docs_of([]), model).count() == 0


def test_features_ignore_neighbours():
    both, _ = language.features(pa.array(["abc def", "", "ghi"]))
    alone, _ = language.features(pa.array(["ghi"]))
    assert np.allclose(both[2], alone[0]) and not both[1].any()
