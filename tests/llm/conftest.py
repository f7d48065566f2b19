import random

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents with a clashing extra column from a list of texts."""

    def make(texts, ids=None, **more):
        ids = list(range(len(texts))) if ids is None else ids
        columns = {"lang": [None] * len(texts), "source": ["s"] * len(texts), "n_chars": [str(len(t or "")) for t in texts], "id": ["x"] * len(texts), **more}
        rows = list(zip(ids, texts, *columns.values(), strict=True))
        return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {c} string" for c in columns))

    return make


@pytest.fixture
def rng():
    return random.Random(7)
