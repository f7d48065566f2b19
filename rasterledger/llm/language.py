"""Language ID by hierarchical discrimination.

Two levels of linear support vector machines over hashed letter bigrams and
trigrams of the whole text: first the language family, then one machine for each
pair of languages of that family. Families are those of ``FAMILY``; a code that it
does not list joins the family whose mean training vectors are nearest.

Training reads at most ``per_language`` labelled rows of each language, chosen by a
hash of the id; the rows are vectors of fixed width, so what meets on the driver is
bounded by that parameter and the number of languages. Everything else is one pass
over the table without a shuffle.

Null text, or text without any letter, is ``und`` with score 0. Rows with null
language train nothing but are predicted. Repeated rows stay; an empty table gives an
empty result; with no training rows every text is ``und``. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import by_bytes, raw_bytes, texts

WIDTH = 2048
UND = "und"
PER_LANGUAGE = 400

#: Fixed: families of common language codes.
FAMILY = {
    code: family
    for family, codes in {
        "germanic": "en de nl sv da no nb nn is af fy lb",
        "romance": "fr es it pt ro ca gl oc",
        "slavic": "ru uk be bg sr hr bs sl mk pl cs sk",
        "uralic": "fi et hu",
        "turkic": "tr az kk uz ky",
        "indic": "hi ur bn mr ne pa gu",
    }.items()
    for code in codes.split()
}

#: Letters stay, all other ASCII counts as one kind of gap.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def features(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (rows of float32) and whether a text has a letter."""
    lowered = pc.utf8_lower(texts(array))
    body, offsets = raw_bytes(lowered)
    n, sizes = len(offsets) - 1, np.diff(offsets)
    folded = _FOLD[body].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * WIDTH, sizes)
    total = np.zeros(n * WIDTH, np.float32)
    value = folded.copy()
    for k in (1, 2):
        if len(folded) <= k:
            break
        value = (value[:-1] * np.uint32(0x01000193)) ^ (folded[k:] * np.uint32(0x9E3779B1))
        code = ((value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - WIDTH.bit_length() + 1)
        same = row[:-k] == row[k:]
        same &= (folded[:-k] != 32) | (folded[k:] != 32)
        total += np.bincount((row[:-k] + code)[same], minlength=n * WIDTH)
    out = np.sqrt(total).reshape(n, WIDTH)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    ascii_letters = np.concatenate([[0], np.cumsum((folded > 32) & (folded < 128))])
    letters = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    for i in np.flatnonzero(~letters & (sizes > 0)):
        letters[i] = any(map(str.isalpha, array[int(i)].as_py()))
    return out / np.maximum(norm, 1e-9), letters


def linear_svm(x: np.ndarray, y: np.ndarray, rounds: int = 120, weight: float = 2e-4) -> np.ndarray:
    """Weights and bias (last) of a squared-hinge machine; ``y`` is -1 or 1. Classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    at, step = w.copy(), np.float32(0.24)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ at))
        ahead = at + step * (2 * (x.T @ (share * y * slack)) - weight * at)
        at, w = ahead + np.float32(k / (k + 3)) * (ahead - w), ahead
    return w


def families(means: dict[str, np.ndarray]) -> list[list[str]]:
    """Languages by family; one without a known family joins the one whose mean vectors are nearest."""
    groups: dict[str, list[str]] = {}
    for name in sorted(means):
        if known := FAMILY.get(name.lower().replace("_", "-").split("-")[0]):
            groups.setdefault(known, []).append(name)
    for name in sorted(set(means) - {x for own in groups.values() for x in own}):
        near = max(groups, key=lambda g: np.mean([means[name] @ means[x] for x in groups[g]]), default=name)
        groups.setdefault(near, []).append(name)
    return list(groups.values())


class Model:
    def __init__(self, x: np.ndarray, names: list[str]):
        label = np.array(names)
        self.families = families({name: x[label == name].mean(0) for name in set(names)})
        family = {name: k for k, own in enumerate(self.families) for name in own}
        of = np.array([family[name] for name in names], np.int64)
        one = len(self.families) == 1
        self.first = np.stack([np.zeros(WIDTH + 1, np.float32) if one else linear_svm(x, np.where(of == k, 1, -1).astype(np.float32)) for k in range(len(self.families))]) if names else np.zeros((0, WIDTH + 1), np.float32)
        self.pairs = {}
        for own in self.families:
            for a, b in combinations(own, 2):
                among = (label == a) | (label == b)
                self.pairs[a, b] = linear_svm(x[among], np.where(label[among] == a, 1, -1).astype(np.float32))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(x)
        if not len(self.first):
            return [UND] * n, np.zeros(n)
        margin = x @ self.first[:, :-1].T + self.first[:, -1]
        chance = np.exp(4 * (margin - margin.max(1, keepdims=True)))
        chance /= chance.sum(1, keepdims=True)
        best = chance.argmax(1)
        names, score = np.empty(n, object), np.zeros(n)
        for k, own in enumerate(self.families):
            among = np.flatnonzero(best == k)
            votes = np.zeros((len(among), len(own)))
            for (i, a), (j, b) in combinations(enumerate(own), 2):
                w = self.pairs[a, b]
                p = 1 / (1 + np.exp(-4 * (x[among] @ w[:-1] + w[-1]).astype(np.float64)))
                votes[:, i] += p
                votes[:, j] += 1 - p
            votes /= max(1, len(own) - 1)
            if len(own) == 1:
                votes[:] = 1
            chosen = votes.argmax(1)
            names[among] = np.array(own, object)[chosen]
            score[among] = chance[among, k] * votes[np.arange(len(among)), chosen]
        return names.tolist(), np.clip(score, 0, 1)


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from ``key, text, lang`` rows: at most ``per_language`` rows of each language, by the hash of ``key``."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    for name, n in counts.items():
        chosen = chosen | ((F.col("lang") == name) & (F.col("rank") < F.lit(min(1.0, 1.3 * per_language / n))))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                x, letters = features(part.column("text"))
                keep = pa.array(letters)
                yield pa.RecordBatch.from_arrays([part.column("rank").filter(keep), part.column("lang").filter(keep), pa.array([r.tobytes() for r in x[letters].astype(np.float16)], pa.binary())], names=["rank", "lang", "x"])

    ranked = labelled.select("text", "lang", ((F.xxhash64("key", F.lit(7)).bitwiseAND(F.lit((1 << 40) - 1))) / float(1 << 40)).alias("rank"))
    rows = ranked.where(chosen).mapInArrow(vectors, "rank double, lang string, x binary").toPandas().sort_values(["lang", "rank", "x"])
    rows = rows.groupby("lang").head(per_language)
    x = np.stack([np.frombuffer(v, np.float16) for v in rows["x"]]).astype(np.float32) if len(rows) else np.zeros((0, WIDTH), np.float32)
    return Model(x, rows["lang"].tolist())


def identify(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of these names are replaced)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, text_column):
                x, letters = features(part.column(text_column))
                names, score = model.predict(x)
                more = [pa.array([a if b else UND for a, b in zip(names, letters, strict=True)], pa.string()), pa.array(np.where(letters, score, 0.0))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "lang_pred", "score"])

    own = docs.drop("lang_pred", "score")
    schema = StructType([*own.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return own.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, lang_pred, score`` of every row."""
    return identify(docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")), model).select("id", "lang_pred", "score")
