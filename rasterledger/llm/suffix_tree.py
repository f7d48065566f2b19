"""Language-model scoring with probabilistic suffix trees.

A text is its words and one end token; a word is its bytes and a word end. Two trees
of variable-length contexts describe it:

* the inner tree gives each byte after up to five bytes before it, back to the start
  of its word; a word that training has seen is itself the longest context, smoothed
  towards the inner tree;
* the outer tree gives the first two symbols of a word (or the end) after up to three
  closing bytes of the word before it.

P(word | word before) = P(first two | closing bytes) * P(word | its first two). All
contexts are counted over all training texts; one is kept as a state if it occurs
``least`` times, whatever the size of the corpus, and if its next-symbol distribution departs from that of its
parent (count times Kullback-Leibler divergence over ``divergence``). So the trees grow with
the corpus. A kept state keeps all its edges. Each state's
distribution is smoothed towards that of the next shorter state. A symbol is scored
by the longest suffix of what stands before it that is a state.

Counts move as (word, count) and (context, count) rows; the number of different words
and contexts grows with the corpus. A tree of up to ``MOST_EDGES`` edges goes to all tasks; a
larger one stays a table, chunks of words or documents ask for the contexts they hold
and joins answer level by level. The scores are the same either way. Scores belong to different
words: chunks of documents ask for the words they hold, a join answers, and each chunk adds up its documents.

Null text is empty: one token, the end. A null id counts as empty text when texts are
split for training. Repeated rows stay; an empty table gives an empty result; with
nothing to learn from all probabilities are those of an untrained root. Other
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, raw_bytes, saved, texts
from .hashing import LOWER, word_spans

DEPTH, OUTER = 5, 3
CHUNK_BYTES = 8 << 20
MOST_WORDS = 150_000
#: Edges of a tree that goes to all tasks; a larger one is asked by joins.
MOST_EDGES = 4_000_000
WORD_END, TEXT_END = 0x20, 0x0A


def words_of(text: str) -> list[bytes]:
    """Lower-cased words; bytes lower and split on ASCII only."""
    return text.encode().lower().split()


def _word_rows(counts: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over rows ``text, train``: count in training texts, 0 for words of other texts only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for part in by_bytes(batch):
                body, train = texts(part.column("text")).to_pylist(), part.column("train").to_pylist()
                counts.update(chain.from_iterable(words_of(t) for t, own in zip(body, train, strict=True) if own))
                for t, own in zip(body, train, strict=True):
                    if not own:
                        for w in words_of(t):
                            counts[w] += 0
                if len(counts) > MOST_WORDS:
                    yield _word_rows(counts)
                    counts = Counter()
        yield _word_rows(counts)

    return docs.select("text", "train").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def grams(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol of every word: the number made of up to ``DEPTH`` bytes of context and the symbol; and the word's place."""
    body, offsets = raw_bytes(array)
    n = len(offsets) - 1
    sizes = np.diff(offsets) + 1
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(n), sizes)
    symbols = np.full(int(ends[-1]) if n else 0, WORD_END, np.uint64)
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    symbols[inside] = body
    place = np.arange(len(symbols)) - np.repeat(ends - sizes, sizes)
    key = symbols.copy()
    for k in range(1, DEPTH + 1):
        back = np.zeros(len(symbols), np.uint64)
        back[k:] = symbols[: max(0, len(symbols) - k)]
        back[place == k - 1] = WORD_END
        back[place < k - 1] = 0
        key |= back << np.uint64(8 * k)
    return key.astype(np.int64), row


def lower_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts in a row and the bounds between them."""
    body, offsets = raw_bytes(texts(array))
    return LOWER[body], offsets


def word_edges(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token of lower-cased texts: the number made of up to ``OUTER`` closing bytes of the word before and the token's first two symbols; n+1 bounds by text."""
    starts, ends, bounds = word_spans(body, offsets)
    n, sizes = len(bounds) - 1, np.diff(bounds)
    lengths = ends - starts
    at = lambda i, ok, other: np.where(ok, body[np.where(ok, i, 0)] if len(body) else 0, other).astype(np.int64)
    first = (at(starts, lengths > 0, 0) << 8) | at(starts + 1, lengths > 1, WORD_END)
    closing = np.zeros(len(starts), np.int64)
    for k in range(OUTER):
        closing |= at(ends - 1 - k, lengths > k, np.where(lengths == k, WORD_END, 0)) << (8 * k)
    token_bounds = bounds + np.arange(n + 1)
    out = np.full(int(token_bounds[-1]), TEXT_END << 8, np.int64)
    place = np.arange(len(starts)) + np.repeat(np.arange(n), sizes)
    out[place] = first
    out[place + 1] |= closing << 16
    return out, token_bounds


def _counted(keys: np.ndarray, n: np.ndarray | None = None) -> pa.RecordBatch:
    keys, at = np.unique(keys, return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(at, n, len(keys)).astype(np.int64))], names=["key", "n"])


def inner_counts(words: DataFrame) -> DataFrame:
    """``key, n`` of all full contexts with their next byte, over ``word, n`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "word"):
                key, row = grams(part.column("word"))
                yield _counted(key, part.column("n").to_numpy()[row].astype(float))

    return words.where("n > 0").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def outer_counts(docs: DataFrame) -> DataFrame:
    """``key, n`` of the edges between words of all rows of ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                yield _counted(word_edges(*lower_bytes(part.column("text")))[0])

    return docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def states(counts: DataFrame, depth: int, bits: int, least: int = 4, divergence: float = 12.0, most_edges: int | None = None) -> DataFrame:
    """Edges ``k, context, symbol, n, total, kinds`` of the kept states, the root (k = 0) among them, from ``key, n``.

    A key is up to ``depth`` bytes of context (the last byte lowest) above ``bits`` bits of the symbol.
    Only with ``most_edges`` is the divergence asked for doubled until that many are left.
    """
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright("key", bits).bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("context")) for k in range(depth + 1)]))
    edges = counts.select(levels.alias("at"), F.col("key").bitwiseAND(F.lit((1 << bits) - 1)).alias("symbol"), "n").groupBy("at.k", "at.context", "symbol").agg(F.sum("n").alias("n"))
    # a context that reaches back beyond its start is the same as the shorter one
    edges = edges.where((F.col("k") == 0) | (F.expr("shiftright(context, 8 * (k - 1))") != 0))
    total = edges.groupBy("k", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    held = saved(edges.join(total, ["k", "context"]))
    held = held.where((F.col("k") == 0) | (F.col("total") >= least))
    parent = held.select((F.col("k") + 1).alias("k"), F.col("context").alias("shorter"), "symbol", (F.col("n") / F.col("total")).alias("q"))
    own = held.where("k > 0").withColumn("shorter", F.expr("context & (shiftleft(1L, 8 * (k - 1)) - 1)"))
    gain = own.join(parent, ["k", "shorter", "symbol"]).groupBy("k", "context").agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("q"))).alias("gain"), F.count("*").alias("own"))
    gain = saved(gain.where(F.col("gain") > divergence))
    while most_edges is not None and (gain.where(F.col("gain") > divergence).agg(F.sum("own")).first()[0] or 0) > most_edges:
        divergence *= 2
    kept = gain.where(F.col("gain") > divergence).select("k", "context")
    return held.join(kept, ["k", "context"]).unionByName(held.where("k = 0")).select("k", "context", "symbol", "n", "total", "kinds")


class Tree:
    """The kept states of one tree as sorted arrays per level."""

    def __init__(self, edges: list[tuple[int, int, int, int, int, int]], depth: int, bits: int):
        rows = np.array(edges, np.int64).reshape(-1, 6) if isinstance(edges, np.ndarray) else np.array([tuple(r) for r in edges], np.int64).reshape(-1, 6)
        self.bits = bits
        self.root = np.zeros(1 << bits)
        own = rows[rows[:, 0] == 0]
        self.root[own[:, 2]] = own[:, 3]
        self.levels = []
        for k in range(1, depth + 1):
            own = rows[rows[:, 0] == k]
            contexts, first = np.unique(own[:, 1], return_index=True)
            edge = (own[:, 1] << bits) | own[:, 2]
            order = np.argsort(edge)
            self.levels.append((contexts, own[first, 4].astype(float), own[first, 5].astype(float), edge[order], own[order, 3].astype(float)))

    def probability(self, key: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Probability of the symbol of each number after its context; ``root`` is the distribution without context."""
        keys, at = np.unique(key, return_inverse=True)
        p = root[keys & ((1 << self.bits) - 1)]
        for k, (contexts, total, kinds, edges, n) in enumerate(self.levels, 1):
            if not len(contexts):
                continue
            context = (keys >> self.bits) & ((1 << 8 * k) - 1)
            i = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            edge = (context << self.bits) | (keys & ((1 << self.bits) - 1))
            j = np.minimum(np.searchsorted(edges, edge), len(edges) - 1)
            seen = np.where(edges[j] == edge, n[j], 0)
            p = np.where(contexts[i] == context, (seen + kinds[i] * p) / (total[i] + kinds[i]), p)
        return p[at]


def probabilities(keys: DataFrame, edges: DataFrame, root: np.ndarray, depth: int, bits: int) -> DataFrame:
    """``key, p`` of every row of ``key``: what ``Tree.probability`` gives, by joins with the edges of each level."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key")
            yield pa.RecordBatch.from_arrays([key, pa.array(root[key.to_numpy() & ((1 << bits) - 1)])], names=["key", "p"])

    rows = keys.select("key").mapInArrow(start, "key long, p double")
    symbol = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    for k in range(1, depth + 1):
        own = edges.where(F.col("k") == k)
        kept = own.groupBy("context").agg(F.first("total").alias("total"), F.first("kinds").alias("kinds"))
        context = F.shiftright("key", bits).bitwiseAND(F.lit((1 << 8 * k) - 1))
        met = rows.withColumns({"context": context, "symbol": symbol}).join(kept, "context", "left").join(own.select("context", "symbol", "n"), ["context", "symbol"], "left")
        smoothed = (F.coalesce("n", F.lit(0)) + F.col("kinds") * F.col("p")) / (F.col("total") + F.col("kinds"))
        rows = met.select("key", F.when(F.col("total").isNull(), F.col("p")).otherwise(smoothed).alias("p"))
    return rows


def asked(rows: DataFrame, column: str, keys_of: Callable[[pa.Array], np.ndarray], edges: DataFrame, root: np.ndarray, depth: int, bits: int) -> DataFrame:
    """``chunk, key, p`` of the different keys of each ``chunk`` of ``rows``."""

    def ask(group: pa.Table) -> pa.Table:
        found = [np.unique(keys_of(part.column(column))) for batch in group.select([column]).to_batches() for part in by_bytes(batch, column)]
        keys = np.unique(np.concatenate(found))
        return pa.table({"chunk": pa.repeat(group["chunk"][0], len(keys)), "key": pa.array(keys)})

    questions = saved(rows.select("chunk", column).groupBy("chunk").applyInArrow(ask, "chunk long, key long"))
    return questions.join(probabilities(questions.select("key").distinct(), edges, root, depth, bits), "key").select("chunk", "key", "p")


def _looked_up(answer: pa.Table) -> Callable[[np.ndarray], np.ndarray]:
    """The probability of each number from ``key, p`` rows."""
    keys, p = answer["key"].to_numpy(), answer["p"].to_numpy()
    order = np.argsort(keys)
    keys, p = keys[order], p[order]
    return lambda key: p[np.searchsorted(keys, key)]


class Model:
    """Both trees, and the weight ``trust`` (in tokens; the number of different words) of the inner tree beside the counted words."""

    def __init__(self, inner: Tree, outer: Tree, tokens: int, trust: float):
        self.inner, self.outer, self.tokens, self.trust = inner, outer, tokens, max(trust, 1.0)
        self.bytes = (inner.root + 0.5) / (inner.root.sum() + 128)
        symbols = np.arange(1 << 16)
        b1, b2 = symbols >> 8, symbols & 255
        start = self.inner.probability((WORD_END << 8) | np.arange(256), self.bytes)
        pair = start[b1] * self.inner.probability((WORD_END << 16) | symbols, self.bytes)
        pair[(b1 == TEXT_END) & (b2 != 0)] = 0
        pair[TEXT_END << 8] = start[TEXT_END]
        self.first = (outer.root + self.trust * pair) / (self.tokens + self.trust)

    def words(self, array: pa.Array, n: np.ndarray, inner_of: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """log10 probability of each word given its first two symbols; ``inner_of`` answers for an inner tree that is not here."""
        if not len(array):
            return np.zeros(0)
        key, row = grams(array)
        p = self.inner.probability(key, self.bytes) if inner_of is None else inner_of(key)
        inner = 10 ** np.maximum(np.bincount(row, np.log10(p), len(array)), -300)
        body, offsets = raw_bytes(array)
        first = (body[offsets[:-1]].astype(np.int64) << 8) | np.where(np.diff(offsets) > 1, body[np.minimum(offsets[:-1] + 1, len(body) - 1)], WORD_END)
        return np.log10((n + self.trust * inner) / (self.tokens + self.trust)) - np.log10(self.first[first])

    def edges(self, key: np.ndarray, outer_of: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        p = self.outer.probability(key, self.first) if outer_of is None else outer_of(key)
        return np.log10(np.maximum(p, 1e-300))


def score(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row, learning from rows without ``held_out``."""
    own = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), held_out.alias("held_out"))
    rows, size = own.agg(F.count_if(~F.col("held_out")), F.sum(F.octet_length("text"))).first()
    training = own.select("text", (~F.col("held_out")).alias("train"))
    words = saved(word_counts(training))
    tokens, known = words.agg(F.sum("n"), F.count_if(F.col("n") > 0)).first()
    tokens, known = (tokens or 0) + rows, known + (rows > 0)
    ends = docs.sparkSession.createDataFrame([((WORD_END << 8) | TEXT_END, rows)], "key long, n long").where("n > 0")
    rows_of = lambda edges: np.stack([c.to_numpy().astype(np.int64) for c in edges.toArrow().columns], 1)  # noqa: E731  at most MOST_EDGES, or levels of 65,536
    inner_edges = saved(states(inner_counts(words).unionByName(ends), DEPTH, 8))
    outer_edges = saved(states(outer_counts(training.where("train")), OUTER, 16))
    many_inner, many_outer = inner_edges.count() > MOST_EDGES, outer_edges.count() > MOST_EDGES
    # of a large tree the model holds what the first two symbols of words need: levels 0 and 1 and the contexts of one byte after a word end
    head = (F.col("k") < 2) | ((F.col("k") == 2) & (F.shiftright("context", 8) == WORD_END))
    inner = Tree(rows_of(inner_edges.where(head) if many_inner else inner_edges), DEPTH, 8)
    outer = Tree(rows_of(outer_edges.where("k = 0") if many_outer else outer_edges), OUTER, 16)
    model = Model(inner, outer, tokens, known)
    below = tokens + 0.1 * (known + 1)
    end_base = float(np.log10((rows + 0.1) / below))

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "word"):
                n = part.column("n")
                yield pa.RecordBatch.from_arrays([part.column("word"), n, pa.array(model.words(part.column("word"), n.to_numpy()))], names=["word", "n", "lp"])

    valued = "word binary, n long, lp double"
    if many_inner:
        bulk = words.agg(F.sum(F.octet_length("word") + 16)).first()[0] or 0
        dealt = words.withColumn("chunk", F.pmod(F.xxhash64("word"), F.lit(max(1, -(-bulk // CHUNK_BYTES)))))

        def value_asked(group: pa.Table, answer: pa.Table) -> pa.Table:
            inner_of, lp = _looked_up(answer), []
            for batch in group.to_batches():
                for part in by_bytes(batch, "word"):
                    lp.append(model.words(part.column("word"), part.column("n").to_numpy(), inner_of))
            return pa.table({"word": group["word"], "n": group["n"], "lp": np.concatenate(lp)})

        answered = asked(dealt, "word", lambda array: grams(array)[0], inner_edges, model.bytes, DEPTH, 8)
        values = dealt.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(value_asked, valued)
    else:
        values = words.mapInArrow(value, valued)
    chunks = max(1, -(-(size or 0) // CHUNK_BYTES))
    chunked = own.withColumn("chunk", F.pmod(F.xxhash64("id", F.md5("text")), F.lit(chunks)))

    def ask(group: pa.Table) -> pa.Table:
        seen = set(chain.from_iterable(words_of(t) for batch in group.select(["text"]).to_batches() for t in batch.column(0).to_pylist()))
        return pa.table({"chunk": pa.repeat(group["chunk"][0], len(seen)), "word": pa.array(list(seen), pa.binary())})

    answers = chunked.groupBy("chunk").applyInArrow(ask, "chunk long, word binary").join(values, "word")
    if many_outer:
        edge_keys = lambda array: word_edges(*lower_bytes(array))[0]
        answers = answers.unionByName(asked(chunked, "text", edge_keys, outer_edges, model.first, OUTER, 16), allowMissingColumns=True)

    def add_up(group: pa.Table, answer: pa.Table) -> pa.Table:
        outer_of = None
        if many_outer:
            outer_of = _looked_up(answer.filter(pc.is_valid(answer["key"])))
            answer = answer.filter(pc.is_valid(answer["word"]))
        place = dict(zip(answer["word"].to_pylist(), range(answer.num_rows), strict=True))
        n = answer["n"].to_numpy()
        base, lp = np.log10((n + 0.1) / below), answer["lp"].to_numpy()
        out, i = np.zeros((4, group.num_rows)), 0
        for batch in group.select(["text"]).to_batches():
            for part in by_bytes(batch):
                edges, bounds = word_edges(*lower_bytes(part.column("text")))
                own_edges = np.add.reduceat(model.edges(edges, outer_of), bounds[:-1])
                for t, edge in zip(part.column("text").to_pylist(), own_edges, strict=True):
                    at = np.fromiter(map(place.__getitem__, words_of(t)), np.int64)
                    out[:, i] = len(at) + 1, (n[at] > 0).sum() + (rows > 0), base[at].sum() + end_base, lp[at].sum() + edge
                    i += 1
        whole = out[:2].astype(np.int64)
        return pa.table({"id": group["id"], "held_out": group["held_out"], "n_tokens": whole[0], "n_known": whole[1], "train_tokens": np.full(group.num_rows, tokens, np.int64), "base_score": out[2], "score": out[3]})

    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(add_up, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
