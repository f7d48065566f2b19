"""Secret scans: fixed patterns, and formats inferred as probabilistic automata.

The fixed patterns give the base spans. Their matches are also the labelled
credentials (label: the pattern's kind). For each kind the labelled strings form a
prefix tree; states whose outgoing and final frequencies are compatible by a Hoeffding
bound are merged, children included (red states are kept, blue ones merged or
promoted), which leaves a deterministic probabilistic automaton. What the base spans
leave of every run of credential characters is then scored by its likelihood per
character against single characters of the same classes, and if it is not accepted,
each of its parts between ``=``; only what is shorter than all labelled strings is
not. What scores like the labelled strings is added as a span of kind ``format``.

At most ``per_kind`` labelled strings of up to ``longest`` characters train an automaton,
chosen by a hash of id and place; that is the only bounded sample. All candidates of
all whole texts are scored, in one pass without a shuffle.

Null text is empty. Texts without spans have counts 0 and the digest of an empty
string. Repeated rows stay; an empty table gives an empty result; without labelled
strings no span is added. Offsets are code points, the end is exclusive. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, raw_bytes, texts

#: Fixed patterns, in the order of their kinds.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = {"assign": 6, "access": 20, "hex": 24}
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: A part of a run, with its padding at the end of the run.
PART = re.compile(r"[^=]+(?:=+$)?")
FORMAT = "format"


def _mask(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_DIGITS, _LOWER, _UPPER = b"0123456789", bytes(range(97, 123)), bytes(range(65, 91))
_HEX, _CAPS, _TOKEN = _mask(_DIGITS + b"abcdef"), _mask(_DIGITS + _UPPER), _mask(_DIGITS + _LOWER + _UPPER + b"+/_.=-")
#: Character classes: digits, letters of hexadecimal numbers, other letters, by case; anything else stands for itself.
CLASS = {**{chr(c): "9" for c in _DIGITS}, **{chr(c): "a" if c < 103 else "z" for c in _LOWER}, **{chr(c): "A" if c < 71 else "Z" for c in _UPPER}}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the fixed patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(out)


def credentials(text: str) -> Iterator[tuple[int, str]]:
    """Kind number and the secret itself of each base span."""
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= LEAST["assign"]:
            yield 0, m[2]
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        for m in pattern.finditer(text):
            if len(m[0]) >= LEAST[KINDS[kind]]:
                yield kind, m[0]


class Automaton:
    """A deterministic probabilistic automaton over character classes, learnt from strings."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.next: list[dict[str, int]] = [{}]
        self.times: list[dict[str, int]] = [{}]
        self.final, self.seen = [0], [0]
        for s in strings:
            self._grow([CLASS.get(c, c) for c in s])
        # over fewer strings the bound is above 1 and tells no two states apart, so the tree stays as it is
        if 2 * self.bound <= math.sqrt(len(strings)):
            self._merge_states()

    def _grow(self, symbols: list[str]) -> None:
        state = 0
        self.seen[0] += 1
        for c in symbols:
            if c not in self.next[state]:
                self.next[state][c] = len(self.next)
                self.next.append({})
                self.times.append({})
                self.final.append(0)
                self.seen.append(0)
            self.times[state][c] = self.times[state].get(c, 0) + 1
            state = self.next[state][c]
            self.seen[state] += 1
        self.final[state] += 1

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        return bool(n and m) and abs(f / n - g / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = self.seen[a], self.seen[b]
            if self._differ(self.final[a], n, self.final[b], m):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                if self._differ(self.times[a].get(c, 0), n, self.times[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    stack.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below ``b`` to ``a``."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.final[a] += self.final[b]
            self.seen[a] += self.seen[b]
            for c, child in self.next[b].items():
                self.times[a][c] = self.times[a].get(c, 0) + self.times[b][c]
                if c in self.next[a]:
                    stack.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _merge_states(self) -> None:
        red = [0]
        while True:
            kept = set(red)
            blue = [(self.seen[t], s, c, t) for s in red for c, t in self.next[s].items() if t not in kept]
            if not blue:
                break
            _, parent, c, state = max(blue)
            for other in red:
                if self._compatible(other, state):
                    self.next[parent][c] = other
                    self._fold(other, state)
                    break
            else:
                red.append(state)
        place = {s: k for k, s in enumerate(red)}
        self.next = [{c: place[t] for c, t in self.next[s].items()} for s in red]
        self.times, self.final, self.seen = ([x[s] for s in red] for x in (self.times, self.final, self.seen))

    def log_probability(self, text: str, missing: float = 1e-4) -> float:
        """Natural logarithm of the probability of the classes of ``text``; unseen steps weigh ``missing`` and start again."""
        state, total = 0, 0.0
        for ch in text:
            c = CLASS.get(ch, ch)
            n = self.seen[state]
            if c in self.next[state]:
                total += math.log(max(self.times[state][c] / n, missing))
                state = self.next[state][c]
            else:
                total += math.log(missing)
                state = 0
        return total + math.log(max(self.final[state] / self.seen[state], missing)) if self.seen[0] else -math.inf


class Formats:
    """Automata of all kinds with the least score of their own labelled strings."""

    def __init__(self, labelled: dict[int, list[str]], least_share: float = 0.02):
        self.automata = {kind: Automaton(strings) for kind, strings in sorted(labelled.items()) if strings}
        self.least = {kind: float(np.quantile([self.score(kind, s) for s in labelled[kind]], least_share)) for kind in self.automata}
        #: The length of the shortest labelled string; 0 without any.
        self.shortest = min((len(s) for strings in labelled.values() for s in strings), default=0)

    def score(self, kind: int, text: str) -> float:
        """Likelihood per character, against one class in eight by chance."""
        return (self.automata[kind].log_probability(text) + len(text) * math.log(8)) / (len(text) + 1)

    def accepts(self, text: str) -> bool:
        return any(self.score(kind, text) >= least for kind, least in self.least.items())


def _runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least ``least`` bytes; a run that crosses texts is found too long, never missed."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def _suspects(array: pa.Array, shortest: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Which texts may hold a base span, and which a candidate of at least ``shortest`` characters (0: none)."""
    body, offsets = raw_bytes(array)
    n = len(offsets) - 1
    base, candidate = np.zeros(n, bool), np.zeros(n, bool)

    def mark(out: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        first, last = np.searchsorted(offsets, starts, "right") - 1, np.searchsorted(offsets, ends, "left") - 1
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            out[a : b + 1] = True

    mark(base, *_runs(_HEX[body], offsets, LEAST["hex"]))
    mark(base, *_runs(_CAPS[body], offsets, LEAST["access"]))
    if shortest:
        mark(candidate, *_runs(_TOKEN[body], offsets, shortest))
    lowered = body.tobytes().lower()
    for word in KEYWORDS:
        at = lowered.find(word)
        while at >= 0:
            i = int(np.searchsorted(offsets, at, "right")) - 1
            base[i] = True
            at = lowered.find(word, max(at + 1, int(offsets[i + 1])))
    return base, candidate


def labelled_strings(docs: DataFrame, per_kind: int = 200, longest: int = 128, id_column: str = "doc_id", text_column: str = "text") -> dict[int, list[str]]:
    """At most ``per_kind`` labelled strings of each kind, those whose hash of id and place is least."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, str]]] = {}
        for batch in batches:
            for part in by_bytes(batch):
                body = texts(part.column("text"))
                base, _ = _suspects(body)
                for i in np.flatnonzero(base):
                    key = str(part.column("id")[int(i)].as_py())
                    for k, (kind, s) in enumerate(credentials(body[int(i)].as_py())):
                        if len(s) <= longest:
                            best.setdefault(kind, []).append((zlib.crc32(f"{key}:{k}".encode()), s))
                for kind, found in best.items():
                    if len(found) > 4 * per_kind:
                        best[kind] = sorted(found)[:per_kind]
        rows = [(kind, rank, s) for kind, found in best.items() for rank, s in sorted(found)[:per_kind]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["kind", "rank", "secret"])

    found = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(find, "kind int, rank long, secret string")
    top = found.withColumn("nr", F.row_number().over(Window.partitionBy("kind").orderBy("rank", "secret"))).where(F.col("nr") <= per_kind)
    out: dict[int, list[str]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["kind"], r["nr"])):
        out.setdefault(r["kind"], []).append(r["secret"])
    return out


def _accepted(text: str, start: int, end: int, formats: Formats) -> list[tuple[int, int]]:
    """The piece of a run if it scores like a labelled string, or else its parts that do."""
    if end - start < formats.shortest:
        return []
    if formats.accepts(text[start:end]):
        return [(start, end)]
    spans = [m.span() for m in PART.finditer(text, start, end)]
    return [(s, e) for s, e in spans if e - s >= formats.shortest and (s, e) != (start, end) and formats.accepts(text[s:e])]


def scan_text(text: str, formats: Formats) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    taken: list[list[int]] = []
    for s, _, e in base:
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(e, taken[-1][1])
        else:
            taken.append([s, e])
    more, at = [], 0
    for m in CANDIDATE.finditer(text) if formats.automata else ():
        start = m.start()
        while at < len(taken) and taken[at][0] < m.end():
            more += _accepted(text, start, taken[at][0], formats)
            start = max(start, taken[at][1])
            if taken[at][1] > m.end():
                break
            at += 1
        more += _accepted(text, start, m.end(), formats)
    return base, sorted(base + [(s, len(KINDS), e) for s, e in more])


def scan(docs: DataFrame, formats: Formats, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, n_assign, n_access, n_hex, base_sha256, spans, n_format`` of every row."""
    names = (*KINDS, FORMAT)
    written = lambda spans: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                body = texts(part.column("text"))
                base, candidate = _suspects(body, formats.shortest)
                n = len(body)
                counts, digests, spans = np.zeros((4, n), np.int64), [nothing] * n, [""] * n
                for i in np.flatnonzero(base | candidate).tolist():
                    own, every = scan_text(body[i].as_py(), formats)
                    for _, kind, _ in every:
                        counts[kind, i] += 1
                    digests[i], spans[i] = hashlib.sha256(written(own).encode()).hexdigest(), written(every)
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c) for c in counts[:3]), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3])], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"])

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")
