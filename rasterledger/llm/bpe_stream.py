"""BPE encoding and decoding of whole texts by bounded-lookahead transducers with constant memory.

Encoding. A text is read block by block. ``Scanner`` cuts it into the pieces of the
byte-level pattern, holding back only what the next characters may still change; a run
longer than ``LONG`` characters is passed on before its end is known. Pieces go through
the merge list: short ones are merged whole (and remembered up to a bound), long ones by
``Transducer``, which merges a window and emits the tokens that end ``lookahead`` bytes
before its end.

Why these are stable: a boundary between two tokens falls when rule ``(u, v)`` finds ``u``
before and ``v`` after it. Whether ``v`` stands there depends on its own bytes and on
whether an earlier rule ``(u', v')``, ``u'`` a suffix of ``v``, takes its end away. So rule
j needs ``len(v) + max(need of such earlier rules)`` bytes, and the largest need over all
rules is a sufficient lookahead of the merge list (``sufficient_lookahead``): texts that
agree up to so many bytes behind a boundary agree on it, and what follows a boundary
that stays is merged as if it stood alone.

Decoding. ``Text`` turns blocks of ids into bytes and bytes into text; a character that a
block leaves unfinished waits for the next one; bytes that are no UTF-8 become U+FFFD.

Rows do not move. Null text is empty (0 tokens); strings of added tokens inside a text
become these tokens; empty text, repeated rows and empty tables are what they are; other
columns are not read.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RELEASE, by_bytes, texts
from .tokens import WHITE

BLOCK = 1 << 16
LONG = 4096
SHORT = 64
MOST_KNOWN = 500_000
IDS_AT_ONCE = 1 << 14
#: Fixed: the pieces of byte-level tokenizers, and the runs that they are made of.
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
RUNS = {"L": regex.compile(r"\p{L}*"), "N": regex.compile(r"\p{N}*"), "S": regex.compile(f"[{WHITE}]*"), "O": regex.compile(rf"[^{WHITE}\p{{L}}\p{{N}}]*")}
#: One character of each kind, for characters that the tokenizer library takes for another kind than ``regex`` does.
LIKE = {"L": "a", "N": "1", "S": "\t", "O": "."}


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level tokenizer files write bytes: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(rules: list[tuple[bytes, bytes]]) -> int:
    """Bytes behind a boundary that decide whether it stays, for rules in order of their priority."""
    need_of: dict[bytes, int] = {}
    most = 0
    for u, v in rules:
        need = len(v) + max((need_of.get(v[k:], 0) for k in range(len(v))), default=0)
        need_of[u] = max(need, need_of.get(u, 0))
        most = max(most, need)
    return most


class MergeList:
    """Tokens and ordered rules of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = held["model"]["vocab"]
        added = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *added.values()], default=-1))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.added = added
        self.first = [0] * 256
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        rules = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in held["model"]["merges"]]
        self.ranks = {(vocab[u], vocab[v]): rank for rank, (u, v) in enumerate(rules)}
        self.results = [vocab[u + v] for u, v in rules]
        self.lookahead = sufficient_lookahead([(self.bytes_of[vocab[u]], self.bytes_of[vocab[v]]) for u, v in rules])

    def merged(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        ids = [self.first[b] for b in data]
        return self._short(ids) if len(ids) <= SHORT else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        rank, results, none = self.ranks.get, self.results, len(self.results)
        ranks = [rank(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i] = results[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same by a heap of (rank, place), for windows of many bytes."""
        n, rank, results = len(ids), self.ranks.get, self.results
        ahead, back = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(least, i) for i, pair in enumerate(zip(ids, ids[1:])) if (least := rank(pair)) is not None]
        heapify(heap)
        while heap:
            least, i = heappop(heap)
            j = ahead[i]
            if ids[i] < 0 or j >= n or rank((ids[i], ids[j])) != least:
                continue
            ids[i], ids[j], ahead[i] = results[least], -1, ahead[j]
            if ahead[j] < n:
                back[ahead[j]] = i
                if (found := rank((ids[i], ids[ahead[j]]))) is not None:
                    heappush(heap, (found, i))
            if back[i] >= 0 and (found := rank((ids[back[i]], ids[i]))) is not None:
                heappush(heap, (found, back[i]))
        return [x for x in ids if x >= 0]


class Transducer:
    """Ids of one piece of any length; holds at most a window of ``4 * lookahead`` bytes and what is fed at once."""

    def __init__(self, merges: MergeList):
        self.merges, self.window = merges, b""

    def feed(self, data: bytes) -> list[int]:
        """Tokens that nothing behind them can change any more."""
        self.window += data
        step, look, out, begin = max(4 * self.merges.lookahead, 256), self.merges.lookahead, [], 0
        while len(self.window) - begin >= step:
            part = self.window[begin : begin + step]
            at = 0
            for i in self.merges.merged(part):
                if at + len(self.merges.bytes_of[i]) > len(part) - look:
                    break
                at += len(self.merges.bytes_of[i])
                out.append(i)
            begin += at
        self.window = self.window[begin:]
        return out

    def finish(self) -> list[int]:
        out, self.window = self.merges.merged(self.window), b""
        return out


class Scanner:
    """Text in blocks to ids (little-endian, 32 bits each) in blocks."""

    def __init__(self, merges: MergeList, kind_of, known: dict[str, bytes]):
        self.merges, self.kind_of, self.known = merges, kind_of, known
        self.added = regex.compile("|".join(map(regex.escape, sorted(merges.added, key=len, reverse=True)))) if merges.added else None
        #: Pieces may still change if they end in the last so many characters.
        self.hold = max(map(len, merges.added), default=0) + 3
        self.held, self.kind, self.long = "", "", Transducer(merges)

    def feed(self, text: str) -> bytes:
        return self._block(text, False)

    def finish(self) -> bytes:
        return self._block("", True)

    def _block(self, text: str, last: bool) -> bytes:
        text, at, out = self.held + text, 0, []
        self.held = ""
        for m in self.added.finditer(text) if self.added else ():
            self._segment(text[at : m.start()], True, out)
            out.append(_packed([self.merges.added[m[0]]]))
            at = m.end()
        self._segment(text[at:], last, out)
        return b"".join(out)

    def _segment(self, text: str, ends: bool, out: list[bytes]) -> None:
        """Emit the pieces of ``text`` that are certain; all of them if the text ``ends`` here."""
        shape = self.kind_of.shape(text)
        sure = len(text) if ends else max(0, len(text) - self.hold)
        if self.kind:  # inside a run whose first part has been passed on
            run = RUNS[self.kind].match(shape).end()
            if run > sure or run == len(text) and not ends:
                out.append(_packed(self.long.feed(text[: min(run, sure)].encode())))
                self.held = text[min(run, sure) :]
                return
            if self.kind == "S" and run < len(text):  # the last white space goes with what follows
                run -= 1
            out.append(_packed(self.long.feed(text[:run].encode())))
            out.append(_packed(self.long.finish()))
            text, shape, sure, self.kind = text[run:], shape[run:], sure - run, ""
        pieces = PIECE.findall(shape)
        at = len(shape)
        while pieces and at > sure:
            at -= len(pieces.pop())
        if shape is not text:
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces], dtype=np.int64)]).tolist()
            pieces = [text[a:b] for a, b in zip(bounds, bounds[1:])]
        out.append(self._ids(pieces))
        self.held = text[at:]
        if len(self.held) > LONG + self.hold:
            rest = shape[at:]
            self.kind = next(k for k, run in RUNS.items() if run.match(rest, rest[0] == " " and not RUNS["S"].fullmatch(rest[1])).end() > 1)
            passed = len(self.held) - self.hold
            out.append(_packed(self.long.feed(self.held[:passed].encode())))
            self.held = self.held[passed:]

    def _ids(self, pieces: list[str]) -> bytes:
        known = self.known
        new = set(pieces).difference(known)
        for piece in new:
            known[piece] = _packed(self.merges.merged(piece.encode()) if len(piece) <= LONG else [*self.long.feed(piece.encode()), *self.long.finish()])
        out = b"".join(map(known.__getitem__, pieces))
        full = len(known) > MOST_KNOWN
        for piece in new:
            if full or len(piece) > SHORT:
                del known[piece]
        return out


class Kinds:
    """Letters, numbers, white space and others as the tokenizer library tells them, asked once for each character."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.met: set[str] = set()
        self.other: dict[int, str] = {}

    def shape(self, text: str) -> str:
        """``text``, with like characters in place of those that the library takes for another kind."""
        if text.isascii():
            return text
        found = set(text)
        for c in found - self.met:
            self.met.add(c)
            kind = next((k for k in "LNO" if len(self.cut(LIKE[k] + c)) == 1), "S")
            if not RUNS[kind].fullmatch(c):
                self.other[ord(c)] = LIKE[kind]
        return text.translate(self.other) if self.other and any(ord(c) in self.other for c in found) else text


class Text:
    """Ids in blocks to text in blocks."""

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of, self.machine = bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids.tolist())))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes() if ids else b""


_held: dict[str, tuple[MergeList, Kinds, dict[str, bytes]]] = {}
RELEASE.append(_held.clear)


def _of(path: str) -> tuple[MergeList, Kinds, dict[str, bytes]]:
    """Rules, kinds and known pieces, once for each Python worker."""
    if path not in _held:
        _held[path] = MergeList(path), Kinds(path), {}
    return _held[path]


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, n_tokens, ids`` per row; ``ids`` are unsigned 32-bit little-endian numbers in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                merges, kinds, known = _of(path)
                out = []
                for text in texts(part.column("text")).to_pylist():
                    scanner = Scanner(merges, kinds, known)
                    out.append(b"".join([*(scanner.feed(text[i : i + BLOCK]) for i in range(0, len(text), BLOCK)), scanner.finish()]))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())], names=["id", "n_tokens", "ids"])

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``id, n_tokens, ids`` with the ``text`` that the ids stand for; null ids are none. Ids beyond the file's raise an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "ids"):
                bytes_of, out = _of(path)[0].bytes_of, []
                for raw in part.column("ids").to_pylist():
                    ids, text = np.frombuffer(raw or b"", "<u4"), Text(bytes_of)
                    out.append("".join([*(text.feed(ids[i : i + IDS_AT_ONCE]) for i in range(0, len(ids), IDS_AT_ONCE)), text.finish()]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=["id", "n_tokens", "ids", "text"])

    return encoded.select("id", "n_tokens", "ids").mapInArrow(run, "id long, n_tokens long, ids binary, text string")
