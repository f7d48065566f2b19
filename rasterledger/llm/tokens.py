"""Token ids of whole texts from a tokenizer file, in batches.

White space never shares a token with what stands before it, so a text may be cut
in front of each run of white space. The distinct pieces of a batch are encoded
once each; a text that holds a control character that libraries class differently is
encoded whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from .common import RELEASE

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed: Unicode white space without the separators that only some libraries count as such.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")
LEADING = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


#: Bytes of text encoded at once: the larger, the fewer pieces are met again.
ENCODED_BYTES = 2 << 20


class Encoder:
    """``keep_space``: white space belongs to the piece that follows it; else the tokenizer drops it.

    The first ``most_cached`` different pieces that a worker meets stay known; once
    these are reached, further pieces are known for one batch only.
    """

    def __init__(self, path: str, keep_space: bool, most_cached: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cut = LEADING.findall if keep_space else str.split
        self.most_cached = most_cached
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 12, np.int64)
        self.n = 0

    def pieces(self, text: str) -> list[str]:
        return [text] if ODD.search(text) else self.cut(text)

    def _learn(self, new: list[str]) -> None:
        encoded = [x.ids for x in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        begin = int(self.ends[self.n - 1]) if self.n else 0
        end = begin + int(lengths.sum())
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), end - len(self.ids)), np.uint32)])
        if self.n + len(new) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(len(self.ends), len(new)), np.int64)])
        self.ids[begin:end] = np.fromiter(chain.from_iterable(encoded), np.uint32, end - begin)
        self.ends[self.n : self.n + len(new)] = begin + np.cumsum(lengths)
        self.known.update(zip(new, range(self.n, self.n + len(new))))
        self.n += len(new)

    def _forget(self, new: list[str]) -> None:
        if self.n > self.most_cached:
            for piece in new:
                del self.known[piece]
            self.n -= len(new)

    def _numbers(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Cache numbers of all pieces in a row, how many each text has, and the pieces not known before."""
        cut = [self.pieces(text) for text in batch]
        flat = list(chain.from_iterable(cut))
        new = list(set(flat).difference(self.known))
        if new:
            self._learn(new)
        numbers = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        return numbers, np.fromiter(map(len, cut), np.int64, len(cut)), new

    def counts(self, batch: list[str]) -> np.ndarray:
        """Tokens of each text."""
        numbers, per_text, new = self._numbers(batch)
        lengths = self.ends[numbers] - np.where(numbers > 0, self.ends[numbers - 1], 0)
        self._forget(new)
        total = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        return total[bounds[1:]] - total[bounds[:-1]]

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32) with n+1 bounds."""
        numbers, per_text, new = self._numbers(batch)
        starts = np.where(numbers > 0, self.ends[numbers - 1], 0)
        lengths = self.ends[numbers] - starts
        done = np.cumsum(lengths)
        shift = np.repeat(starts - done + lengths, lengths)
        shift += np.arange(len(shift))
        ids = self.ids[shift]
        self._forget(new)
        total = np.concatenate([[0], done])
        return ids, total[np.concatenate([[0], np.cumsum(per_text)])]


_encoders: dict[tuple[str, bool], Encoder] = {}
RELEASE.append(_encoders.clear)  # work on bytes never runs together with encoding


def encoder(path: str, keep_space: bool) -> Encoder:
    """One encoder for each Python worker."""
    if (path, keep_space) not in _encoders:
        _encoders[path, keep_space] = Encoder(path, keep_space)
    return _encoders[path, keep_space]
