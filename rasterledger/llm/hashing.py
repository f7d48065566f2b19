"""Words and word shingles of whole texts as 64-bit numbers, a batch at a time in numpy."""

from __future__ import annotations

import numpy as np

#: Fixed: words are runs of bytes outside \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_RNG = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = pow(int(_BASE), -1, 2**64)
#: Spans of about so many bytes are hashed together.
SPAN_BYTES = 1 << 18
_PLACE = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: All ASCII bytes but letters and digits.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = int(_BASE)) -> np.ndarray:
    """``base`` to the powers from 0 on, at least ``n`` of them."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        out = np.empty(max(n, 4096), np.uint64)
        out[0] = 1
        np.multiply.accumulate(np.full(len(out) - 1, base, np.uint64), out=out[1:])
        held = _powers[base] = out
    return held


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; other seeds give other functions."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(body: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs outside the bytes of ``gap``), and for each text the number of words before it (n+1 numbers)."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~gap[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(body), bool)
    before[0] = True
    np.logical_or(~inside[:-1], edge[1:-1], out=before[1:])
    after = np.empty(len(body), bool)
    after[-1] = True
    np.logical_or(~inside[1:], edge[1:-1], out=after[:-1])
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are disjoint, in order and not empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths, out = ends - starts, np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SPAN_BYTES, "right")))
        at, own = starts[i:j] - starts[i], body[starts[i] : ends[j - 1]]
        # sums of bytes times powers up to each place; what stands before a span goes, and so do the powers
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(_BYTE[own] * powers(len(own))[: len(own)], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - starts[i]] - sums[at]) * powers(len(own), _INVERSE)[at]
        i = j
    return mix(out + lengths.astype(np.uint64))


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles with n+1 bounds by text; a text of fewer words has one, an empty text none."""
    counts = np.diff(bounds)
    rows = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(rows)])
    out = np.zeros(int(out_bounds[-1]), np.uint64)
    if not len(out):
        return out, out_bounds
    full = np.repeat(counts >= k, rows)
    at = np.arange(len(out)) - np.repeat(out_bounds[:-1], rows) + np.repeat(bounds[:-1], rows)
    ahead = at[full]
    long = np.zeros(len(ahead), np.uint64)
    for j in range(k):
        long += words[ahead + j] * _PLACE[j]
    out[full] = mix(long, 1)
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = words[bounds[i] : bounds[i + 1]]
        out[out_bounds[i]] = mix((own * _PLACE[: len(own)]).sum(dtype=np.uint64, keepdims=True), 1 + len(own) + k)[0]
    return out, out_bounds
