"""Edit distances with bit-parallel columns: of any sequences of hashable symbols, and of many pairs of lines at a time in numpy."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Hashable, Iterable, Iterator, Sequence

import numpy as np

#: Pairs of so many characters are looked at together, and so many words of 64 characters; a table of their masks holds at most so many numbers.
PIECE_CHARS, WORDS, MASKS = 1 << 20, 4096, 1 << 20
#: Pairs are compared one by one if their words and 16 for each pair are fewer. Lines beyond so many characters are long.
FEW_TOGETHER, LONG = 192, 8192


def prefix_distances(pattern: Sequence[Hashable], window: Iterable[Hashable]) -> Iterator[int]:
    """The edit distance between ``pattern`` (not empty) and each beginning of ``window``, from one symbol on."""
    n = len(pattern)
    ones, top = (1 << n) - 1, 1 << (n - 1)
    masks: dict[Hashable, int] = {}
    for i, symbol in enumerate(pattern):
        masks[symbol] = masks.get(symbol, 0) | 1 << i
    plus, minus, score = ones, 0, n
    for symbol in window:
        equal = masks.get(symbol, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(across | plus), plus & across
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & ones, down << 1 & ones
        plus, minus = (down | ~(vertical | up)) & ones, up & vertical & ones
        yield score


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    if not a or not b:
        return max(len(a), len(b))
    score = 0
    for score in prefix_distances(a, b):  # noqa: B007
        pass
    return score


def banded(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether ``a`` and ``b`` are at most ``most`` edits apart; exact, only the diagonals that few edits reach are followed, four times as many where these do not do."""
    if len(a) < len(b):
        a, b = b, a
    masks = {symbol: int.from_bytes(np.packbits(a == symbol, bitorder="little").tobytes(), "little") for symbol in np.unique(a).tolist()}
    k, most = 64, min(most, len(a))
    while True:
        k = min(most, max(k, len(a) - len(b)))
        if len(a) - len(b) > k:
            return False
        width = 2 * k + 1
        ones, corner, low = (1 << width) - 1, 1 << width - 1, 1 << width - 2 if width > 1 else 0
        plus, minus, score, at = ones & ones << (width - k - 1), 0, k, k + 1 - width
        for i, symbol in enumerate(b.tolist()):
            equal = masks.get(symbol, 0)
            equal = (equal >> at if at >= 0 else equal << -at) & ones
            diagonal = (((equal & plus) + plus) ^ plus) | equal | minus
            up, down = (minus | ~(diagonal | plus)) & ones, diagonal & plus & ones
            if i < len(a) - k:
                score += not diagonal & corner
            else:
                score += bool(up & low) - bool(down & low)
                low >>= 1
            diagonal = (diagonal & ones) >> 1
            plus, minus, at = (down | ~(diagonal | up)) & ones, diagonal & up, at + 1
        if score <= k:
            return True
        if k == most:
            return False
        k *= 4


def aligned_cost(a: list[str], b: list[str]) -> int:
    """An upper bound of the distance in characters between two lines of words, each word with its space.

    Words that occur once in both lines and in the same order are kept; between them equal beginnings and
    ends are kept and the rest is replaced.
    """
    place, in_a, in_b = {w: j for j, w in enumerate(b)}, Counter(a), Counter(b)
    common = [(i, place[w]) for i, w in enumerate(a) if in_a[w] == 1 and in_b[w] == 1]
    # the longest run of kept words whose places rise in both lines
    ends: list[int] = []
    nodes: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(common):
        at = bisect_left(ends, j)
        before.append(nodes[at - 1] if at else -1)
        ends[at : at + 1], nodes[at : at + 1] = [j], [k]
    kept, k = [(len(a), len(b))], nodes[-1] if nodes else -1
    while k >= 0:
        kept.append(common[k])
        k = before[k]
    cost, i, j = 0, 0, 0
    for to_i, to_j in reversed(kept):
        stop_i, stop_j = to_i, to_j
        while i < stop_i and j < stop_j and a[i] == b[j]:
            i, j = i + 1, j + 1
        while i < stop_i and j < stop_j and a[stop_i - 1] == b[stop_j - 1]:
            stop_i, stop_j = stop_i - 1, stop_j - 1
        cost += max(sum(map(len, a[i:stop_i])) + stop_i - i, sum(map(len, b[j:stop_j])) + stop_j - j)
        i, j = to_i + 1, to_j + 1
    return cost


def within(a: str, b: str, most: float) -> bool:
    """Whether two lines of words are at most ``most`` edits apart; exact, bounds from words and letters come first."""
    if aligned_cost(a.split(" "), b.split(" ")) <= most:
        return True
    letters, others = Counter(a), Counter(b)
    if max((letters - others).total(), (others - letters).total()) > most:
        return False
    return distance(a, b) <= most


def _pieces(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of about ``most`` in all; a larger number is alone."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + most, "right")))
        yield slice(start, stop)
        start = stop


class Compared:
    """Lines whose pairs are compared many at a time."""

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.size = np.array([len(x) for x in lines], np.int64)
        self.at = np.cumsum(self.size) - self.size
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        used = np.zeros(int(codes.max(initial=0)) + 1, bool)
        used[codes] = True
        self.codes = (np.cumsum(used) - 1)[codes]
        line = np.repeat(np.arange(len(lines)), self.size)
        self.letters = np.bincount(line * 64 + self.codes % 64, minlength=64 * len(lines)).astype(np.int32).reshape(-1, 64)

    def _same(self, a: np.ndarray, b: np.ndarray, step: int, most: np.ndarray) -> np.ndarray:
        """How many characters from the places ``a`` and ``b`` on are equal, at most ``most``."""
        out = np.zeros(len(a), np.int64)
        for own in _pieces(most, PIECE_CHARS):
            n = most[own]
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            differs = self.codes[np.repeat(a[own], n) + step * place] != self.codes[np.repeat(b[own], n) + step * place]
            pair = np.repeat(np.arange(len(n)), n)[differs]
            out[own] = n
            np.minimum.at(out[own], pair, place[differs])
        return out

    def within(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether the lines ``a`` and ``b`` of each pair are at most ``most`` edits apart; exact, bounds come first."""
        least = np.zeros(len(a), np.int64)
        for k in range(0, len(a), 4096):
            more = self.letters[a[k : k + 4096]] - self.letters[b[k : k + 4096]]
            least[k : k + 4096] = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))
        out = np.zeros(len(a), bool)
        left = np.flatnonzero(least <= most)
        x, y = a[left], b[left]
        shorter = np.minimum(self.size[x], self.size[y])
        head = self._same(self.at[x], self.at[y], 1, shorter)
        tail = self._same(self.at[x] + self.size[x] - 1, self.at[y] + self.size[y] - 1, -1, shorter - head)
        m, n = self.size[x] - head - tail, self.size[y] - head - tail
        out[left[np.maximum(m, n) <= most[left]]] = True
        rest = np.flatnonzero((np.maximum(m, n) > most[left]) & (np.minimum(m, n) > 0))
        long = np.minimum(m, n)[rest] > LONG
        for k in rest[long].tolist():
            old, new = (self.codes[self.at[i] + head[k] :][:size] for i, size in ((x[k], m[k]), (y[k], n[k])))
            out[left[k]] = banded(old, new, int(most[left[k]]))
        rest = rest[~long]
        p, q, m, n = self.at[x[rest]] + head[rest], self.at[y[rest]] + head[rest], m[rest], n[rest]
        swap = m > n
        p, q, m, n = np.where(swap, q, p), np.where(swap, p, q), np.minimum(m, n), np.maximum(m, n)
        words = -(-m // 64)
        order = np.argsort(-(words + n), kind="stable")
        far, masks = np.zeros(len(rest), np.int64), words * (int(self.codes.max(initial=0)) + 2)
        for piece in _pieces(np.maximum(words[order] * (MASKS // WORDS), masks[order]), MASKS):
            k = order[piece]
            if 16 * len(k) + words[k].sum() < FEW_TOGETHER:
                far[k] = [distance(self.codes[p[i] : p[i] + m[i]].tolist(), self.codes[q[i] : q[i] + n[i]].tolist()) for i in k.tolist()]
            else:
                far[k] = _distances(self.codes, p[k], m[k], q[k], n[k])
        out[left[rest]] = far <= most[left[rest]]
        return out


def _distances(codes: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Edit distances of the ``m`` codes from ``p`` on and the ``n`` from ``q`` on, both not empty; words of 64 codes and ``n`` together fall.

    A step takes each pair's first 64 codes to their next column, and each further 64 to the column that those before them have just left."""
    one, top = np.uint64(1), np.uint64(63)
    words = -(-m // 64)
    last = np.cumsum(words) - 1
    units = int(last[-1]) + 1
    word = np.arange(units) - np.repeat(last + 1 - words, words)
    row = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    pattern = codes[np.repeat(p, m) + row]
    used = np.zeros(int(codes.max()) + 1, bool)
    used[pattern] = True
    # the last masks are empty: symbols of no pattern, and columns before the first
    none = int(used.sum()) * units
    known = np.where(used, (np.cumsum(used) - 1) * units, none)
    masks = np.zeros(none + units, np.uint64)
    np.add.at(masks, known[pattern] + np.repeat(last + 1 - words, m) + row // 64, one << (row % 64).astype(np.uint64))
    steps = words + n - 1
    begin = np.cumsum(steps) - n
    text = np.full(int(steps.sum() + steps[0]), none)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    text[np.repeat(begin, n) + place] = known[codes[np.repeat(q, n) + place]]
    at = np.repeat(begin, words) - word
    plus, minus = np.full(units, ~np.uint64(0)), np.zeros(units, np.uint64)
    up, down = np.zeros(units, np.uint64), np.zeros(units, np.uint64)
    unit, heads = np.arange(units), last + 1 - words
    score, bit = m.copy(), ((m - 1) % 64).astype(np.uint64)
    active = np.searchsorted(-steps, -np.arange(int(steps[0])), "left")  # pairs of more steps
    for t, pairs in enumerate(active.tolist()):
        k = int(last[pairs - 1]) + 1
        up[heads[:pairs]], down[heads[:pairs]] = 1, 0
        e, above, below, rises, falls = masks[text[at[:k] + t] + unit[:k]], plus[:k], minus[:k], up[:k], down[:k]
        vertical = e | below
        e |= falls
        across = (((e & above) + above) ^ above) | e
        rise, fall = below | ~(across | above), above & across
        ends = last[:pairs]
        # a pair's last word is in a column from its step words - 1 on
        score[:pairs] += np.where(t >= words[:pairs] - 1, (rise[ends] >> bit[:pairs] & one).astype(np.int64) - (fall[ends] >> bit[:pairs] & one).astype(np.int64), 0)
        next_up, next_down = rise >> top, fall >> top
        rise, fall = rise << one | rises, fall << one | falls
        plus[:k] = fall | ~(vertical | rise)
        minus[:k] = rise & vertical
        up[1:k], down[1:k] = next_up[:-1], next_down[:-1]
    return score
