"""Words of many texts at once: cut and hashed in numpy, numbered by an open table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Characters of one piece of work, and odd bases of two position-weighted hashes modulo 2**64.
PIECE, _BASES = 1 << 18, (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MIX = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_SHIFTS = tuple(np.uint64(x) for x in (29, 32, 1))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return out.cumprod(dtype=np.uint64)


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses, at least n."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        n = max(n, PIECE + 2)
        _POWERS[:] = [(_powers(b, n), _powers(pow(b, -1, 1 << 64), n)) for b in _BASES]
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _SHIFTS[1])
    x *= _MIX[2]
    x ^= x >> _SHIFTS[0]
    x *= _MIX[1]
    x ^= x >> _SHIFTS[1]
    return x


def hash_spans(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, count: int = 2) -> list[np.ndarray]:
    """`count` (1 or 2) 64-bit hashes of each span of characters; none is 0."""
    value = (points.astype(np.uint64) + np.uint64(0x9E37)) * _MIX[0]
    value ^= value >> _SHIFTS[1]
    out = []
    for direct, inverse in powers(len(points) + 1)[:count]:
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(value * direct[: len(points)], out=sums[1:])
        out.append(mixed((sums[ends] - sums[starts]) * inverse[starts]) | _SHIFTS[2])
    return out


_WHITE = np.zeros(64, bool)
_WHITE[[0x20, *range(0x09, 0x0E), 0]] = True


def word_spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of characters other than ASCII white space and U+0000."""
    white = np.empty(len(points) + 2, bool)
    white[0] = white[-1] = True
    inner = white[1:-1]
    np.less(points, 64, out=inner)
    small = np.flatnonzero(inner)
    inner[small] = _WHITE[points[small]]
    edges = np.flatnonzero(white[1:] != white[:-1])
    return edges[::2], edges[1::2]


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class WordTable:
    """Numbers for distinct words, found by 128-bit hashes; `clear` starts anew.

    `find` cuts texts, joined and ended by U+0000, by the given function, which returns where words
    start (each reaches to the next start), and looks the words up. `add` numbers the new ones.
    """

    def __init__(self, most_words: int, cut: Callable[[np.ndarray], np.ndarray], capacity: int = 1 << 20) -> None:
        self.most_words, self.mask, self.cut = min(most_words, capacity // 2), capacity - 1, cut
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.checks = np.zeros(self.mask + 1, np.uint64)
        self.numbers = np.zeros(self.mask + 1, np.int32)
        self.n = 0

    def find(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where words start, their ends, and the numbers of known ones, -1 for others. The U+0000
        are among them, with number -2."""
        points = points_of(text)
        starts = self.cut(points)
        ends = np.append(starts[1:], len(points))
        numbers = self.look_up(points, starts, ends)
        numbers[points[starts] == 0] = -2
        return starts, ends, numbers

    def look_up(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.h = hash_spans(points, starts, ends)
        numbers = np.full(len(starts), -1, np.int64)
        todo = np.arange(len(starts))
        slot = (h[0] >> np.uint64(20)).astype(np.int64) & self.mask
        while len(todo):
            key = self.keys[slot]
            hit = (key == h[0][todo]) & (self.checks[slot] == h[1][todo])
            numbers[todo[hit]] = self.numbers[slot[hit]]
            on = ~hit & (key != 0)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return numbers

    def add(self, numbers: np.ndarray) -> np.ndarray:
        """Gives numbers to those found as -1, in place; returns a place of each new one."""
        at = np.flatnonzero(numbers == -1)
        if not len(at):
            return at
        _, first, back = np.unique(self.h[0][at], return_index=True, return_inverse=True)
        new = np.arange(self.n, self.n + len(first))
        numbers[at] = new[back]
        places = at[first]
        todo, slot = np.arange(len(first)), (self.h[0][places] >> np.uint64(20)).astype(np.int64) & self.mask
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == 0)
            won = free[np.unique(slot[free], return_index=True)[1]]
            p, s = places[todo[won]], slot[won]
            self.keys[s], self.checks[s], self.numbers[s] = self.h[0][p], self.h[1][p], new[todo[won]]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, slot = todo[left], slot[left]
            slot = np.where(self.keys[slot] != 0, (slot + 1) & self.mask, slot)
        self.n += len(first)
        return places


def pieces(texts: list[str]) -> Iterator[list[int]]:
    """Numbers of texts in groups of less than PIECE characters with an end each, or of one text."""
    group, n = [], 0
    for k, t in enumerate(texts):
        if group and n + len(t) + 1 > PIECE:
            yield group
            group, n = [], 0
        group.append(k)
        n += len(t) + 1
    if group:
        yield group
