"""Recompression of token sequences with content-named symbols, on whole batches in numpy.

A text's words are symbols of level 0. A round looks at neighbouring symbols only: the first joins
runs of one word, the others join pairs whose left symbol falls in the left half and whose right
symbol falls in the right half of the alphabet, halves being dealt by a bit of the name. Only
symbols of at most `limit` words take part in a round. A name is a 64-bit hash of the words that
the symbol stands for, so all tasks give a run or pair the same name without passing a dictionary
around. Whether a boundary between words survives depends on the `CONTEXT` words on either side
at most, so equal substrings have the same symbols except near their ends.
"""

from __future__ import annotations

import numpy as np

#: Longest symbols, in words, that take part in each round of pairs; runs are joined before them.
LIMITS = (1, 2, 4)
#: Words on either side of a boundary that decide whether it survives all rounds.
CONTEXT = 1 + sum(LIMITS)
#: Longest symbol in words, runs apart.
LONGEST = 2 * LIMITS[-1]

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(odd: np.uint64) -> np.uint64:
    with np.errstate(over="ignore"):
        x = odd
        for _ in range(6):
            x = x * (np.uint64(2) - odd * x)
        return x


class Hasher:
    """Hashes of any stretches of a batch of words, from sums of words times powers of a base."""

    def __init__(self, words: np.ndarray, base: int = 0) -> None:
        n = len(words) + 1
        powers = np.full(n, _BASES[base])
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.undo = np.full(n, _inverse(_BASES[base]))
        self.undo[0] = 1
        np.multiply.accumulate(self.undo, out=self.undo)
        self.sums = np.zeros(n, np.uint64)
        spread = mixed(words ^ _BASES[base]) if base else words
        np.cumsum(spread * powers[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words start to end (exclusive), by place."""
        raw = (self.sums[end] - self.sums[start]) * self.undo[start]
        return mixed(raw + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def parse(words: np.ndarray, doc: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the symbols after all rounds, and their names. words: 64-bit word hashes of the
    batch's texts, one behind another; doc: the number of the text of each word."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    same = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    starts = np.flatnonzero(np.r_[True, ~same])
    for level, limit in enumerate(LIMITS):
        ends = np.r_[starts[1:], len(words)]
        name = hasher(starts, ends)
        right_half = (mixed(name + np.uint64(level)) & np.uint64(1)).astype(bool)
        small = ends - starts <= limit
        joins = small[:-1] & small[1:] & ~right_half[:-1] & right_half[1:] & (doc[starts[:-1]] == doc[starts[1:]])
        starts = starts[np.r_[True, ~joins]]
    return starts, hasher(starts, np.r_[starts[1:], len(words)])


def anchors(words: np.ndarray, doc: np.ndarray, first: np.ndarray, window: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every window of `window` words the symbol inside it that names it: of the symbols whose
    boundaries the window alone decides, the one with the smallest name, the leftmost of equals.

    first: the place of the first word of each text, and the batch's length. Returns start and
    end of the chosen symbols, and the first and last window (by its first word) of each; windows
    without such a symbol (long runs of one word) form ranges of their own, with start -1.
    """
    n = len(words)
    starts, names = parse(words, doc, hasher)
    ends = np.r_[starts[1:], n]
    lengths = np.diff(first)
    begin = np.flatnonzero(np.arange(n) + window <= first[1:][doc]) if n else np.zeros(0, np.int64)
    empty = np.zeros(0, np.int64)
    if not len(begin) or not len(lengths):
        return empty, empty, empty, empty
    low = np.searchsorted(starts, begin + CONTEXT)
    high = np.searchsorted(ends, begin + window - CONTEXT, side="right")
    has = low < high
    # smallest name among symbols low to high, by a table of minima over powers of two
    keys = names
    level, table = 0, [np.arange(len(keys))]
    widest = int((high - low).max(initial=1))
    while 2 << level <= widest:
        half, at = 1 << level, table[-1]
        a, b = at[: len(at) - half], at[half:]
        table.append(np.where(keys[b] < keys[a], b, a))
        level += 1
    chosen = np.full(len(begin), -1)
    span = np.where(has, high - low, 1)
    powers = np.floor(np.log2(span)).astype(np.int64)
    for p in range(level + 1):
        rows = np.flatnonzero(has & (powers == p))
        a, b = table[p][low[rows]], table[p][high[rows] - (1 << p)]
        chosen[rows] = np.where(keys[b] < keys[a], b, a)
    new = np.r_[True, (np.diff(chosen) != 0) | (np.diff(begin) != 1) | (np.diff(doc[begin]) != 0)]
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(begin)] - 1
    symbol = chosen[at]
    none = symbol < 0
    return np.where(none, -1, starts[symbol]), np.where(none, -1, ends[symbol]), begin[at], begin[last]
