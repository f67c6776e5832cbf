"""Words, their hashes and simple counts of one text, in numpy."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(64, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE to the power of 0 to n-1, modulo 2 to the 64."""
    global _powers
    if n > _powers.size:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n, 2 * _powers.size), BASE, np.uint64))), dtype=np.uint64)
    return _powers[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes of a text; white space is ASCII's."""
    edge = np.diff(np.concatenate(([0], (~SPACE[data]).astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word."""
    if not starts.size:
        return np.empty(0, np.uint64)
    sizes = ends - starts
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    value = BYTE[data[place + np.repeat(starts, sizes)]] * powers(int(sizes.max()))[place]
    return mixed(np.add.reduceat(value, first))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """64 bits for each run of n words."""
    if h.size < n:
        return np.empty(0, np.uint64)
    out = np.zeros(h.size - n + 1, np.uint64)
    for i in range(n):
        out = out * BASE + h[i : h.size - n + 1 + i]
    return mixed(out)


def repeated_words(h: np.ndarray, n: int = 5) -> int:
    """Words that lie in a run of n words which the text has twice or more, its first occurrence included."""
    g = grams(h, n)
    if not g.size:
        return 0
    _, back, many = np.unique(g, return_inverse=True, return_counts=True)
    again = many[back] > 1
    if not again.any():
        return 0
    at = np.flatnonzero(again)
    cover = np.zeros(h.size + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + n, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))
