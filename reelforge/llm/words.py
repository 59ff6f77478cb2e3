"""Words and shingles of a text as 64-bit hashes, made by array operations over its code points.

A word is a run of letters, digits or underscores of the lower-cased text. Equal words have equal hashes on every
machine. Texts are read in windows cut between words, so memory is bounded; only a single word longer than a window is
cut. Null and empty texts have no words.
"""

from __future__ import annotations

from functools import cache

import numpy as np

WINDOW = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def word_chars() -> np.ndarray:
    return np.fromiter((c == 95 or chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    up, down = np.full(WINDOW + 1, _BASE, _U), np.full(WINDOW + 1, pow(_BASE, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


def windows(text: str):
    """The text in parts of at most WINDOW code points, cut after a character that is in no word where there is one."""
    at, n, table = 0, len(text), word_chars()
    while at < n:
        end = min(at + WINDOW, n)
        if end < n:
            cut = end
            while cut > at and table[ord(text[cut - 1])]:
                cut -= 1
            end = cut if cut > at else end
        yield text[at:end]
        at = end


def runs_hashed(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of codes[start:end] for each run; codes has at most WINDOW entries."""
    up, down = _powers()
    sums = np.empty(len(codes) + 1, _U)
    sums[0] = 0
    np.cumsum((codes.astype(_U) + _U(1)) * up[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def codes_of(part: str) -> np.ndarray:
    return np.frombuffer(part.encode("utf-32-le"), "<u4")


def word_hashes(text: str | None) -> np.ndarray:
    out = []
    for part in windows(text or ""):
        part = part.lower()
        for at in range(0, len(part), WINDOW):  # lower() may lengthen a text
            codes = codes_of(part[at : at + WINDOW])
            edge = np.diff(word_chars()[codes].astype(np.int8), prepend=0, append=0)
            out.append(runs_hashed(codes, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))
    return np.concatenate(out) if out else np.empty(0, _U)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of size words; a text of fewer words has one shingle of all of them, one of none has none."""
    n = len(words) - size + 1
    if n < 1:
        return mix((words * _powers()[0][1 : len(words) + 1]).sum(dtype=_U, keepdims=True) + _U(len(words))) if len(words) else words
    h = np.zeros(n, _U)
    for i in range(size):
        h += words[i : i + n] * _powers()[0][i + 1]
    return mix(h)


def sequence_key(words: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit values that stand for the whole sequence of words."""
    def one(base: int) -> int:
        h = 0
        for at in range(0, len(words), WINDOW):
            part = words[at : at + WINDOW]
            h = (h * base + int((mix(part ^ _U(base)) * _powers()[0][: len(part)]).sum(dtype=_U))) % (1 << 64)
        return h - (1 << 64) if h >> 63 else h

    return one(0xD6E8FEB86659FD93), one(0xA5CB9243F0AEF0B5)
