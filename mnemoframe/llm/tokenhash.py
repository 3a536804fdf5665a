"""Vectorised word splitting and rolling hashes over batches of texts.

A batch of texts is laid out as one array of code points; words are found with
array operations and every hash is a difference of prefix sums of a polynomial
modulo 2**64 (Rabin-Karp), so no Python loop runs over words or characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

CHUNK_CHARS = 1_000_000
_CHAR_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_WORD_BASE = 0xC2B2AE3D27D4EB4F


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of a base and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            step = np.full(size, self.base, np.uint64)
            step[0] = 1
            back = np.full(size, self.inverse, np.uint64)
            back[0] = 1
            self.up, self.down = np.cumprod(step, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_CHARS, _WORDS = _Powers(_CHAR_BASE), _Powers(_WORD_BASE)


@lru_cache(maxsize=1)
def _alnum_table() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1)
def _blank_table() -> np.ndarray:
    table = np.ones(0x110000, bool)
    table[[9, 10, 13, 32]] = False
    return table


def _prepare(text: str, mode: str) -> str:
    if mode == "nfkc":
        return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()
    return text.lower() if mode == "lower" else text


@dataclass
class Words:
    """Words of a run of texts: ``hashes`` of all words, ``bounds[i]:bounds[i+1]`` those of text i."""

    first: int
    hashes: np.ndarray
    bounds: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(texts: Sequence[str | None], mode: str) -> Iterator[Words]:
    """Hash the words of ``texts``, in chunks of about ``CHUNK_CHARS`` code points.

    ``mode``: ``blank`` splits at space, tab, CR and LF only and compares
    exactly; ``lower`` takes maximal runs of letters and digits of the
    lower-cased text; ``nfkc`` the same after NFKC. A null text has no words.
    """
    table = _blank_table() if mode == "blank" else _alnum_table()
    start, part, size = 0, [], 0
    for i, text in enumerate(texts):
        text = _prepare(text or "", mode)
        part.append(text)
        size += len(text) + 1
        if size >= CHUNK_CHARS:
            yield _chunk(start, part, table)
            start, part, size = i + 1, [], 0
    if part:
        yield _chunk(start, part, table)


def _chunk(first: int, part: list[str], table: np.ndarray) -> Words:
    code = np.frombuffer(("\n".join(part) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_word = table[code]
    edge = np.flatnonzero(np.diff(is_word, prepend=False))
    begin, end = edge[0::2], edge[1::2]
    up, down = _CHARS.get(len(code))
    prefix = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up, out=prefix[1:])
    hashes = mix((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(np.uint64))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in part), np.int64, len(part)))
    return Words(first, hashes, np.concatenate(([0], np.searchsorted(begin, ends))))


def windows(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Rabin-Karp hash of every run of ``size`` consecutive words (ignoring text bounds)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = mix(hashes + np.uint64(salt)) if salt else hashes
    up, down = _WORDS.get(len(h))
    prefix = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up, out=prefix[1:])
    return mix((prefix[size:] - prefix[:-size]) * down[:n])


def inside(batch: Words, size: int) -> np.ndarray:
    """Starts of the windows of ``size`` words that lie inside one text."""
    owner = batch.owner()
    if len(owner) < size:
        return np.empty(0, np.int64)
    return np.flatnonzero(owner[: len(owner) - size + 1] == owner[size - 1 :])
