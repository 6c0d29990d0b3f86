"""Hashes of words, and of runs of words, as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Words remembered by one task; beyond that the memory starts anew
WORDS_KEPT = 200_000


class WordHashes(dict):
    """Word -> 64-bit hash, the same in every process."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: str | bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(hashes: np.ndarray, length: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """The hash of every `length` consecutive words; none if there are fewer."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, f = hashes[:n].copy(), np.uint64(factor | 1)
    for i in range(1, length):
        out *= f
        out += hashes[i : i + n]
    return mixed(out)


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True
_BASE = 0x9E3779B97F4A7C15
#: Bytes hashed at a time
_PIECE = 1 << 15


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_PIECE - 1, base, np.uint64)]))


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _hash_piece(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _SPACE[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, stop = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _UP[: len(data)], out=sums[1:])
    return mixed((sums[stop] - sums[start]) * _DOWN[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start


def _pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """The text in pieces that end at white space; a word longer than a piece is one by itself."""
    at = 0
    while len(text) - at > _PIECE:
        cut = next((i for i in range(at + _PIECE, at, -1) if _SPACE[text[i]]), None)
        if cut is None:
            cut = next((i for i in range(at + _PIECE, len(text)) if _SPACE[text[i]]), len(text))
        yield at, text[at:cut]
        at = cut
    yield at, text[at:]


def _hash_long(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A piece with one word that is too long to be summed."""
    (word,) = text.split()
    return np.array([xxhash.xxh3_64_intdigest(word)], np.uint64), np.array([text.index(word)])


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words, the runs of anything but ASCII white space, as `bytes.split` cuts them.

    All words of many texts at once: sums over the bytes, of which each word takes the difference at its ends.
    """
    joined = b"\n".join(texts)
    found = [(at, *(_hash_long(p) if len(p) > _PIECE else _hash_piece(p))) for at, p in _pieces(joined)]
    hashes = np.concatenate([h for _, h, _ in found])
    starts = np.concatenate([s + at for at, _, s in found])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.split(hashes, np.searchsorted(starts, ends[:-1])) if texts else []
