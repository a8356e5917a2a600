"""Hashes of the words of many texts at once, with numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

BATCH_BYTES = 4 << 20
_LONG_WORD = 1 << 16
_U = np.uint64

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


# One random number per byte, and odd factors per place in a word.
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_PLACE = mix(np.arange(1001, 1001 + _LONG_WORD, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_LOWER = _BYTE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]


class Scan:
    """Words of a list of texts: hash, place in its text in bytes, and each text's range of words."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        self.bytes = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.begin = np.concatenate([[0], np.cumsum(sizes)])  # of each text in the joined bytes
        blank = _BLANK[self.bytes]
        edge = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=1))
        self.start, self.stop = edge[0::2], edge[1::2]  # of each word
        self.first = np.searchsorted(self.start, self.begin)  # word of each text, and one past the last
        self.hash = self._hash(joined, _LOWER if lower else _BYTE)

    def _hash(self, joined: bytes, table: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.start), _U)
        at = 0
        while at < len(out):  # in blocks, so that a very long text needs no more than its bytes
            to = max(at + 1, int(np.searchsorted(self.start, self.start[at] + BATCH_BYTES)))
            start, stop = self.start[at:to], self.stop[at:to]
            sizes = stop - start
            kept = np.minimum(sizes, _LONG_WORD)
            offsets = np.cumsum(kept) - kept
            inner = np.arange(int(kept.sum())) - np.repeat(offsets, kept)
            values = table[self.bytes[np.repeat(start, kept) + inner]] * _PLACE[inner]
            out[at:to] = mix(np.add.reduceat(values, offsets) + sizes.astype(_U))
            for i in np.flatnonzero(sizes > _LONG_WORD):
                word = joined[start[i] : stop[i]]
                word = word.translate(_LOWERED) if table is _LOWER else word
                out[at + i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            at = to
        return out

    def words_of(self, i: int) -> np.ndarray:
        return self.hash[self.first[i] : self.first[i + 1]]


_LOWERED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if n == 0:
        return words
    size = min(n, k)
    total = np.full(n - size + 1, size, _U)
    for j in range(size):
        total += mix(words[j : n - size + 1 + j] + _PLACE[j]) * _PLACE[k + j]
    return mix(total)


def in_batches(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of bounded size together, each with the index of its first; a long one goes alone."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= BATCH_BYTES):
            size += len(texts[to])
            to += 1
        yield at, texts[at:to]
        at = to
