"""Vectorised word and shingle hashing over many texts at once (numpy, no loop over words).

A word is a run of bytes other than space and \\t\\n\\v\\f\\r. A word's hash is multilinear: the sum of its bytes, each times
a 64-bit constant of its place, then mixed. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text handled at a time; temporary arrays take about 60 times as much at most. An executor has a worker for each of its cores beside a heap that
#: fills up over the pipeline's stages, and workers keep what they once took; smaller groups take no more time.
GROUP = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def series(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd 64-bit constants by rule."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed << 32)) * U(0x9E3779B97F4A7C15)) | U(1)


_PLACES = series(1024, 7)


def groups(sizes: Sequence[int], limit: int = GROUP) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items of about limit bytes each, at least one item to a range."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


class Words:
    """The words of some texts (UTF-8 bytes): starts and ends in buf, first[d] the number of text d's first word.

    space_bytes: which bytes stand between words; the newline must be one of them.
    """

    def __init__(self, texts: Sequence[bytes], space_bytes: np.ndarray = SPACE):
        self.buf = b"\n".join(texts) + b"\n" if texts else b""
        data = np.frombuffer(self.buf, np.uint8)
        space = space_bytes[data]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.starts, self.ends = edge[::2], edge[1::2]
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.first)
        self._data, self._space = data, space

    def hashes(self) -> np.ndarray:
        lens = self.ends - self.starts
        if not len(lens):
            return np.zeros(0, U)
        chars = self._data[~self._space].astype(U)
        begin = np.cumsum(lens) - lens
        place = np.arange(len(chars)) - np.repeat(begin, lens)
        longest = int(lens.max())
        places = _PLACES if longest <= len(_PLACES) else series(longest, 7)
        with np.errstate(over="ignore"):
            total = np.add.reduceat((chars + U(1)) * places[place], begin)
            return mix(total + lens.astype(U) * U(0xD6E8FEB86659FD93))


_STEP = series(64, 11)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i:i+k] for each i: multilinear over word hashes, then mixed."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        total = np.full(n, U(k) * U(0xA0761D6478BD642F), U)
        for j in range(k):
            total += words[j : j + n] * _STEP[j]
        return mix(total)


def shingle_sets(texts: Sequence[bytes], k: int = 5) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes of its k-word shingles; a text with fewer words has one, of all its words."""
    w = Words(texts)
    h = w.hashes()
    full = window_hashes(h, k)
    for a, n in zip(w.first[:-1].tolist(), w.counts.tolist(), strict=True):
        if n >= k:
            yield np.unique(full[a : a + n - k + 1])
        elif n:
            yield window_hashes(h[a : a + n], n)
        else:
            yield np.zeros(0, U)
