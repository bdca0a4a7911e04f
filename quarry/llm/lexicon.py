"""A minimal acyclic transducer from words to token ids, kept as flat arrays that are memory-mapped where they are used.

States are merged by their right language while the sorted words come in, so that suffixes are shared. An arc knows how many
words come before it among its state's words: their sum along a path is the word's number, and the number gives the ids.
"""

from __future__ import annotations

import json
import mmap
import tempfile
from collections.abc import Sequence

import numpy as np


class _State:
    __slots__ = ("arcs", "final", "number", "size")

    def __init__(self):
        self.arcs: dict[int, _State] = {}
        self.final = False
        self.number = self.size = -1

    def signature(self):
        return self.final, tuple((b, t.number) for b, t in self.arcs.items())


def compile_words(entries: Sequence[tuple[bytes, Sequence[int]]]) -> bytes:
    """The transducer of (word, ids) pairs; words must differ. Bytes: a JSON line with the arrays' types and sizes, then the arrays."""
    entries = sorted((bytes(w), list(ids)) for w, ids in entries)
    register: dict = {}
    states: list[_State] = []

    def settle(path: list[_State], depth: int, word: bytes) -> None:
        for d in range(len(path) - 1, depth, -1):
            s = path[d]
            twin = register.get(key := s.signature())
            if twin is None:
                s.number, s.size = len(states), s.final + sum(t.size for t in s.arcs.values())
                register[key] = twin = s
                states.append(s)
            path[d - 1].arcs[word[d - 1]] = twin
            path.pop()

    path, last = [_State()], b""
    for word, _ in entries:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        settle(path, same, last)
        for b in word[same:]:
            path[-1].arcs[b] = s = _State()
            path.append(s)
        path[-1].final = True
        last = word
    settle(path, 0, last)
    root = path[0]
    root.number = len(states)
    states.append(root)
    keys, targets, skips = [], [], []
    for s in states:
        before = int(s.final)
        for b, t in sorted(s.arcs.items()):
            keys.append(s.number << 8 | b), targets.append(t.number), skips.append(before)
            before += t.size
    arrays = {
        "keys": np.array(keys, np.int64),
        "targets": np.array(targets, np.int32),
        "skips": np.array(skips, np.int32),
        "final": np.array([s.final for s in states], np.uint8),
        "ids": np.array([i for _, ids in entries for i in ids], np.int32),
        "ends": np.cumsum([0, *(len(ids) for _, ids in entries)]).astype(np.int64),
    }
    head = json.dumps({k: [str(a.dtype), len(a)] for k, a in arrays.items()}).encode() + b"\n"
    return head + b"".join(a.tobytes() for a in arrays.values())


class Lexicon:
    """The compiled words, mapped from a file that has no name and goes with the process."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at = self._map.find(b"\n") + 1
        for name, (kind, n) in json.loads(self._map[: at - 1]).items():
            setattr(self, name, np.frombuffer(self._map, kind, n, at))
            at += np.dtype(kind).itemsize * n
        self.root = len(self.final) - 1

    def find(self, words: Sequence[bytes]) -> np.ndarray:
        """The number of each word, -1 if it is not in the lexicon; all words step through the automaton together."""
        n = np.array([len(w) for w in words])
        out = np.full(len(words), -1, np.int64)
        if not len(words) or not len(self.keys):
            return out
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(n) - n
        on, state, number = np.arange(len(words)), np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(on):
            done = n[on] == step
            ends = done & (self.final[state] == 1)
            out[on[ends]] = number[ends]
            on, state, number = on[~done], state[~done], number[~done]
            if not len(on):
                break
            key = state << 8 | data[begin[on] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            on, arc, number = on[ok], arc[ok], number[ok]
            state, number = self.targets[arc].astype(np.int64), number + self.skips[arc]
            step += 1
        return out
