"""An open-addressing table from 64-bit keys to small integers, looked up for whole arrays at once."""

from __future__ import annotations

import numpy as np

U = np.uint64


class HashTable:
    """Holds up to half of 2**bits keys; add() empties the table first when they would not fit (bounded memory)."""

    def __init__(self, bits: int = 21):
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, U)
        self.vals = np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none. Key 0 counts as key 1."""
        keys = np.where(keys == 0, U(1), keys)
        out = np.full(len(keys), -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            at = self.keys[slot]
            hit = at == keys[left]
            out[left[hit]] = self.vals[slot[hit]]
            go = ~hit & (at != 0)
            left, slot = left[go], (slot[go] + 1) & (len(self.keys) - 1)
        return out

    def room(self, n: int) -> bool:
        return 2 * (self.n + n) <= len(self.keys)

    def clear(self) -> None:
        self.keys[:] = 0
        self.n = 0

    def add(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Store distinct keys that are not there yet."""
        keys = np.where(keys == 0, U(1), keys)
        vals = np.asarray(vals, np.int32)
        slot = self._slot(keys)
        self.n += len(keys)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            done = self.keys[slot] == keys
            self.vals[slot[done]] = vals[done]
            keys, vals, slot = keys[~done], vals[~done], (slot[~done] + 1) & (len(self.keys) - 1)
