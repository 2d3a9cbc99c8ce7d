"""A table from 64-bit keys to entry numbers that looks up whole arrays at once."""

from __future__ import annotations

import numpy as np

SPREAD = np.uint64(0x9E3779B97F4A7C15)
AT_ONCE = 1 << 16


class HashTable:
    """Open addressing with linear probing; entries are numbered in order of insertion.

    ``room`` is the most entries it can hold; the arrays have at least twice as many slots.
    """

    def __init__(self, room: int):
        bits = max(2 * room - 1, 1).bit_length()
        self.room, self.shift, self.mask = room, np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.entries = np.full(1 << bits, -1, np.int32)
        self.size = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * SPREAD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 for keys not in the table."""
        out = np.empty(len(keys), np.int32)
        for k in range(0, len(keys), AT_ONCE):
            self._find(keys[k:k + AT_ONCE], out[k:k + AT_ONCE])
        return out

    def _find(self, keys: np.ndarray, out: np.ndarray) -> None:
        slots = self._slots(keys)
        entries = self.entries[slots]
        out[:] = entries
        open_ = np.flatnonzero((self.keys[slots] != keys) & (entries >= 0))
        slots = slots[open_]
        while len(open_):
            slots = (slots + 1) & self.mask
            entries = self.entries[slots]
            out[open_] = entries
            on = (self.keys[slots] != keys[open_]) & (entries >= 0)
            open_, slots = open_[on], slots[on]

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of new entries for distinct keys that are not in the table."""
        if self.size + len(keys) > self.room:
            raise ValueError("the table is full")
        numbers = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        slots, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            free = self.entries[slots[todo]] < 0
            _, first = np.unique(slots[todo][free], return_index=True)
            own = todo[free][first]
            self.keys[slots[own]] = keys[own]
            self.entries[slots[own]] = numbers[own]
            placed = np.zeros(len(keys), bool)
            placed[own] = True
            todo = todo[~placed[todo]]
            slots[todo] = (slots[todo] + 1) & self.mask
        self.size += len(keys)
        return numbers
