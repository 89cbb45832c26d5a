"""A fixed map from non-negative longs to longs with vectorised look-up."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


class IntMap:
    """Open addressing with linear probing, filled once, half empty or more."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, missing, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys.astype(np.int64))
        while len(todo):
            free = self.keys[slot] < 0
            first = np.zeros(len(slot), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = keys[todo[put]], values[todo[put]]
            todo, slot = todo[~put], slot[~put]
            # a key whose place was free but went to another of this round tries it again and finds it taken
            slot = np.where(self.keys[slot] >= 0, (slot + 1) & self.last, slot)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        at = self.keys[slot]
        out = self.values[slot]
        open_ = np.flatnonzero((at != keys) & (at >= 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.last
            at = self.keys[slot]
            out[open_] = self.values[slot]
            go = (at != keys[open_]) & (at >= 0)
            open_, slot = open_[go], slot[go]
        return out
