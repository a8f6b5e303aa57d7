"""A hash table of a transducer's transitions in flat arrays."""

from __future__ import annotations

import numpy as np


class PairTable:
    """Transitions (state, block) -> value in an open-addressing table, looked up and added to in whole arrays."""

    def __init__(self, bits: int = 16) -> None:
        self._alloc(bits)

    def _alloc(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.key_state = np.full(1 << bits, -1, np.int64)
        self.key_block = np.zeros(1 << bits, np.uint64)
        self.value = np.zeros(1 << bits, np.int32)

    def _slot(self, state: np.ndarray, block: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (block ^ (state.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, state: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Values of the transitions, -1 where there is none yet."""
        slot = self._slot(state, block)
        seen = self.key_state.take(slot)
        hit = (seen == state) & (self.key_block.take(slot) == block)
        out = np.where(hit, self.value.take(slot), np.int32(-1))
        todo = np.flatnonzero(~hit & (seen != -1))
        mask = (1 << self.bits) - 1
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            at = slot[todo]
            seen = self.key_state[at]
            hit = (seen == state[todo]) & (self.key_block[at] == block[todo])
            out[todo[hit]] = self.value[at[hit]]
            todo = todo[~hit & (seen != -1)]
        return out

    def add(self, state: np.ndarray, block: np.ndarray, value: np.ndarray) -> None:
        """Insert transitions that are distinct and not there yet."""
        if 2 * (self.used + len(state)) > (1 << self.bits):
            old = np.flatnonzero(self.key_state >= 0)
            a, b, c = self.key_state[old], self.key_block[old], self.value[old]
            bits = self.bits
            while 2 * (len(old) + len(state)) > (1 << bits):
                bits += 1
            self._alloc(bits)
            self.add(a, b, c)
        mask, todo = (1 << self.bits) - 1, np.arange(len(state))
        slot = self._slot(state, block)
        while len(todo):
            at = slot[todo]
            free = self.key_state[at] == -1
            self.value[at[free]] = -1 - todo[free]  # of those that meet in a slot, the last stays
            won = free & (self.value[at] == -1 - todo)
            w, place = todo[won], at[won]
            self.key_state[place], self.key_block[place], self.value[place] = state[w], block[w], value[w]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & mask
        self.used += len(state)
