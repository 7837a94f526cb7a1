"""Minimal perfect hashing of distinct 64-bit keys.

Level after level, every key left over is hashed into a bit array of ``SPARSITY`` bits a
key; keys that are alone at their bit take it, the others go to the next level. A key's
slot is the rank of its bit, so n keys have the slots 0 to n - 1. About three bits a key
are stored. A key that was not hashed gets any slot or none: callers keep the keys in slot
order and compare.
"""

from __future__ import annotations

import struct

import numpy as np

from .text import mix

SPARSITY = 2
MAX_LEVELS = 64
_SEED = 500


class MinimalHash:
    def __init__(self, levels: list[np.ndarray]):
        """levels: the 64-bit words of each level's bit array."""
        self._words = levels
        self._before, at = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self._before.append(at + np.cumsum(ones) - ones)
            at += int(ones.sum())
        self.size = at

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalHash:
        """``keys`` are distinct uint64."""
        rest, levels = keys, []
        while len(rest):
            if len(levels) == MAX_LEVELS:
                raise ValueError("keys are not distinct")
            bits = 64 * -(-SPARSITY * len(rest) // 64)
            at = mix(rest, _SEED + len(levels)) % np.uint64(bits)
            alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = rest[~alone[at.astype(np.int64)]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some of the keys that were not hashed."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (words, before) in enumerate(zip(self._words, self._before, strict=True)):
            if not len(left):
                break
            at = mix(keys[left], _SEED + k) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            found = words[word]
            hit = (found >> bit) & np.uint64(1) == 1
            below = found & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (before[word] + np.bitwise_count(below))[hit]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = struct.pack(f"<I{len(self._words)}Q", len(self._words), *map(len, self._words))
        return sizes + b"".join(w.astype("<u8").tobytes() for w in self._words)

    @classmethod
    def from_bytes(cls, raw: bytes) -> MinimalHash:
        (n,) = struct.unpack_from("<I", raw)
        sizes = struct.unpack_from(f"<{n}Q", raw, 4)
        at, levels = 4 + 8 * n, []
        for size in sizes:
            levels.append(np.frombuffer(raw, "<u8", size, at))
            at += 8 * size
        return cls(levels)
