"""A minimal perfect hash of distinct 64-bit keys, in numpy: n keys get the numbers 0 to n - 1, with some four bits a key.

Keys go into a bit table somewhat larger than they are many; those alone in their slot are placed there, the others go on to a next,
smaller table. A key's number is that of its slot's bit among all bits set. What isn't a key may get any number (or none, -1), so a
caller compares the key that it keeps under the number.
"""

from __future__ import annotations

import struct

import numpy as np

from .shingles import mix

U = np.uint64
#: Slots for each key that is still unplaced.
ROOM = 1.5


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + U(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) % U(size)).astype(np.int64)


def build(keys: np.ndarray) -> bytes:
    """The hash of distinct keys; an error for repeated ones, which no table can tell apart."""
    keys, parts, level = keys.astype(U), [], 0
    while len(keys):
        if level == 200:
            raise ValueError("keys aren't distinct")
        size = -(-max(64, int(ROOM * len(keys))) // 64) * 64
        at = _slot(keys, level, size)
        alone = np.bincount(at, minlength=size) == 1
        parts.append(np.packbits(alone, bitorder="little").tobytes())
        keys, level = keys[~alone[at]], level + 1
    return struct.pack("<I", len(parts)) + b"".join(struct.pack("<Q", len(p)) for p in parts) + b"".join(parts)


class Hash:
    """A hash read back from what `build` made."""

    def __init__(self, made: bytes):
        (n,) = struct.unpack_from("<I", made)
        at, self.levels, before = 4 + 8 * n, [], 0
        for size in struct.unpack_from(f"<{n}Q", made, 4):
            bits = np.frombuffer(made, "<u8", size // 8, at)
            ones = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
            rank = np.concatenate([[0], ones[:-1]]) + before
            self.levels.append((bits, rank))
            at, before = at + size, before + int(ones[-1])
        self.size = before

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key."""
        keys = keys.astype(U)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(self.levels):
            if not len(left):
                break
            slot = _slot(keys[left], level, 64 * len(bits))
            word, bit = slot >> 6, (slot & 63).astype(U)
            held = bits[word]
            hit = (held >> bit) & U(1) == 1
            below = np.bitwise_count(held & ((U(1) << bit) - U(1)))
            out[left[hit]] = (rank[word] + below)[hit]
            left = left[~hit]
        return out
