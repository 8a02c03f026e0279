"""Majority-bit fingerprints and their search by Hamming distance, as op6 and the pipeline's near-copy stage share them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def majority_bits(found: np.ndarray) -> bytes:
    """64 bits, the highest first: each is 1 if it is set in over half of the hashes `found` (unsigned 64-bit)."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(found), 1 << 16):  # a few MB at once for very long texts
        some = found[i : i + (1 << 16)].astype(">u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(found)).tobytes()


class BKTree:
    """A BK-tree over distinct fingerprints (as unsigned Python integers): children are keyed by their Hamming distance
    to the parent."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def near(self, value: int, radius: int = 3) -> Iterator[int]:
        todo = [self.root] if self.root else []
        while todo:
            own, children = todo.pop()
            d = (own ^ value).bit_count()
            if d <= radius:
                yield own
            for edge, child in children.items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)


class Groups:
    """Which of some values are joined so far."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they weren't joined yet."""
        a, b = self.find(x), self.find(y)
        self.parent[a] = b
        return a != b
