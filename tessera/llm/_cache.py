"""Token ids of text slices, encoded once per worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tessera.llm import _bytes as B

#: Slices a worker remembers; beyond it starts anew, which costs time only.
ENTRIES = 500_000
#: Bytes of slices, and ids, that it remembers.
HELD = 1 << 25


class SliceCache:
    """Remembers the ids of slices. ``encode`` turns a list of byte strings into lists of ids.

    Slices of a batch are grouped by hash and compared with their group's first,
    byte for byte; what is remembered is found by the bytes themselves. So two
    different slices never share ids.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], entries: int = ENTRIES) -> None:
        self.encode, self.entries = encode, entries
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = self.held = 0

    def _store(self, keys: list[bytes], found: list[list[int]]) -> None:
        lengths = [len(x) for x in found]
        need = self.used + sum(lengths)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, 2 * len(self.flat)) - len(self.flat), np.uint32)])
        self.flat[self.used : need] = np.fromiter((i for x in found for i in x), np.uint32, need - self.used)
        at = self.used
        for k, n in zip(keys, lengths, strict=True):
            self.place[k] = (at << 31) | n
            self.held += len(k)
            at += n
        self.used = need

    def __call__(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all slices, end to end, and how many each slice has."""
        if len(self.place) > self.entries or self.held > HELD or self.used > HELD:
            self.clear()
        _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        size = ends - starts
        other = np.flatnonzero((size != size[first[back]]) | ~B.same_slices(data, starts, starts[first[back]], np.minimum(size, size[first[back]])))
        back[other] = len(first) + np.arange(len(other))  # a shared hash of different slices: each stands for itself
        first = np.concatenate([first, other])
        raw = data.tobytes()
        keys = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        new = list(dict.fromkeys(k for k in keys if k not in self.place))
        if new:
            self._store(new, self.encode(new))
        packed = np.fromiter((self.place[k] for k in keys), np.int64, len(keys))[back]
        at, n = packed >> 31, packed & 0x7FFFFFFF
        return gather(self.flat, at, n), n


def gather(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The slices ``flat[at : at + n]`` end to end."""
    total = int(n.sum())
    if not total:
        return flat[:0]
    steps = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    return flat[np.repeat(at, n) + steps]
