"""Vectorised text primitives shared by the corpus operators (numpy over Arrow buffers).

Texts arrive as Arrow string columns; these helpers work on the UTF-8 buffer of
a whole batch at once, so no Python object is made per word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: The bytes that end a word: x20 and x09 to x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Slices longer than this are hashed one by one; there are few.
LONG = 4096
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and n + 1 offsets into them (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    kind = np.int64 if wide else np.int32
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def octets(data: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from there on as one number (zeros beyond the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))


def slices_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each slice of ``data``; slices may overlap.

    Eight bytes at a time are added to a state that is mixed after each step, so
    unlike a polynomial modulo 2**64 no text makes it collide by its structure.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1)))
    words = octets(data)
    usual = np.flatnonzero(size <= LONG)
    for step in range(int(size[usual].max(initial=0)) // 8):
        usual = usual[size[usual] >= 8 * step + 8]
        out[usual] = mix(out[usual] * np.uint64(0xD1342543DE82EF95) + words[starts[usual] + 8 * step])
    rest = size & 7
    tail = np.flatnonzero((size <= LONG) & (rest > 0))
    rest = rest[tail]
    out[tail] = mix(out[tail] * np.uint64(0xD1342543DE82EF95) + (words[ends[tail] - rest] & _KEEP[rest]))
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=seed.to_bytes(8, "little"))
        out[i] = int.from_bytes(digest.digest(), "little")
    return out


def same_slices(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which slices of the given sizes, at places ``a`` and at ``b``, are equal byte for byte."""
    out = np.ones(len(size), bool)
    words = octets(data)
    at = np.flatnonzero((size <= LONG) & (a != b))
    for step in range(int(size[at].max(initial=0)) // 8):
        at = at[size[at] >= 8 * step + 8]
        out[at] &= words[a[at] + 8 * step] == words[b[at] + 8 * step]
    rest = size & 7
    at = np.flatnonzero((size <= LONG) & (rest > 0) & (a != b))
    whole, rest = size[at] - rest[at], rest[at]
    out[at] &= ((words[a[at] + whole] ^ words[b[at] + whole]) & _KEEP[rest]) == 0
    for i in np.flatnonzero((size > LONG) & (a != b)).tolist():
        out[i] = np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]])
    return out


def words(data: np.ndarray, offsets: np.ndarray, wordless: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every text, and for each text the index of its first word (n + 1 of them)."""
    inside = ~wordless[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(data):
        before[0] = after[-1] = False
    full = offsets[:-1][np.diff(offsets) > 0]
    before[full] = False
    after[full[1:] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the k-word shingles of one text; of fewer words, one of the whole sequence; of none, none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, k)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0xA24BAED4963EE407) + hashes[i : n - width + 1 + i])
    return np.unique(out)
