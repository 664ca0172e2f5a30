"""Byte-level BPE: encoding and decoding, pre-tokenised without a regex engine.

Pre-tokenisation. Each code point gets a class (letter, number, other, white
space kinds, apostrophe before a contraction). A class is a function from the
state before a character to the state after it. These functions compose
associatively, so states before all characters of a batch come from a blocked
scan over composition tables, and a boundary is where state and class say so.
Documents of a batch are scanned together: a first character's function forgets
the state.

Merging. Equal slices of a batch are merged once, and a worker remembers them.
Long slices are merged by a heap over linked parts, in n log n steps.

Offsets. The end of each token in the text's bytes is kept beside its id, so a
span of tokens decodes and aligns without decoding the rest.

Nulls, ties, repeats: a null or empty text has no tokens. Rows come back one for
one, with their id as it is (null too). Extra columns are ignored; an empty table
gives an empty result. A text of any length is one row; it is looked at in
stretches of about ``SPAN`` bytes that begin where a token must (a space before a
character that is none), so only a single word can make a stretch longer.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import _bytes as B
from tessera.llm._cache import SliceCache, gather
from tessera.llm._tables import small_batches

# Classes of characters.
_LETTER, _NUMBER, _OTHER, _ONE, _TWO, _GAP, _JOIN, _BREAK = range(8)
# States: what the token so far is.
_FRESH, _IN_LETTERS, _IN_NUMBERS, _IN_OTHERS, _JOINED, _IN_GAP, _LAST, _LAST_TWO = range(8)


def _after(state: int, kind: int) -> int:
    if kind == _LETTER:
        return {_LAST: _FRESH, _LAST_TWO: _LAST}.get(state, _IN_LETTERS)
    if kind in (_ONE, _TWO):
        return _IN_OTHERS if state in (_IN_OTHERS, _JOINED) else _LAST if kind == _ONE else _LAST_TWO
    return {_NUMBER: _IN_NUMBERS, _OTHER: _IN_OTHERS, _GAP: _IN_GAP, _JOIN: _JOINED, _BREAK: _FRESH}[kind]


def _begins(state: int, kind: int) -> bool:
    goes_on = {_LETTER: (_IN_LETTERS, _JOINED, _LAST, _LAST_TWO), _NUMBER: (_IN_NUMBERS, _JOINED), _OTHER: (_IN_OTHERS, _JOINED), _ONE: (_IN_OTHERS, _JOINED), _TWO: (_IN_OTHERS, _JOINED), _GAP: (_IN_GAP,)}
    return state not in goes_on.get(kind, ())


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the classes' functions, of their first-character forms, the composition table, and every function's value by state."""
    own = [tuple(_after(s, k) for s in range(8)) for k in range(8)]
    forget = [(_after(_FRESH, k),) * 8 for k in range(8)]
    known = {f: i for i, f in enumerate(dict.fromkeys([*own, *forget]))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in own + forget:
            for h in (tuple(g[x] for x in f), tuple(f[x] for x in g)):
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
    every = list(known)
    table = np.array([[known[tuple(g[x] for x in f)] for g in every] for f in every], np.int16)
    return np.array([known[f] for f in own]), np.array([known[f] for f in forget]), table, np.array(every, np.uint8).T


def _scan(functions: np.ndarray, table: np.ndarray, width: int = 64) -> np.ndarray:
    """Inclusive scan of compositions: within blocks, then over the blocks' totals."""
    n = len(functions)
    if n <= width:
        out = functions.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], functions[i]]
        return out
    full = n // width
    blocks = np.ascontiguousarray(functions[: full * width].reshape(full, width).T)
    for i in range(1, width):
        blocks[i] = table[blocks[i - 1], blocks[i]]
    before = _scan(blocks[-1].copy(), table, width)
    blocks[:, 1:] = table[before[None, :-1], blocks[:, 1:]]
    out = np.empty(n, functions.dtype)
    out[: full * width] = blocks.T.ravel()
    last = before[-1]
    for i in range(full * width, n):
        last = out[i] = table[last, functions[i]]
    return out


@cache
def _code_points() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 space, 4 other white space, by code point."""
    kinds = {"L": 0, "N": 1}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], 2) for c in range(0x110000)], np.uint8)
    white = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[white] = 4
    out[0x20] = 3
    return out


#: Code points scanned together; the state goes on from one stretch to the next.
STRETCH = 1 << 18


def _classes(points: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Classes of the first n code points, of which up to two more follow for looking ahead."""
    kind = _code_points()[points]
    white = kind >= 3
    near = np.zeros(len(points), bool)  # the next code point is there and in the same document
    near[:-1] = ~first[1:]
    text_next = np.zeros(len(points), bool)
    text_next[:-1] = near[:-1] & ~white[1:]
    classes = kind.copy()
    classes[white] = np.where(text_next[white], np.where(kind[white] == 3, _JOIN, _BREAK), _GAP)
    quotes = np.flatnonzero((points == 0x27) & near)
    if len(quotes):
        after = np.append(points, [0, 0])
        a = after[quotes + 1]
        b = np.where(np.append(near, False)[quotes + 1], after[quotes + 2], 0)
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        classes[quotes[np.isin(a, [ord(c) for c in "stmd"])]] = _ONE
        classes[quotes[two]] = _TWO
    return classes[:n]


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which code points begin a token; ``first`` marks those that begin a document."""
    own, forget, table, value = _monoid()
    rule = np.array([[_begins(s, k) for k in range(8)] for s in range(8)])
    out = np.zeros(len(points), bool)
    carried = _FRESH
    for at in range(0, len(points), STRETCH):
        n = min(STRETCH, len(points) - at)
        starts = first[at : at + n]
        classes = _classes(points[at : at + n + 2], first[at : at + n + 2], n)
        done = _scan(np.where(starts, forget[classes], own[classes]).astype(np.int16), table)
        state = np.empty(n, np.uint8)
        state[0] = carried
        state[1:] = value[carried][done[:-1]]
        carried = int(value[carried][done[-1]])
        state[starts] = _FRESH
        out[at : at + n] = rule[state, classes]
    return out


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the pre-tokens of all texts, and each text's first pre-token (n + 1)."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.flatnonzero((data & 0xC0) != 0x80)  # where each code point's bytes begin
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    starts = heads[boundaries(points, first[heads])]
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    return starts, ends, np.searchsorted(starts, offsets)


def _path(given: str | None) -> str:
    """Where the ranks are: the given file, or the public vocabulary, found on the machine that asks."""
    if given is None:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    return given


@cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the lowest-ranked adjacent pair is joined, leftmost first, until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > _HEAP:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        best = min(pairs)
        if best == 1 << 30:
            break
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
    return [ranks[p] for p in parts]


#: Bytes from which a slice is merged by a heap.
_HEAP = 200


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same as :func:`merge`, for slices of any length."""
    n, none = len(piece), 1 << 30
    after, before = array("l", range(1, n + 1)), array("l", range(-1, n - 1))  # parts by their start
    pair = array("l", [ranks.get(piece[i : i + 2], none) if i + 1 < n else none for i in range(n)])
    heap = [(r << 32) | i for i, r in enumerate(pair) if r != none]
    heapq.heapify(heap)

    def renew(i: int) -> None:
        middle = after[i]
        pair[i] = r = ranks.get(piece[i : after[middle]], none) if middle < n else none
        if r != none:
            heapq.heappush(heap, (r << 32) | i)

    while heap:
        top = heapq.heappop(heap)
        i = top & 0xFFFFFFFF
        if pair[i] != top >> 32:
            continue  # one of the two was joined with another
        gone = after[i]
        after[i] = after[gone]
        pair[gone] = none
        if after[i] < n:
            before[after[i]] = i
        renew(i)
        if before[i] >= 0:
            renew(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


@cache
def _cached(path: str) -> SliceCache:
    ranks = _ranks(path)
    return SliceCache(lambda pieces: [merge(p, ranks) for p in pieces])


@cache
def _vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens end to end, and the place and length of each id."""
    ranks = _ranks(path)
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        by_id[i] = token
    lengths = np.array([len(t) for t in by_id], np.int64)
    return np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(lengths) - lengths, lengths


#: Bytes of text a worker looks at together; the arrays beside it take some forty times as much.
_BATCH = 2 << 20

_ENCODED = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary())])
_DECODED = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def _pieces(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column: the values between neighbouring places, as little-endian bytes."""
    width = values.dtype.itemsize
    raw = np.ascontiguousarray(values).tobytes()
    return pa.array([raw[a * width : b * width] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())


#: Bytes of a stretch of a long text.
SPAN = 1 << 20


def stretches(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Places at which a batch may be cut: a token begins there whatever stands before."""
    out = [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if a - out[-1] >= SPAN:
            out.append(a)
        while b - out[-1] > 2 * SPAN:
            at = max(out[-1], a) + SPAN
            while at < b:
                text = data[at : min(at + 65_536, b)]
                # a space before a letter or digit (ASCII)
                found = np.flatnonzero((text[:-1] == 0x20) & _PLAIN[text[1:]])
                if len(found):
                    out.append(at + int(found[0]))
                    break
                at += 65_535
            else:
                break
    return [*out, len(data)]


_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _encode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, (_, _, lengths) = _cached(_path(path)), _vocabulary(_path(path))
        for got in batches:
            data, offsets = B.view(got.column("text"))
            found, stops = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
            cuts = stretches(data, offsets)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                inner = offsets[(offsets > a) & (offsets < b)] - a
                part = data[a:b]
                starts, ends, _ = slices(part, np.array([0, *inner, b - a]))
                ids, _ = tokens(part, B.slices_hash(part, starts, ends), starts, ends)
                found.append(ids)
                stops.append(a + np.cumsum(lengths[ids]))
            ids, stop = np.concatenate(found), np.concatenate(stops)
            at = np.searchsorted(stop, offsets, side="right")
            base = np.repeat(offsets[:-1], np.diff(at))
            yield pa.RecordBatch.from_arrays([got.column("id"), pa.array(np.diff(at)), _pieces(ids.astype("<u4"), at), _pieces((stop - base).astype("<u4"), at)], schema=_ENCODED)

    return run


def _decode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, place, lengths = _vocabulary(_path(path))
        for got in batches:
            raw, offsets = B.view(got.column("ids"))
            ids = np.frombuffer(raw.tobytes(), "<u4")
            out = gather(flat, place[ids], lengths[ids])
            at = np.concatenate([[0], np.cumsum(lengths[ids])])[offsets // 4]
            yield pa.RecordBatch.from_arrays([got.column("id"), got.column("n_tokens"), got.column("ids"), _pieces(out, at)], schema=_DECODED)

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ranks: str | None = None) -> DataFrame:
    """``(id, n_tokens, ids, ends)``: ids and the end of each token in the text's bytes, both little-endian unsigned 32-bit."""
    small_batches(docs.sparkSession, _BATCH)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(_encode(ranks), "id long, n_tokens long, ids binary, ends binary")


def decode(encoded: DataFrame, *, ranks: str | None = None) -> DataFrame:
    """``(id, n_tokens, ids, decoded)``: the bytes that the ids stand for."""
    small_batches(encoded.sparkSession, _BATCH)
    return encoded.select("id", "n_tokens", "ids").mapInArrow(_decode(ranks), "id long, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ranks: str | None = None) -> DataFrame:
    """:func:`decode` of :func:`encode` in one worker: ``(id, n_tokens, ids, decoded)``."""
    small_batches(docs.sparkSession, _BATCH)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decode(ranks)(_encode(ranks)(batches))

    return texts.mapInArrow(run, "id long, n_tokens long, ids binary, decoded binary")
