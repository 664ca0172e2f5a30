"""BPE encoding and decoding by tree concatenation, with the ids of the tokenizers library.

Stretches. A text is cut at its added tokens and then where the vocabulary's
pre-tokeniser cuts it; boundaries come from the scan of ``byte_bpe`` over the
library's own classes of code points (asked of its pre-tokeniser once a worker:
neighbours of one class stay together). What no boundary splits is a stretch.

Trees. A stretch of more than ``PIECE`` bytes is halved until its pieces are no
longer than that. Pieces are encoded side by side, then joined two by two: the
last tokens of the left and the first of the right half are encoded anew
together, and the window grows on a side (twice as many tokens) until its
outermost token there is the one that stood there before. That is exact: a row
of tokens is what BPE gives for their text if and only if each two neighbours
are; inside the window they are by construction, inside the halves they were
before, and at the window's ends the same two tokens meet as before.

Scale. A text of more than ``LEAF`` bytes leaves its row: its leaves (whole
stretches up to ``LEAF`` bytes, and pieces of longer ones) are dealt out as rows
of their own, encoded anywhere, and meet again as ids only. Equal long texts
meet too, in ``SALTS`` groups by id, and each group is encoded once.

Nulls, ties, repeats: a null or empty text has no tokens. Rows come back one for
one with their id as it is (null, repeated). Extra columns are ignored; an empty
table gives an empty result. Decoding takes any ids of the vocabulary; bytes that
are no UTF-8 become replacement characters, as in the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import _bytes as B
from tessera.llm._cache import SliceCache, gather
from tessera.llm._tables import lists, small_batches
from tessera.llm.byte_bpe import boundaries

#: Bytes up to which a stretch is encoded in one go.
PIECE = 1 << 10
#: Bytes of a text's part that is dealt out as a row.
LEAF = 1 << 16
#: Groups into which rows of one long text are dealt.
SALTS = 16
#: Tokens on each side of a join that are encoded anew first.
WINDOW = 4

_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


class Vocabulary:
    """A byte-level BPE file of the tokenizers library: its merges, added tokens and classes of code points."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            told = json.load(f)
        if told["normalizer"] is not None or told["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("only plain byte-level vocabularies are supported")
        if any(t[rule] for t in told["added_tokens"] for rule in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens with rules about their neighbours are not supported")
        self.added = {t["content"].encode(): t["id"] for t in told["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.pattern = re.compile(b"|".join(map(re.escape, longest_first))) if self.added else None
        self.classes = _classes(whole.pre_tokenizer)
        self.bare = Tokenizer(whole.model)
        letters = _byte_letters()
        back = {c: bytes([b]) for b, c in enumerate(letters)}
        self.letters = {b: c for b, c in enumerate(letters)}
        self.tokens = [b""] * whole.get_vocab_size(with_added_tokens=True)
        for token, i in told["model"]["vocab"].items():
            self.tokens[i] = b"".join(back[c] for c in token)
        for token, i in self.added.items():
            self.tokens[i] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.flat, self.place = np.frombuffer(b"".join(self.tokens), np.uint8), np.cumsum(self.lengths) - self.lengths
        self.cache = SliceCache(self.merged)

    def merged(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of byte strings that nothing splits, each by itself."""
        found = self.bare.encode_batch_fast([p.decode("latin-1").translate(self.letters) for p in pieces], add_special_tokens=False)
        return [[self.added[p]] if p in self.added else e.ids for p, e in zip(pieces, found, strict=True)]

    def text(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.place[ids], self.lengths[ids])


def _byte_letters() -> str:
    """The character that stands for each byte in byte-level vocabularies: itself where it prints, else the next of those from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b if b in prints else next(rest)) for b in range(0x100))


def _classes(pre_tokenizer) -> np.ndarray:
    """For each code point one of its class: itself for ASCII and white space, else a letter, digit or mark.

    All other code points stand end to end before the pre-tokeniser, which
    splits where the class changes; one of each run is then tried beside an
    ``a``, a ``0`` and a ``!``.
    """
    out = np.arange(0x110000, dtype=np.uint32)
    every = np.setdiff1d(np.concatenate([np.arange(0x80, 0xD800), np.arange(0xE000, 0x110000)]), _WHITE)
    runs = [at for _, at in pre_tokenizer.pre_tokenize_str(every.astype("<u4").tobytes().decode("utf-32-le"))]
    for a, b in runs:
        kind = next(k for k in "a0!" if len(pre_tokenizer.pre_tokenize_str(k + chr(every[a]))) == 1)
        out[every[a:b]] = ord(kind)
    return out


@cache
def _vocabulary(path: str | None) -> Vocabulary:
    if path is None:  # the public vocabulary, found on the machine that asks
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Vocabulary(path)


def stretches(data: np.ndarray, offsets: np.ndarray, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all stretches of the texts."""
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    inner = np.zeros(len(data), bool)
    if known.pattern is not None and known.pattern.search(raw):
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            for hit in known.pattern.finditer(raw[a:b]):
                first[[a + hit.start(), a + hit.end()]] = True
                inner[a + hit.start() + 1 : a + hit.end()] = True
    starts = heads[boundaries(known.classes[points], first[heads])]
    starts = starts[~inner[starts]]
    return starts, np.append(starts[1:], len(data)) if len(starts) else starts


def halves(size: int, piece: int) -> np.ndarray:
    """Places at which a stretch of ``size`` bytes is cut: into 2, 4, 8 ... parts until none is longer than ``piece``."""
    parts = 1
    while size > parts * piece:
        parts *= 2
    return np.arange(parts + 1, dtype=np.int64) * size // parts


def join(pairs: list[tuple[list[int], list[int]]], known: Vocabulary, window: int = WINDOW) -> list[list[int]]:
    """Ids of each left and right half put together, for many pairs side by side."""
    out: list[list[int]] = [a or b for a, b in pairs]
    todo = [(i, min(window, len(a)), min(window, len(b))) for i, (a, b) in enumerate(pairs) if a and b]
    while todo:
        spans = [b"".join(known.tokens[t] for t in (*pairs[i][0][-n:], *pairs[i][1][:m])) for i, n, m in todo]
        again = []
        for (i, n, m), new in zip(todo, known.merged(spans), strict=True):
            a, b = pairs[i]
            left, right = n == len(a) or new[0] == a[-n], m == len(b) or new[-1] == b[m - 1]
            if left and right:
                out[i] = a[: len(a) - n] + new + b[m:]
            else:
                again.append((i, n if left else min(2 * n, len(a)), m if right else min(2 * m, len(b))))
        todo = again
    return out


def grow(trees: list[list[list[int]]], known: Vocabulary) -> list[list[int]]:
    """The ids of each stretch from those of its pieces (a power of two of them), level by level."""
    trees = [list(t) for t in trees]
    while any(len(t) > 1 for t in trees):
        at = [(k, i) for k, t in enumerate(trees) if len(t) > 1 for i in range(0, len(t), 2)]
        joined = join([(trees[k][i], trees[k][i + 1]) for k, i in at], known)
        level: dict[int, list[list[int]]] = {}
        for (k, _), ids in zip(at, joined, strict=True):
            level.setdefault(k, []).append(ids)
        for k, t in level.items():
            trees[k] = t
    return [t[0] for t in trees]


def encoded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all stretches, end to end, and the number each has."""
    size = ends - starts
    long = np.flatnonzero(size > PIECE)
    if not len(long):
        return known.cache(data, B.slices_hash(data, starts, ends), starts, ends)
    cuts = [starts[i] + halves(int(size[i]), PIECE) for i in long]
    small = np.flatnonzero(size <= PIECE)
    s = np.concatenate([starts[small], *(c[:-1] for c in cuts)])
    e = np.concatenate([ends[small], *(c[1:] for c in cuts)])
    ids, n = known.cache(data, B.slices_hash(data, s, e), s, e)
    at = np.concatenate([[0], np.cumsum(n)])
    parts, k = [], len(small)
    for c in cuts:
        parts.append([ids[at[k + j] : at[k + j + 1]].tolist() for j in range(len(c) - 1)])
        k += len(c) - 1
    grown = grow(parts, known)
    counts = np.empty(len(size), np.int64)
    counts[small], counts[long] = n[: len(small)], [len(g) for g in grown]
    out = np.empty(int(counts.sum()), np.uint32)
    place = np.cumsum(counts) - counts
    first = int(at[len(small)])
    steps = np.arange(first) - np.repeat(at[: len(small)], n[: len(small)])
    out[np.repeat(place[small], n[: len(small)]) + steps] = ids[:first]
    for i, g in zip(long.tolist(), grown, strict=True):
        out[place[i] : place[i] + len(g)] = g
    return out, counts


_OUT = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
_CUT = pa.schema([("key", pa.string()), ("leaf", pa.int64()), ("goes_on", pa.bool_()), ("body", pa.binary()), ("sizes", pa.binary())])
_LEAF = pa.schema([("key", pa.string()), ("leaf", pa.int64()), ("goes_on", pa.bool_()), ("ids", pa.binary())])
_JOINED = pa.schema([("key", pa.string()), *list(_OUT)[1:]])


def _row(ids: np.ndarray, counts: np.ndarray, known: Vocabulary) -> list[pa.Array]:
    """Columns ``n_tokens``, ``ids`` and ``decoded`` of texts, from their ids end to end."""
    raw = known.text(ids).tobytes()
    ends = np.concatenate([[0], np.cumsum(known.lengths[ids])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return [pa.array(counts, pa.int64()), lists(ids.astype(np.int32), counts, pa.int32()), pa.array(texts, pa.string())]


def _short(path: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(path)
        for got in batches:
            data, offsets = B.view(got.column("text"))
            starts, ends = stretches(data, offsets, known)
            ids, n = encoded(data, starts, ends, known)
            counts = np.diff(np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, offsets)])
            yield pa.RecordBatch.from_arrays([got.column("id"), *_row(ids, counts, known)], schema=_OUT)

    return run


def _leaves(path: str | None, leaf: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The leaves of long texts; ``goes_on``: the stretch that ends this leaf isn't over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(path)
        for got in batches:
            for key, text in zip(got.column("key").to_pylist(), got.column("text").to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                starts, ends = stretches(data, np.array([0, len(data)]), known)
                at, number = 0, 0
                while at < len(starts):
                    if ends[at] - starts[at] > leaf:
                        cuts = starts[at] + halves(int(ends[at] - starts[at]), leaf)
                        rows = [(a, b, np.array([b - a]), j + 2 < len(cuts)) for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
                        at += 1
                    else:
                        stop = int(np.searchsorted(ends, starts[at] + leaf, side="right"))
                        rows = [(starts[at], ends[stop - 1], ends[at:stop] - starts[at:stop], False)]
                        at = stop
                    for a, b, sizes, goes_on in rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([key], [number], [goes_on], [data[a:b].tobytes()], [sizes.astype("<u4").tobytes()]), _CUT, strict=True)], schema=_CUT)
                        number += 1

    return run


def _encode_leaves(path: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(path)
        for got in batches:
            found = []
            for body, raw in zip(got.column("body").to_pylist(), got.column("sizes").to_pylist(), strict=True):
                ends = np.cumsum(np.frombuffer(raw, "<u4").astype(np.int64))
                ids, _ = encoded(np.frombuffer(body, np.uint8), np.concatenate([[0], ends[:-1]]), ends, known)
                found.append(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([got.column("key"), got.column("leaf"), got.column("goes_on"), pa.array(found, pa.binary())], schema=_LEAF)

    return run


def _join_leaves(path: str | None) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        known = _vocabulary(path)
        rows = rows.sort_by("leaf")
        trees: list[list[list[int]]] = []
        glued = False
        for raw, goes_on in zip(rows["ids"].to_pylist(), rows["goes_on"].to_pylist(), strict=True):
            ids = np.frombuffer(raw, "<u4").tolist()
            if glued:
                trees[-1].append(ids)
            else:
                trees.append([ids])
            glued = goes_on
        ids = np.array([i for t in grow(trees, known) for i in t], np.uint32)
        return pa.Table.from_arrays([rows["key"].slice(0, 1), *_row(ids, np.array([len(ids)]), known)], schema=_JOINED)

    return run


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, leaf: int = LEAF) -> DataFrame:
    """``(id, n_tokens, ids, decoded)``: each text's ids and the text that they stand for."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = "n_tokens long, ids array<int>, decoded string"
    short = texts.where(F.octet_length("text") <= leaf).mapInArrow(_short(tokenizer), f"id long, {out}")
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("string")
    long = texts.where(F.octet_length("text") > leaf).withColumn("key", F.concat(F.sha2("text", 256), salt))
    cut = long.select("key", "text").dropDuplicates(["key"]).mapInArrow(_leaves(tokenizer, leaf), "key string, leaf long, goes_on boolean, body binary, sizes binary")
    done = cut.repartition("key", "leaf").mapInArrow(_encode_leaves(tokenizer), "key string, leaf long, goes_on boolean, ids binary")
    joined = done.groupBy("key").applyInArrow(_join_leaves(tokenizer), f"key string, {out}")
    return short.unionByName(long.select("id", "key").join(joined, "key").select("id", "n_tokens", "ids", "decoded"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, leaf: int = LEAF) -> DataFrame:
    """``(id, n_tokens, ids)``."""
    return round_trip(docs, id_col, text_col, tokenizer=tokenizer, leaf=leaf).drop("decoded")


def decode(encoded: DataFrame, id_col: str = "id", ids_col: str = "ids", *, tokenizer: str | None = None) -> DataFrame:
    """``(id, n_tokens, ids, decoded)`` of any lists of ids; null lists are empty, an id outside the vocabulary is an error."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(tokenizer)
        for got in batches:
            held = got.column("ids").combine_chunks() if isinstance(got.column("ids"), pa.ChunkedArray) else got.column("ids")
            counts = np.array([len(x) for x in held.to_pylist()], np.int64)
            ids = held.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids) and not 0 <= ids.min() <= ids.max() < len(known.tokens):
                raise ValueError("an id is not in the vocabulary")
            yield pa.RecordBatch.from_arrays([got.column("id"), *_row(ids, counts, known)], schema=_OUT)

    lists_ = F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))
    return encoded.select(F.col(id_col).cast("long").alias("id"), lists_.alias("ids")).mapInArrow(run, "id long, n_tokens long, ids array<int>, decoded string")
